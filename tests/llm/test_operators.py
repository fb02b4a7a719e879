"""Operators against brute force on small frames, and every odd case."""

import codecs
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from leasebook.llm import byte_bpe, language_id, line_dedup, linear, order_minhash, pseudonyms, quality, sharding, words
from leasebook.llm.common import join_spread
from leasebook.llm.decontamination import clean, contamination, find
from leasebook.llm.minhash_dedup import fewest_matches, groups, without_copies
from leasebook.llm.substring_dedup import remove_repeats
from tests.llm import frames

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# sharding

def smallest_capacity(sizes, parts):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= parts else (middle + 1, high)
    return low


@pytest.mark.parametrize("pieces", [4, 1 << 14])
def test_sharding_is_minimax(spark, docs, monkeypatch, pieces):
    monkeypatch.setattr(sharding, "PIECES", pieces * 15)
    rows = sharding.shard(docs, 5).join(docs.select("doc_id", "text"), "doc_id").collect()
    order = {}
    for r in docs.select("text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b")).collect():
        order.setdefault(((r["a"] % 2**64) >> 52, r["a"], r["b"]), 0)
        order[((r["a"] % 2**64) >> 52, r["a"], r["b"])] += len(r["text"].encode()) + 1
    per = {k: sum(r["size"] for r in rows if r["shard"] == k) for k in range(5)}
    assert max(per.values()) == smallest_capacity([order[k] for k in sorted(order)], 5)
    for k in per:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert len({(r["text"], r["shard"]) for r in rows}) == len({r["text"] for r in rows})


def test_sharding_of_a_group_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BIN_ROWS", 16)
    df = spark.createDataFrame([(i, "the same text again" if i % 3 else f"text {i}") for i in range(400)], "doc_id long, text string")
    rows = sharding.shard(df, 4).collect()
    same = {r["shard"] for r in rows if r["size"] == len("the same text again") + 1 and r["doc_id"] % 3}
    assert len(same) == 1 and {r["shard"] for r in rows} == {0, 1, 2, 3}
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


@pytest.mark.parametrize("seed", range(6))
def test_sharding_with_groups_just_under_an_even_share(monkeypatch, seed):
    """Capacities that one group forces up leave many open stretches; few are summed at a time, and the cuts are exact."""
    monkeypatch.setattr(sharding, "PIECES", 512)
    monkeypatch.setattr(sharding, "STRETCHES", 16)
    rng = random.Random(seed)
    sizes = [rng.randint(1, 300) for _ in range(20_000)]
    for share in (17, 18, 19)[: seed % 4]:
        sizes.insert(rng.randrange(len(sizes)), sum(sizes) // share)
    starts = np.cumsum([0, *sizes])
    runs, total, most, turns = sharding.Runs(int(starts[-1])), int(starts[-1]), max(sizes), 0
    while True:
        cuts, unsure = runs.unsure(16, most)
        if not unsure:
            break
        turns += 1
        assert len(unsure) <= 2 * 16 and turns < 60
        parts, pieces = [], max(512 // len(unsure), 2)
        for begin, end in unsure:
            step = -(-(end - begin) // pieces)
            inside = [(int(a), int(b)) for a, b in zip(starts, starts[1:]) if begin <= a < end]
            cells = {}
            for a, b in inside:
                cells.setdefault((a - begin) // step, []).append((a, b))
            parts += [(c[0][0], c[-1][0], c[-1][1], len(c)) for c in cells.values()]
        runs.refine(parts)
    capacity, want, at = smallest_capacity(sizes, 16), [], 0
    for a, b in zip(starts, starts[1:]):
        if b - at > capacity:
            want.append(int(a))
            at = a
    assert cuts == want


# line dedup

@pytest.mark.parametrize("hot", [4, 64])
def test_lines_equal_brute_force(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    few = docs.where("doc_id < 120")
    got = {(r["id"], r["line"]) for r in line_dedup.repeated_lines(few).collect()}
    assert got == frames.repeated_lines([x for x in texts if x[0] < 120])
    assert got


@pytest.mark.parametrize("hot", [4, 64])
def test_lines_of_any_length_equal_brute_force(spark, docs, texts, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    few = [x for x in texts if x[0] < 120]
    rng = random.Random(3)
    few += [(1000 + i, "\n".join(" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))) for _ in range(5))) for i in range(60)]
    few += [(2000, "Share this page\n全文一行日本語。"), (2001, "share  this page\n全文一行日本語。\n \n\n"), (2002, "\n \nq1 q2 q3 q4\nq1 q2 q3 q4 q5")]
    got = {(r["id"], r["line"]) for r in line_dedup.repeated_lines(spark.createDataFrame(few, "doc_id long, text string")).collect()}
    assert got == frames.repeated_lines(few)
    assert {(2001, 0), (2001, 1), (2002, 3)} <= got and not {(2001, 2), (2001, 3), (2002, 0), (2002, 1), (2002, 2)} & got


# language

def test_language_families_and_held_out_accuracy(docs):
    rows = language_id.learned_and_identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)
    eye = np.eye(4)
    assert language_id.families({"a": eye[0] + eye[1], "b": eye[0], "c": eye[2] + eye[3], "d": eye[3]}) == [["a", "b"], ["c", "d"]]


def test_language_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "letters")], "doc_id long, text string")
    x = np.array([language_id.features(t) for t in ("ab ab", "cd cd")])
    model = language_id.LanguageModel(x, np.array(["p", "q"], object))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] in ("p", "q")


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 1] > 0.1, 1.0, -1.0)
    w = linear.svm(x, y)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97


def test_language_without_ids_and_with_many_languages(spark):
    rows = [(None, f"aaa bbb ccc {i}", "p") for i in range(60)] + [(None, f"xyz zyx yxz {i}", "q") for i in range(60)] + [(1, "mmm", "z")]
    df = spark.createDataFrame([(i, f"{t} {chr(97 + n % 26)}", lang) for n, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit(df, per_language=20, languages=2)
    assert sorted(c for f in model.families for c in f) == ["p", "q"]
    assert {r["lang_pred"] for r in language_id.identify(df.where("lang = 'q'"), model).collect()} == {"q"}


# substring dedup, near duplicates, decontamination

def test_join_spread_equals_a_join(spark):
    rng = random.Random(8)
    pairs = [(rng.choice([0] * 6 + list(range(9)) + [None]), i % 5, f"t{i}") for i in range(400)] * 2
    rows = spark.createDataFrame(pairs, "k long, l long, v string")
    one = rows.groupBy("k", "l").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least")).where("k IS NULL OR k < 7")
    want = sorted(tuple(r) for r in rows.join(one.drop("n"), ["k", "l"]).select("k", "l", "v", "least").collect())
    for most, least in ((8, 3), (1 << 14, 1024), (2, 1)):
        got = join_spread(rows, one, ["k", "l"], most=most, least=least).select("k", "l", "v", "least")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_documents_sharing_a_passage_with_many_items(spark):
    passage = " ".join(f"p{i}" for i in range(10))
    items = [(i, f"{passage} {'a' if i % 3 else 'b'}{i}") for i in range(40)] + [(99, " ".join(f"q{i}" for i in range(10)))]
    rows = [(d, f"d{d} {passage} e{d}" + (" " + items[-1][1] if d % 4 == 0 else "")) for d in range(30)]
    df, it = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert find(df, it)[1].count() == 30 + 8  # a row per place of a shared window, whatever the number of items
    for r in contamination(df, it).collect():
        n, hit, found = frames.hit_words(dict(rows)[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, sorted(map(str, found)))

def test_shared_passages_with_short_windows(spark):
    rng = random.Random(4)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([*passages, *"abcdefgh", "A", "é x"]) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = frames.kept_words(rows, 8)
    for r in remove_repeats(df, 8, 4).collect():
        assert bytes(r["kept"]).decode() == " ".join(want[r["doc_id"]])
        assert r["n_words"] - r["n_removed"] == len(want[r["doc_id"]])


def near_copies(rng, n, edits):
    base = [f"w{i}" for i in range(100)]
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
        yield i, " ".join(w)


def test_groups_of_a_large_cluster_equal_brute_force(spark):
    rows = list(near_copies(random.Random(2), 150, 9))
    want = frames.shingle_groups(rows, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in groups(df, 4).collect()}
    assert got == {i: (c, i == c) for i, c in want.items()}
    assert 2 < len(set(want.values())) < 140


def test_posterior_bound():
    assert fewest_matches(32, 0.8, 1e-7) < fewest_matches(32, 0.8, 1e-3) < 26
    assert fewest_matches(128, 0.8, 1e-7) > 60


def test_items_of_any_length(spark):
    items = [(1, "one"), (2, "Two words"), (3, " ".join(f"k{i}" for i in range(30))), (4, None), (5, "!!"), (6, "one"),
             (None, "no id"), (7, " ".join(f"k{i}" for i in range(5, 15)))]
    rows = [(1, "One and two, words"), (2, None), (3, "x " + " ".join(f"K{i}" for i in range(3, 20)) + " y one"), (4, ""), (5, "none here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, t) for i, t in items if i is not None and t is not None]
    for r in contamination(df, it).collect():
        n, hit, found = frames.hit_words(dict(rows)[r["doc_id"]], known)
        assert (r["n_words"], r["n_hit"], set(r["items"])) == (n, hit, {str(x) for x in found})
    assert {r["doc_id"] for r in clean(df, it).collect()} == {2, 4, 5}


# tokens

@pytest.fixture(scope="module")
def coder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encoder, decoder = byte_bpe.coders(f.read(), public_tokenizers.PATTERN)
    return encoder, decoder, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_ids_equal_the_public_library(coder, texts, monkeypatch):
    encoder, decoder, known = coder
    rng = random.Random(5)
    bits = ["a", "b", "the ", "ing", "  ", "\n", "\t", "é", "ß", "日本", "😀", "0", "12", "!!", "'s", "'ll", "A", "_", "aaaa", "<|endoftext|>", "\x1c", "\x85", "\xa0"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += [x * 300 for x in ("a", "ab", " ", "!", "é", "日", "xyz", "\n ")] + [t for _, t in texts]
    monkeypatch.setattr(byte_bpe, "MEMORY", 2000)  # also when memory runs full and starts afresh
    for text in made:
        ids = encoder.encode(text).tolist()
        assert ids == known.encode_ordinary(text)
        assert "".join(decoder.stream(ids)) == decoder.decode(ids) == text


def test_decoder_of_broken_bytes(coder):
    _, decoder, _ = coder
    single = {t: i for i, t in decoder.bytes_of.items() if len(t) == 1}
    rng = random.Random(6)
    pool = [0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE2, 0x82, 0xAC]
    for _ in range(2000):
        raw = bytes(rng.choice(pool) for _ in range(rng.randint(0, 9)))
        ids = [single[bytes([b])] for b in raw]
        out = "".join(decoder.stream(ids))
        assert decoder.decode(ids) == out == codecs.decode(raw, "utf-8", "replace")


# quality

def test_quality_of_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = quality.learned_and_scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.3


def test_class_prior():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, 4000)
    unlabelled = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    above = np.array([(unlabelled >= c).sum() for c in quality.thresholds(positive)])
    assert abs(quality.class_prior([positive], above, len(unlabelled)) - 0.7) < 0.06


def test_prior_covers_all_rows(spark, monkeypatch):
    base = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    seen = {}
    monkeypatch.setattr(quality, "UNLABELLED", 40)
    monkeypatch.setattr(quality, "class_prior", lambda p, above, rows: seen.update(above=above, rows=rows) or 0.5)
    quality.fit(docs, labels)
    assert seen["rows"] == docs.count() > 100
    assert (np.diff(seen["above"]) <= 0).all() and 0 < seen["above"][0] <= seen["rows"]


# pseudonyms

VALUES = [
    "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "ann.b+C9@Mail7.example.com", "x@y.org", "191.60.21.84", "0.0.0.0",
    "2021-02-28", "1900/01/01", "31.12.2099", "123-45-6789", "+1 (017) 555-7713", "+49 30 1234567", "DE89370400440532013000",
]
REFUSED = ["4111 1111 1111 1112", "999.1.1.1", "2021-02-30", "1899-12-31", "DE88370400440532013000", "1.2.3.4.5"]


def test_pseudonyms_keep_formats_and_links(spark):
    rows = [(i, f"see {v}, or {v} and {VALUES[0]}!", v) for i, v in enumerate(VALUES + REFUSED)] + [(90, None, ""), (91, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    new = pseudonyms.pseudonymise(df, "key")
    assert new.columns == df.columns
    out = {r["doc_id"]: r["text"] for r in new.collect()}
    back = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(new, "key", back=True).collect()}
    assert back == {i: t for i, t, _ in rows}
    first = out[0].split("see ")[1].split(",")[0]
    shape = lambda x: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in x)
    for i, v in enumerate(VALUES):
        assert v not in out[i].split(" and ")[0] and out[i].endswith(f"{first}!")
        assert v.count(".") == 3 or shape(out[i]) == shape(rows[i][1])  # parts of an address may change in length
        a, b = out[i].removeprefix("see ").split(" and ")[0].split(", or ")
        assert a == b
    for i, v in enumerate(REFUSED, len(VALUES)):
        assert v in out[i]
    assert out[90] is None and out[91] == ""
    body = [int(c) for c in reversed(first.replace(" ", ""))]
    assert (sum(body[::2]) + sum(sum(divmod(2 * d, 10)) for d in body[1::2])) % 10 == 0
    assert out[7].split()[1] != {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(df, "other").collect()}[7].split()[1]


def test_pseudonyms_of_letters_groups_and_neighbours(spark):
    ibans = ["GB82WEST12345698765432", "NL91ABNA0417164300", "FR1420041010050500013M02606", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    card = "4111 1111 1111 1111"
    cards = [f"{card} 12/27", f"{card} 123", f"123 {card}", f"4111-1111-1111-1111 {card}", "4111111111111111 192.168.0.1", "3782 822463 10005 1234"]
    cards += [f"{card} {i:03d}" for i in range(0, 1000, 37)]
    phones = ["(212) 555-0123", "212-555-0123", "0049 30 1234567"]
    rows = [(i, f"see {v}, then") for i, v in enumerate(ibans + cards + phones)]
    new = pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key")
    out = {r["doc_id"]: r["text"] for r in new.collect()}
    assert {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(new, "key", back=True).collect()} == dict(rows)
    shape = lambda x: "".join("9" if c.isdigit() else "A" if c.isupper() else c for c in x)
    for i, v in enumerate(ibans):
        got = out[i].removeprefix("see ").removesuffix(", then")
        plain = got.replace(" ", "")
        assert got != v and got[:2] == v[:2] and shape(got) == shape(v)
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert not any(x in t for t in out.values() for x in (card, "4111111111111111", "4111-1111", "192.168.0.1", "3782 822463", "555-0123", "1234567"))
    assert out[len(ibans)].endswith(" 12/27, then")


# fingerprints

def test_fingerprints_follow_edits(spark, docs, texts):
    few = docs.where("doc_id < 60")
    own = sorted(x for x in texts if x[0] < 60)
    rows = {r["doc_id"]: r for r in order_minhash.edited_fingerprints(few).collect()}
    for (i, text), (_, after) in zip(own, own[1:] + own[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values()]) > 0.9
    by_text = {}
    for i, text in own:
        assert by_text.setdefault(text, rows[i]["fingerprint"]) == rows[i]["fingerprint"]


def test_likeness_falls_with_edits_and_sees_order(spark):
    rng = random.Random(8)
    base = [f"token{i}" for i in range(300)]
    light, heavy, turned = list(base), list(base), base[150:] + base[:150]
    for k, w in ((6, light), (90, heavy)):
        for i in rng.sample(range(300), k):
            w[i] = f"new{i}"
    shuffled = rng.sample(base, 300)
    df = spark.createDataFrame([(" ".join(base), " ".join(x)) for x in (base, light, heavy, turned, shuffled)], "a string, b string")
    df = order_minhash.fingerprint(order_minhash.fingerprint(df, "a", "x"), "b", "y")
    same, few, many, moved, mixed = (r[0] for r in df.select(order_minhash.likeness("x", "y")).collect())
    assert same == 1 and 1 > few > many and few > moved > mixed


def test_an_early_edit_in_text_without_blanks_leaves_most_equal(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(letters) for _ in range(600)) for letters in ("日本語全文一行東京大学生会社員中国", "abcdefghijklmnopqrstuvwxyz0123456789")]
    df = spark.createDataFrame([(x, x[:2] + "#" + x[2:]) for x in texts], "a string, b string")
    df = order_minhash.fingerprint(order_minhash.fingerprint(df, "a", "x"), "b", "y")
    assert all(r[0] > 0.8 for r in df.select(order_minhash.likeness("x", "y")).collect())


# hashes

def test_window_hashes_tell_words_apart():
    a = b"the cat sat on the mat the cat sat"
    h = words.word_hashes(a, *words.spans(a, words.NOT_BLANK))
    grams = words.gram_hashes(h, 3)
    assert grams[0] == grams[6] and len(set(grams.tolist())) == 6
    shifted = b"xx " + a
    assert words.gram_hashes(words.word_hashes(shifted, *words.spans(shifted, words.NOT_BLANK)), 3)[1:].tolist() == grams.tolist()


# plans and odd cases

def test_native_operators_run_no_python(spark, docs):
    from leasebook.llm.queries import QUERIES

    for name in ("op2_line_dedup", "op8_pseudonyms", "op10_order_minhash"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def items_of(spark):
    return spark.createDataFrame([(1, frames.PASSAGE)], "item_id long, text string")


def labels_of(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


ROW_OPERATORS = {
    "shard": lambda s, d: sharding.shard(d),
    "lines": lambda s, d: line_dedup.without_repeated_lines(d),
    "language": lambda s, d: language_id.learned_and_identified(d),
    "repeats": lambda s, d: remove_repeats(d),
    "groups": lambda s, d: groups(d),
    "tokens": lambda s, d: byte_bpe.encode_decode(d),
    "quality": lambda s, d: quality.learned_and_scored(d, labels_of(s)),
    "pseudonyms": lambda s, d: pseudonyms.pseudonymise(d, "key"),
    "contamination": lambda s, d: contamination(d, items_of(s)),
    "fingerprints": lambda s, d: order_minhash.edited_fingerprints(d),
}


@pytest.mark.parametrize("name", list(ROW_OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    rows = ROW_OPERATORS[name](spark, frames.odd(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in frames.ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    if name == "repeats":
        assert [by[i][0]["n_removed"] for i in (1, 2, 3, 6, 8, 9)] == [0, 0, 0, by[6][0]["n_words"], 0, 0]
        assert by[7][0]["n_removed"] == 60 and by[None][0]["n_removed"] == 0
    if name == "groups":
        assert [by[i][0]["component_id"] for i in (1, 2, 3, 4, 6, 7)] == [1, 2, 3, 4, 5, 7]
        assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    if name == "contamination":
        assert [by[i][0]["n_hit"] for i in (1, 2, 3, 6, 7)] == [0, 0, 0, 60, 60]
    if name == "lines":
        assert by[1][0]["text"] is None and by[6][0]["n_removed"] == 3 and by[6][0]["text"] == ""
    if name == "tokens":
        assert by[1][0]["n_tokens"] == 0 and by[8][0]["decoded"] == frames.ROWS[10][1]
    if name == "fingerprints":
        assert len({r["fingerprint"] for r in (*by[6], *by[5])}) == 2
    assert ROW_OPERATORS[name](spark, frames.none(spark)).count() == 0


def test_copies_leave_one_row(spark):
    rows = without_copies(frames.odd(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["None", "1", "2", "3", "4", "5", "5", "7", "8", "9"])
    assert set(rows[0].asDict()) >= set(frames.NAMES) and all(r["row"] == "row" for r in rows)


def test_rows_that_share_an_id_or_have_none_are_linked_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (6, a), (7, b + " more"), (None, c), (None, c + " more"), (8, c), (None, "text of its own, linked with none"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in without_copies(df).collect()}
    assert {(5, a), (5, b), rows[7], rows[8]} < got and len(got) == 5 and got - {(5, a), (5, b), rows[7], rows[8]} < {rows[4], rows[5]}
    out = groups(df).collect()
    assert sorted(r["component_id"] for r in out if r["doc_id"] in (5, 6, 7)) == [5] * 4
    assert [r["kept"] for r in out if r["doc_id"] == 5] == [True, True] and not any(r["kept"] for r in out if r["doc_id"] in (6, 7, 8))
    assert sum(r["kept"] for r in out if r["doc_id"] is None) == 3 and all(r["component_id"] is None for r in out if r["doc_id"] in (None, 8))


def test_clean_rows_without_an_id_all_stay(spark):
    rows = [(i if i % 3 else None, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in without_copies(df).collect()} == set(rows)
