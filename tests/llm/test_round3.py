"""SimHash groups, conversation repair and collocations against brute force, and every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations, product

import pytest
import xxhash
from pyspark.sql import functions as F

from leasebook.llm import collocations, conversation_repair, simhash_dedup
from tests.llm import frames

SMALL = "/root/testdata/sf0.001"


# SimHash

def plain_fingerprint(text):
    w = frames.words(frames.lower(text))
    grams = [" ".join(w[i: i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, distance=4):
    """id -> smallest id of its group, by comparing all pairs."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    want = plain_groups(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.groups(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert any(i != c for i, c in want.items())


@pytest.mark.parametrize("crowd", [2, 16, 256])
def test_simhash_links_equal_brute_force(spark, monkeypatch, crowd):
    """Clouds of near fingerprints around near centres, with crowded variants."""
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    rng = random.Random(crowd)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    centres = [0, (1 << 64) - 1] + [rng.getrandbits(64) for _ in range(6)]
    centres += [flip(c, 7) for c in centres]
    values = sorted({flip(c, rng.randint(0, 5)) for c in centres for _ in range(40)})
    want = plain_groups(dict(zip(values, values)))
    signed = lambda x: x - (x >> 63 << 64)
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash_dedup.links(nodes).collect()]
    parent = {v: v for v in values}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert {v: root(v) for v in values} == want
    assert len(set(want.values())) > 1


def test_simhash_odd_rows(spark):
    rows = simhash_dedup.groups(frames.odd(spark)).collect()
    assert len(rows) == len(frames.ROWS)
    empty = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert {r["fingerprint"] for r in empty} == {"0" * 16} and {r["component_id"] for r in empty} == {1}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 5}) == 2
    assert simhash_dedup.groups(frames.none(spark)).count() == 0
    long = " ".join(f"w{i}" for i in range(2 * simhash_dedup.PIECE + 7))
    assert simhash_dedup.fingerprint(long.encode()) == plain_fingerprint(long)


# conversations

def plain_repair(rows):
    """Figures of one conversation from its damaged rows (turn, role, text), by relaxing until nothing changes."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    grammar = re.compile(r"(s?(ua)+)?")
    initials = [r[1][:1] for r in rows]
    known = sorted({r[0] for r in rows if r[0] is not None})
    out = {
        "gaps": known[-1] - known[0] + 1 - len(known) if known else 0, "blank": faults.count("b"), "duplicate": faults.count("d"),
        "truncated": faults.count("t"), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
    }
    # Best (cost, audit, lines) per (rows taken, roles so far: none, s, ..u, ..a).
    best = [{} for _ in range(len(rows) + 1)]
    best[0][""] = (0, "", [])

    def better(i, state, value):
        if state not in best[i] or value[:2] < best[i][state][:2]:
            best[i][state] = value
            return True
        return False

    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    for i in range(len(rows) + 1):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit, lines) in list(best[i].items()):
                for x in set(follow[state]) & set("ua"):
                    changed |= better(i, x, (cost + 5, audit + "I", lines + [{"u": "user:", "a": "assistant:"}[x]]))
        if i == len(rows):
            break
        _, role, text = rows[i]
        for state, (cost, audit, lines) in best[i].items():
            better(i + 1, state, (cost + 2, audit + "D", lines))
            if faults[i] in "bd":
                continue
            extra = 5 if faults[i] == "t" else 0
            for x in follow[state]:
                if role[:1] == x:
                    better(i + 1, x, (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
                if x in "ua":
                    better(i + 1, x, (cost + extra + 1, audit + "R", lines + [{"u": "user:", "a": "assistant:"}[x] + text]))
    cost, audit, lines = min((best[-1][s] for s in ("", "a") if s in best[-1]), key=lambda v: v[:2])
    assert grammar.fullmatch("".join(x[:1] for x in lines))
    return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        held = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def check_repair(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r.asDict() for r in conversation_repair.repair(conversation_repair.damaged(df)).collect()}
    want = {c: plain_repair(held) | {"conv_id": c} for c, held in plain_damage(rows).items()}
    assert got == want


def test_conversations_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repair(spark, rows)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_conversations_of_every_kind(spark, monkeypatch, block):
    """Long and short ones, cut into blocks of every size; ties of turn, repeated rows, nulls, other roles."""
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", block)
    rng = random.Random(block)
    texts = ["One.", "two", " \t\n", "", None, "Three!", "Four?\n", "é ü", "x.\x0b"]
    roles = ["user", "assistant", "system", "tool", None, "", "unknown"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles[: 3 + c % 5]), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(900, t, rng.choice(roles[:3]), rng.choice([f"text {t}.", f"text {t}", "again."])) for t in range(300)]
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "none."), (901, 7, "user", "same."), (901, 7, "user", "same.")]
    check_repair(spark, rows)


def test_every_short_conversation_is_lightest():
    """All strings of edits up to a length, for all short rows of roles and faults."""
    follow = re.compile(r"(s?(ua)+)?")
    for n in range(4):
        for roles in product("sua", repeat=n):
            for faults in product("-bt", repeat=n):
                best = None
                for edits in product("KRDI", repeat=n + 2):
                    for used in range(n, n + 3):
                        e = edits[:used]
                        if used < n + 2 and any(x != "K" for x in edits[used:]) or sum(x != "I" for x in e) != n:
                            continue
                        at, cost, options = 0, 0, [""]
                        for x in e:
                            if x == "I":
                                cost, options = cost + 5, [o + y for o in options for y in "ua"]
                                continue
                            if x != "D" and faults[at] == "b":
                                options = []
                            cost += {"K": 0, "R": 1, "D": 2}[x] + (5 if x != "D" and faults[at] == "t" else 0)
                            options = [o + y for o in options for y in {"K": roles[at], "R": "ua", "D": [""]}[x]]
                            at += 1
                        if any(follow.fullmatch(o) for o in options):
                            best = min(best, (cost, "".join(e))) if best else (cost, "".join(e))
                cost, ways = conversation_repair.lightest([conversation_repair.all_spans("".join(roles), "".join(faults))])
                assert (cost, ways[0][1]) == best


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, seq int, conv string")
    assert conversation_repair.repair(conversation_repair.damaged(df)).count() == 0
    df = spark.createDataFrame([(1, 2, "user", "x" * 3_000_000 + ".", 5, "c")], df.schema)
    assert conversation_repair.repair(conversation_repair.undamaged(df)).first()["audit"] in ("D", "KI")


# collocations

def plain_collocations(rows, least, top):
    count, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", frames.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for i, j in combinations(range(len(w) + 1), 2):
                if j - i <= 5:
                    count[lang or "und", tuple(w[i:j])] += 1
    held = {k: f for k, f in count.items() if f >= least}
    out = []
    for (lang, w), a in held.items():
        longer = [v for (x, v), f in held.items() if x == lang and len(v) > len(w) and 100 * f >= 100 * a]
        if len(w) < 2 or any(v[i: i + len(w)] == w for v in longer for i in range(len(v))):
            continue
        n = total[lang]
        score, k = min((1000 * a * n // (held[lang, w[:k]] * held[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, score, a, " ".join(w), held[lang, w[:k]], held[lang, w[k:]], n))
    result = set()
    for lang in total:
        ranked = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:top]
        result |= {(lang, i, r[3], r[2], r[4], r[5], r[6], r[1]) for i, r in enumerate(ranked, 1)}
    return result


def check_collocations(spark, rows, least, top):
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, phrase string")
    got = [tuple(r) for r in collocations.collocations(df, least, top).collect()]
    assert set(got) == plain_collocations(rows, least, top) and len(got) == len(set(got))
    return got


@pytest.mark.parametrize("chunk,bits", [(1 << 21, 1 << 26), (40, 1 << 10)])
def test_collocations_equal_brute_force(spark, monkeypatch, chunk, bits):
    """Also with texts read in small parts, and with a table so full that it lets much through."""
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "TABLE_BITS", bits)
    rng = random.Random(chunk)
    made = lambda: " ".join(rng.choice(["a b c", "a  b", "A\tb c d e f", "x", "y.", "z,", "é", "u v\nw", "u v w", f"r{rng.randrange(40)}"]) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice(["en", "en", "de", None]), made()) for _ in range(150)] + [("en", None), ("en", ""), (None, " \n"), ("fr", "one two")]
    got = check_collocations(spark, rows, 5, 2000)
    assert any(len(r[2].split()) == 5 for r in got) and {r[0] for r in got} >= {"en", "de", "und"}
    check_collocations(spark, rows, 5, 3)


def test_no_collocations(spark):
    assert check_collocations(spark, [], 5, 9) == [] and check_collocations(spark, [(None, None), ("en", "")], 1, 9) == []


def test_collocations_of_a_third_under_one_word(spark):
    """Streams over several ranges, whose first phrases begin in ranges before."""
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(5)
        rows = [("en", " ".join(["the"] + [rng.choice("abcd") for _ in range(6)])) for _ in range(700)]
        check_collocations(spark, rows, 3, 2000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
