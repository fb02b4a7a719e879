"""Phrases whose words stand together more often than their parts let expect, per language.

A text is lower-cased (A-Z), cut into pieces at `[.,;:!?]` and line ends, and pieces into words at blanks and
tabs. Phrases of 2 to `LONGEST` words that occur at least `least` times are candidates. A candidate of a
occurrences that is cut into parts of l and r occurrences scores floor(1000 a n / (l r)), n being the
number of words of its language; its lowest cut counts. A candidate goes if a longer one that holds it
occurs as often; such a longer one may be taken as longer by one word, since all between them occur as
often too.

Counting, shortest phrases first. A phrase is frequent only if both phrases that are shorter by one
word are, so phrases of m words are counted only where both are marked in a table of bits. The table has a
fixed size; a bit that is set by another phrase only lets more phrases be counted, and counts are exact.
From 3 words on, only the stretches of text whose word pairs are all marked are read.

Streams. Frequent phrases are kept in two orders: by their words from the first on, and from the
last on. In the first order all beginnings of a phrase come before it, with nothing
but their own continuations between, so one pass with a stack of the current beginnings gives each phrase the
counts of its beginnings, and each beginning those of its extensions by a word. The second order does
so for endings. Each stream is sorted over ranges (a range also gets the beginnings of its first phrase), and
both are joined in lockstep by Spark's merge join. There are no tables by hash.

Defined cases: null and empty texts have no words; a null lang is `und`. Ties of score go by occurrences and then
by the bytes of the phrase. Repeated rows count as often as they stand there. Very long texts are read
in pieces of about `CHUNK` bytes. An empty table has no phrases. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasebook.llm import words as W
from leasebook.llm.common import bit_table, map_rows, stage

LONGEST = 5
LEAST = 100
TOP = 2000
TABLE_BITS = 1 << 26
CHUNK = 1 << 21

# Blanks as spaces, ends of pieces as line feeds, A-Z as a-z.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else W.LOWER[b] for b in range(256))
_WORD = W.byte_class(b for b in range(256) if b not in (10, 32))


def chunks(batch: dict[str, list], least: int) -> Iterator[tuple[str, bytes]]:
    """Texts of one language put together, or parts of a long one, of about `least` bytes; cut at ends of pieces."""
    held: dict[str, list[bytes]] = {}
    size: Counter[str] = Counter()
    for lang, raw in zip(batch["lang"], batch["raw"]):
        at = 0
        while raw and at < len(raw):
            end = len(raw) if len(raw) - at <= least else raw.find(b"\n", at + least)
            end = len(raw) if end < 0 else end
            held.setdefault(lang, []).append(raw[at:end])
            size[lang] += end - at
            at = end + 1
            if size[lang] >= least:
                yield lang, b"\n".join(held.pop(lang))
                del size[lang]
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


class Words:
    """Words of a chunk: where they are, their pieces, and the hashes of their runs."""

    def __init__(self, lang: str, raw: bytes):
        self.raw, self.salt = raw, np.uint64(hash_of(lang.encode()))
        self.starts, self.ends = W.spans(raw, _WORD)
        self.hashes = W.word_hashes(raw, self.starts, self.ends)
        self.pieces = np.cumsum(np.frombuffer(raw, np.uint8) == 10)[self.starts] if len(self.starts) else self.starts

    def whole(self, n: int) -> np.ndarray:
        """For each word, whether n words from it on are in one piece."""
        return self.pieces[n - 1:] == self.pieces[: len(self.pieces) - n + 1]

    def slots(self, n: int, bits: int) -> np.ndarray:
        return (W.mix(W.gram_hashes(self.hashes, n) ^ self.salt) % np.uint64(bits)).astype(np.int64)

    def marked(self, n: int, table: bytes) -> np.ndarray:
        """For each word, whether the n words from it on are one piece's and marked."""
        bits = np.frombuffer(table, np.uint8)
        at = self.slots(n, 8 * len(bits))
        return self.whole(n)[: len(at)] & ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def hash_of(word: bytes) -> int:
    return int(W.word_hashes(word, np.array([0]), np.array([len(word)]))[0]) if word else 0


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _words(texts: DataFrame) -> DataFrame:
    chunk = CHUNK

    def count(batch: dict[str, list]) -> Iterator[tuple]:
        for lang, raw in chunks(batch, chunk):
            for word, n in Counter(raw.split()).items():
                yield lang, word.decode(), n

    return _summed(map_rows(texts, count, "lang string, phrase string, n long"))


def _phrases(texts: DataFrame, n: int, table) -> DataFrame:
    """Counts of the phrases of n words whose parts of n - 1 words are both marked."""
    chunk = CHUNK

    def count(batch: dict[str, list]) -> Iterator[tuple]:
        for lang, raw in chunks(batch, chunk):
            w = Words(lang, raw)
            if len(w.starts) < n:
                continue
            parts = w.marked(n - 1, table.value)
            found = np.flatnonzero(parts[:-1] & parts[1:] & w.whole(n))
            # Words may be apart by several blanks, or by what stood between them.
            phrases = (w.raw[a:b] for a, b in zip(w.starts[found].tolist(), w.ends[found + n - 1].tolist()))
            counted = Counter(phrases)
            total: Counter[bytes] = Counter()
            for phrase, k in counted.items():
                total[b" ".join(phrase.split()) if b"  " in phrase else phrase] += k
            for phrase, k in total.items():
                yield lang, phrase.decode(), k

    return _summed(map_rows(texts, count, "lang string, phrase string, n long"))


def _narrowed(texts: DataFrame, table) -> DataFrame:
    """Texts cut between words that are no marked pair, without the words that are left alone."""
    chunk = CHUNK

    def cut(batch: dict[str, list]) -> Iterator[tuple]:
        for lang, raw in chunks(batch, chunk):
            w = Words(lang, raw)
            if len(w.starts) < 3:
                continue
            pair = w.marked(2, table.value)
            out = np.frombuffer(raw, np.uint8).copy()
            out[w.starts[1:][~pair] - 1] = 10
            alone = ~(np.append(pair, False) | np.append(False, pair))
            step = np.zeros(len(out) + 1, np.int8)
            step[w.starts[alone]] += 1
            step[w.ends[alone]] -= 1
            out[np.cumsum(step[:-1], dtype=np.int8).astype(bool)] = 10
            left = re.sub(rb"[ \n]*\n[ \n]*", b"\n", out.tobytes()).strip()
            if left:
                yield lang, left

    return stage(map_rows(texts, cut, "lang string, raw binary", flush=4))


def _table(frequent: DataFrame):
    """Bits of frequent phrases, handed to all tasks."""
    size = TABLE_BITS

    def slot(batch: dict[str, list]) -> Iterator[tuple]:
        for lang, phrase in zip(batch["lang"], batch["phrase"]):
            raw = phrase.encode()
            w = Words(lang, raw)
            yield (int(w.slots(len(w.starts), size)[0]),)

    return bit_table(map_rows(frequent.select("lang", "phrase"), slot, "slot long"), size)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m, f) of phrases of 1 to LONGEST words with f >= least, (lang, n) with all words counted)."""
    def plain(batch: dict[str, list]) -> Iterator[tuple]:
        for lang, raw in zip(batch["lang"], batch["raw"]):
            yield lang, raw.translate(_PLAIN)

    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("raw"))
    texts = map_rows(source.where("raw IS NOT NULL"), plain, "lang string, raw binary", flush=256)
    words = stage(_words(texts))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [stage(words.where(F.col("f") >= least))]
    for n in range(2, LONGEST + 1):
        table = _table(levels[-1])
        if n == 3:
            texts = _narrowed(texts, table)
        levels.append(stage(_phrases(texts, n, table).where(F.col("f") >= least)))
    found = None
    for n, level in enumerate(levels, 1):
        rows = level.select("lang", "phrase", F.lit(n).alias("m"), "f")
        found = rows if found is None else found.unionByName(rows)
    return found, total


def stream(phrases: DataFrame) -> DataFrame:
    """Per phrase (lang, words, f): `before`, the counts of its beginnings from one word on, and `extended`.

    `extended` rows stand for themselves, with null `before`: a phrase that an extension by a word equals in count.
    """
    dealt = phrases.select("lang", "words", "f").repartitionByRange("lang", "words")
    ranged = stage(dealt.withColumn("part", F.spark_partition_id()))
    # One phrase a range, and its beginnings: at most LONGEST - 1 rows for each shuffle partition.
    heads = ranged.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("head")).where(F.size("head.words") > 1).select(
        "part", F.col("head.lang").alias("lang"),
        F.explode(F.expr("transform(sequence(1, size(head.words) - 1), k -> slice(head.words, 1, k))")).alias("words"))
    carried = ranged.drop("part").join(F.broadcast(heads), ["lang", "words"]).select("lang", "words", "f", "part", F.lit(True).alias("carried"))
    both = ranged.withColumn("carried", F.lit(False)).unionByName(carried)
    ordered = both.repartition("part").sortWithinPartitions("part", "lang", "words")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, stack = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = row["words"]
                if place != (row["part"], row["lang"]):
                    place, stack = (row["part"], row["lang"]), []
                while stack and stack[-1][0] != words[: len(stack)]:
                    stack.pop()
                if not row["carried"]:
                    if stack and stack[-1][1] == row["f"]:
                        out.append({"lang": row["lang"], "words": stack[-1][0], "f": row["f"], "before": None, "extended": True})
                    out.append({"lang": row["lang"], "words": words, "f": row["f"], "before": [f for _, f in stack], "extended": False})
                stack.append((words, row["f"]))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("before", pa.list_(pa.int64())), ("extended", pa.bool_())])
    return stage(ordered.mapInArrow(walk, "lang string, words array<string>, f long, before array<long>, extended boolean"))


def _cut(k: Column) -> Column:
    """Score and place of the cut after k words, whose parts have l and r occurrences."""
    l, r = F.get("befores", k - 1), F.get("afters", F.col("m") - k - 1)
    wide = lambda c: c.cast("decimal(20,0)")
    product = F.lit(1000).cast("decimal(4,0)") * wide(F.col("f")) * wide(F.col("n"))
    score = F.call_function("div", product, wide(l) * wide(r))
    return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))


def scored(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All candidates that stay: lang, phrase, a, l, r, n, score."""
    found, total = frequent_phrases(docs, least)
    found = found.withColumn("words", F.split("phrase", " "))
    first = stream(found)
    last = stream(found.withColumn("words", F.reverse("words"))).withColumn("words", F.reverse("words"))
    marks = first.where("extended").unionByName(last.where("extended")).select("lang", "words").distinct()
    beginnings = first.where(~F.col("extended") & (F.size("words") > 1)).select("lang", "words", "f", F.col("before").alias("befores"))
    endings = last.where(~F.col("extended") & (F.size("words") > 1)).select("lang", "words", F.col("before").alias("afters"))
    merged = beginnings.hint("merge").join(endings, ["lang", "words"]).join(marks.hint("merge"), ["lang", "words"], "left_anti")
    rows = merged.join(total, "lang").withColumn("m", F.size("words"))  # total: one row a language
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.col("m") - 1), _cut))
    return rows.withColumn("best", best).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    # Spark keeps `top` rows a language per task before it shuffles.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(docs, least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
