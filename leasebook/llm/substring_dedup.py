"""Removal of word sequences that already occurred: seeds from winnowing, extended both ways.

A window is `min_words` consecutive words. A word goes if some window over it starts with the
same words earlier: in a smaller doc_id, or before in the same document. Windows are judged on
the input, not on what is left.

1. Each window of `min_words` words selects its smallest `seed_words`-gram, so a repeated window
   has a repeated seed. Only about one seed in seven words is compared across documents.
2. Seeds that occur once in the corpus end here. Around the others both sides are extended to
   every window that selected the seed; windows carry 96 bits of two independent hashes.
3. The first place of each window is a grouped minimum, which is summed before the shuffle. The
   other places are the repeats; overlapping ones form the maximal repeats of a document. Places
   of a frequent window or seed are spread over several tasks, each with a copy of the other side's row.

Documents whose whole word sequence occurred before need no seeds: all their words go. So groups
of copies, however large, cost one row a document. Nothing is sampled or capped.

Defined cases: null and empty texts have no words. Texts under `min_words` words keep all. A null
doc_id counts as the smallest id. Repeated equal rows (same id and text) are one document. A very
long text is one row of one task. Empty tables give empty results. Other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.llm import words as W
from leasebook.llm.common import KEY, join_spread, keyed, map_rows, stage

MIN_WORDS = 20
SEED_WORDS = 8


def _hashes(raw: bytes, lane: int) -> np.ndarray:
    starts, ends = W.spans(raw, W.NOT_BLANK)
    return W.word_hashes(raw, starts, ends, lane)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """Rows (id, th, whole, starts): windows of a document that occurred before.

    `whole` says that its entire word sequence did; else `starts` lists the first words of the
    repeated windows. Documents without repeats have no row.
    """
    span = min_words - seed_words + 1

    def seeds(batch: dict[str, list]) -> Iterator[tuple]:
        for id_, th, raw in zip(batch["id"], batch["th"], batch["raw"]):
            h = _hashes(raw, 0)
            if len(h) < min_words:
                continue
            whole = [W.signed(W.gram_hashes(x, len(x), lane))[0] for lane, x in ((0, h), (1, _hashes(raw, 1)))]
            grams = W.gram_hashes(h, seed_words)
            places = np.unique(W.anchors(grams, span))
            yield id_, th, int(whole[0]), int(whole[1]), W.signed(grams[places]).tolist(), places.astype(np.int32).tolist()

    rows = keyed(docs).select(*KEY, F.col("text").cast("binary").alias("raw")).where("raw IS NOT NULL")
    sketch = stage(map_rows(rows, seeds, "id long, th long, s1 long, s2 long, seeds array<long>, places array<int>"))
    first = sketch.groupBy("s1", "s2").agg(F.min(F.struct(*KEY)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = sketch.select(*KEY, "s1", "s2").join(first, ["s1", "s2"]).where("id > first.id").select(*KEY).distinct()
    later = stage(later)
    occurrence = (
        sketch.select(*KEY, "seeds", "places").join(later, KEY, "left_anti").dropDuplicates(KEY)
        .select(*KEY, F.explode(F.arrays_zip("seeds", "places")).alias("x"))
        .select(F.col("x.seeds").alias("seed"), *KEY, F.col("x.places").alias("place"))
    )
    repeated = stage(occurrence.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    places = stage(join_spread(occurrence, repeated, ["seed"]).groupBy(*KEY).agg(F.collect_list("place").alias("places")))

    def extended(batch: dict[str, list]) -> Iterator[tuple]:
        for id_, th, raw, near in zip(batch["id"], batch["th"], batch["raw"], batch["places"]):
            h = _hashes(raw, 0)
            chosen = W.anchors(W.gram_hashes(h, seed_words), span)
            starts = np.flatnonzero(np.isin(chosen, np.asarray(near)))
            w1 = W.signed(W.gram_hashes(h, min_words))[starts]
            w2 = (W.gram_hashes(_hashes(raw, 1), min_words, 1)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield id_, th, w1.tolist(), w2.tolist(), starts.astype(np.int32).tolist()

    windows = stage(
        map_rows(rows.join(places, KEY), extended, "id long, th long, w1 array<long>, w2 array<int>, starts array<int>", 64)
        .select(*KEY, F.explode(F.arrays_zip("w1", "w2", "starts")).alias("x"))
        .select(F.col("x.w1").alias("w1"), F.col("x.w2").alias("w2"), *KEY, F.col("x.starts").alias("start"))
    )
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = join_spread(windows, stage(first.where("n > 1")), ["w1", "w2"]).where("struct(id, start) > first")
    return stage(
        again.groupBy(*KEY).agg(F.collect_set("start").alias("starts")).withColumn("whole", F.lit(False))
        .unionByName(later.withColumns({"starts": F.expr("cast(array() AS array<int>)"), "whole": F.lit(True)}))
    )


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed and `kept`, the words left, joined by one space (UTF-8 bytes)."""

    def cut(batch: dict[str, list]) -> Iterator[tuple]:
        for doc_id, raw, whole, starts in zip(batch["doc_id"], batch["raw"], batch["whole"], batch["starts"]):
            word = (raw or b"").translate(_AS_BLANK).split(b" ") if raw else []
            word = [w for w in word if w]
            covered = np.zeros(len(word) + 1, np.int32)
            if whole:
                covered[0] = 1
            elif starts is not None:
                at = np.unique(np.asarray(starts, np.int64))
                covered[at] += 1
                np.subtract.at(covered, at + min_words, 1)
            gone = np.cumsum(covered[: len(word)]) > 0
            yield doc_id, len(word), int(gone.sum()), b" ".join(w for w, g in zip(word, gone.tolist()) if not g)

    rows = keyed(docs).select("doc_id", *KEY, F.col("text").cast("binary").alias("raw"))
    joined = rows.join(repeats(docs, min_words, seed_words), KEY, "left").select("doc_id", "raw", "whole", "starts")
    return map_rows(joined, cut, "doc_id long, n_words long, n_removed long, kept binary")


# Blanks that end a word, all made the same one.
_AS_BLANK = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
