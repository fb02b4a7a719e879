"""Benchmark passages in documents, by winnowed fingerprints that are joined and extended.

A window is `window` consecutive words of an item (or all words of a shorter one). A document
word inside any occurrence of a window is hit.

1. Every window of an item and of a document selects its smallest `gram`-gram hash as its
   fingerprint; equal windows select alike, so every shared window shares a fingerprint. Items of
   fewer than `window` words are their own fingerprint.
2. Documents are matched against the fingerprints first through a bit table of fixed size
   (`TABLE_BITS`): its size does not grow with the benchmark, it only lets more rows through.
3. Each match is extended to the windows around it; these are joined with the items' windows on
   128 bits. Places of a frequent window are spread over several tasks.
4. A window names the set of item classes that hold it by 128 bits (a class is the items of equal
   words), and a document its set of such sets. Items are listed once for each distinct set of
   sets, so documents that share a passage with many items do not multiply rows.

Defined cases: null texts, and texts without letters or digits, have no words and no hits. Null
item ids are left out. Repeated rows of items count once per item id, repeated documents each get
their result. A very long text is one row of one task. Empty tables give no hits; other columns
are left behind (`clean` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.llm import words as W
from leasebook.llm.common import KEY, join_spread, keyed, map_rows, stage, unwrapped, wrapped

WINDOW = 10
GRAM = 5
TABLE_BITS = 1 << 23


def _words(raw: bytes, lane: int) -> np.ndarray:
    return W.word_hashes(raw, *W.spans(raw, W.ALPHANUMERIC), lane)


def _windows(raw: bytes, lanes: list[np.ndarray], size: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Fingerprint and two hashes of every run of `size` words (one as long as a short item, or `window`)."""
    h1, h2 = (W.gram_hashes(h, size, lane) for lane, h in enumerate(lanes))
    if size < window:
        return h1, h1, h2
    grams = W.gram_hashes(lanes[0], gram)
    return grams[W.anchors(grams, window - gram + 1)], h1, h2


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, id, th, n_words), hits (id, th, start, size, s1, s2) and members (s1, s2, item_id).

    (s1, s2) names the set of items in which the hit's window occurs.
    """

    def item_windows(batch: dict[str, list]) -> Iterator[tuple]:
        for item, raw in zip(batch["item_id"], batch["raw"]):
            raw = raw.translate(W.LOWER)
            lanes = [_words(raw, 0), _words(raw, 1)]
            n = len(lanes[0])
            if n:
                size = min(n, window)
                c1, c2 = (int(W.signed(W.gram_hashes(h, n, lane))[0]) for lane, h in enumerate(lanes))
                marks, h1, h2 = (W.signed(x).tolist() for x in _windows(raw, lanes, size, window, gram))
                yield item, c1, c2, size, marks, h1, h2

    source = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("raw"))
    held = stage(map_rows(
        source.where("item_id IS NOT NULL AND raw IS NOT NULL"), item_windows,
        "item_id string, c1 long, c2 long, size int, marks array<long>, h1 array<long>, h2 array<long>"))
    one = held.groupBy("c1", "c2").agg(F.min("item_id").alias("item_id"))
    windows = (
        held.join(one, ["c1", "c2", "item_id"]).dropDuplicates(["c1", "c2"])
        .select("c1", "c2", "size", F.explode(F.arrays_zip("h1", "h2")).alias("x"))
        .select("x.h1", "x.h2", "size", "c1", "c2").distinct()
    )
    named = stage(windows.groupBy("h1", "h2", "size").agg(*_set_name("c1", "c2")))
    shown = named.groupBy("s1", "s2").agg(F.min(F.struct("h1", "h2", "size")).alias("w")).select("s1", "s2", "w.*")
    members = (
        windows.join(shown, ["h1", "h2", "size"]).select("s1", "s2", "c1", "c2")
        .join(held.select("c1", "c2", "item_id").distinct(), ["c1", "c2"]).select("s1", "s2", "item_id")
    )
    slot = F.pmod("mark", F.lit(TABLE_BITS))
    bits = (
        held.select(F.explode("marks").alias("mark")).select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 AS int))")).alias("bits"))
    )
    table = np.zeros(TABLE_BITS >> 5, np.uint32)
    for row in bits.toLocalIterator():  # at most TABLE_BITS / 32 rows, whatever the benchmark's size
        table[row["word"]] = row["bits"]
    sizes = sorted(r["size"] for r in held.select("size").distinct().toLocalIterator())  # at most `window` values
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def document_windows(batch: dict[str, list]) -> Iterator[tuple]:
        known = np.frombuffer(shared.value, np.uint32)
        for doc_id, id_, th, raw in zip(batch["doc_id"], batch["id"], batch["th"], batch["raw"]):
            raw = (raw or b"").translate(W.LOWER)
            lanes = [_words(raw, 0)]
            found: tuple[list, ...] = ([], [], [], [])
            for size in sizes:
                marks = W.gram_hashes(lanes[0], size if size < window else gram)
                if size >= window:
                    marks = marks[W.anchors(marks, window - gram + 1)]
                at = (marks % np.uint64(TABLE_BITS)).astype(np.int64)
                starts = np.flatnonzero((known[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1))
                if len(starts):
                    if len(lanes) == 1:
                        lanes.append(_words(raw, 1))
                    for to, x in zip(found, (
                        W.signed(W.gram_hashes(lanes[0], size))[starts].tolist(),
                        W.signed(W.gram_hashes(lanes[1], size, 1))[starts].tolist(),
                        [size] * len(starts), starts.astype(np.int32).tolist(),
                    )):
                        to.extend(x)
            yield doc_id, id_, th, len(lanes[0]), *found

    rows = keyed(docs).select("doc_id", *KEY, F.col("text").cast("binary").alias("raw"))
    looked = stage(map_rows(
        rows, document_windows,
        "doc_id long, id long, th long, n_words long, h1 array<long>, h2 array<long>, size array<int>, start array<int>"))
    window_key = ["h1", "h2", "size"]
    places = (
        looked.select(*KEY, F.explode(F.arrays_zip("h1", "h2", "size", "start")).alias("x"))
        .select(*KEY, "x.h1", "x.h2", "x.size", "x.start")
    )
    met = stage(places.groupBy(*window_key).agg(F.count(F.lit(1)).alias("n")).join(named, window_key))
    hits = join_spread(places, met, window_key)
    return looked.select("doc_id", *KEY, "n_words"), stage(hits.select(*KEY, "start", "size", "s1", "s2")), members


def _set_name(a: str, b: str) -> list:
    """128 bits for the set of distinct pairs (a, b) of a group, combined map-side and in any order."""
    return [F.bit_xor(F.xxhash64(a, b)).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), b, a)).alias("s2")]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of `docs`: doc_id, id, th, n_words, n_hit, spans (first word and count of each hit stretch), items."""
    looked, hits, members = find(docs, items, window, gram)
    # Stretches of one document: its hit windows, sorted, merged where they touch.
    merged = F.aggregate(
        F.sort_array("windows"),
        F.expr("named_struct('n', 0, 'until', 0)"),
        lambda a, w: F.struct(
            (a["n"] + F.greatest(F.lit(0), w["start"] + w["size"] - F.greatest(w["start"], a["until"]))).alias("n"),
            F.greatest(a["until"], w["start"] + w["size"]).alias("until")),
        lambda a: a["n"],
    )
    words = hits.groupBy(*KEY).agg(F.collect_set(F.struct("start", "size")).alias("windows"))
    sets = stage(hits.select(*KEY, "s1", "s2").distinct())
    known_by = stage(sets.groupBy(*KEY).agg(*[c.alias(n) for c, n in zip(_set_name("s1", "s2"), ("t1", "t2"))]))
    shown = known_by.groupBy("t1", "t2").agg(F.min(F.struct(*KEY)).alias("x")).select("t1", "t2", "x.*")
    listed = (
        sets.join(shown, KEY).select("t1", "t2", "s1", "s2").join(members, ["s1", "s2"])
        .groupBy("t1", "t2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    return (
        looked.join(words, KEY, "left").join(known_by.join(listed, ["t1", "t2"]), KEY, "left")
        .select("doc_id", *KEY, "n_words", F.coalesce(merged, F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("windows", F.expr("array()")).alias("windows"),
                F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"))
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`docs` without the rows in which an item's window occurs."""
    hit = find(docs, items, window, gram)[1].select(*KEY).distinct()
    return unwrapped(wrapped(docs).join(hit, KEY, "left_anti"), docs.columns)
