"""Near-duplicate groups by SimHash, with combinations of equal blocks of bits as index.

A document's fingerprint has 64 bits; a bit is set if it is set in over half the 64-bit hashes of
the document's word shingles, repeats included. Two fingerprints that differ in at most `distance`
bits are linked; groups are the connected documents.

1. Documents of equal fingerprints are one node, so exact copies never meet as pairs.
2. 64 bits are cut into distance + 3 blocks. Of `distance` differing bits, at least three blocks hold none. Each
   fingerprint is indexed under every three of its blocks (35 keys of some 27 bits). Nodes that share a key meet by equality.
3. A pair that met is verified on the whole fingerprints.

Groups need connections, not all pairs. Each key's nodes are first compared with its smallest
and its largest fingerprint only, and each node keeps one such link. Then the keys whose nodes are still in several
groups are taken up again, and a pair is compared only across groups; one link is kept for each two groups. A key of
more than `CROWD` nodes is first cut once more: two of its nodes differ in at most `distance` of the
bits outside the key's blocks, which are cut and indexed in the same way, and each node is compared with the extremes
again. In what is left only nodes outside the most
frequent group look for partners, dealt over blocks of about `CROWD` nodes. Every link between groups is found; nothing
is capped. Labels of groups are joined to nodes and then indexed, so no join has more rows than there are nodes but
those of keys that several groups share. The rows of shared keys are joined with their keys three times in all: for the
extremes, for the groups and for the most frequent group.

Defined cases: null and empty texts, and texts of blanks, have the fingerprint zero, which is linked like any
other. A text of fewer words than a shingle is one shingle. Very long texts are hashed in pieces, so
memory does not grow with their shingles. A null doc_id counts as the smallest id and shows as a null
component_id. Repeated rows, and rows that share a doc_id, are documents of their own with equal
fingerprints for equal texts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.llm.common import SMALLEST_ID, map_rows, stage
from leasebook.llm.components import connected

SHINGLE_WORDS = 4
DISTANCE = 4
SHARED = 3
SEED = 42
CROWD = 256
# Shingles hashed at a time.
PIECE = 1 << 15


def fingerprint(raw: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a UTF-8 text, as an unsigned integer."""
    words = raw.lower().split()  # bytes: A-Z only, and blanks are 0x20 and 0x09 to 0x0D
    n = max(len(words) - shingle_words + 1, min(len(words), 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        hashed = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i: i + shingle_words]), SEED) for i in range(at, min(at + PIECE, n))), "<u8")
        counts += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of `docs`: doc_id, id, fp (the fingerprint's bits as a long)."""

    def rows(batch: dict[str, list]) -> Iterator[tuple]:
        for doc_id, raw in zip(batch["doc_id"], batch["raw"]):
            fp = fingerprint(raw or b"", shingle_words)
            yield doc_id, fp - (fp >> 63 << 64)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return map_rows(source, rows, "doc_id long, fp long").select(
        "doc_id", F.coalesce("doc_id", F.lit(SMALLEST_ID)).alias("id"), "fp")


def _masks(bits: list[int], distance: int) -> list[int]:
    """Masks of `bits`, one of which two fingerprints share that differ in at most `distance` of these bits.

    The bits are cut into `distance` + SHARED blocks, of which SHARED at least are equal; a mask holds SHARED blocks.
    """
    parts = distance + SHARED
    blocks = [bits[len(bits) * k // parts: len(bits) * (k + 1) // parts] for k in range(parts)]
    return [sum(1 << b for block in some for b in block) for some in combinations(blocks, SHARED)]


def _longs(values: list[int]) -> str:
    return f"array({', '.join(f'CAST({v - (v >> 63 << 64)} AS BIGINT)' for v in values)})"


def _keys(masks: Column) -> Column:
    """One long per mask: the mask and the fingerprint's bits in it."""
    return F.transform(masks, lambda m: F.xxhash64(m, F.col("fp").bitwiseAND(m)))


def _close(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _open(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (fp, label and `by`) of buckets whose nodes are in several groups, with the bucket's size."""
    buckets = rows.groupBy(*by).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    return stage(rows.join(stage(buckets.where("low < high").drop("low", "high")), by))


def _to_hubs(rows: DataFrame, by: list[str], distance: int) -> DataFrame:
    """Links (a, b) between each node and the smallest of its buckets' extreme fingerprints that is near."""
    buckets = rows.groupBy(*by).agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    ends = rows.join(stage(buckets.where("low < high")), by).select("fp", F.explode(F.array("low", "high")).alias("hub")).where("fp <> hub")
    near = ends.where(_close(F.col("fp"), F.col("hub"), distance))
    return stage(near.groupBy("fp").agg(F.min("hub").alias("hub")).select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")))


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` with the label of each node's group."""
    labels = connected(found).withColumnRenamed("node", "fp")
    return stage(rows.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))


def _across(opened: DataFrame, by: list[str], distance: int) -> DataFrame:
    """Links between all groups that have near nodes in a bucket of `opened`, one for each two groups."""
    held = opened.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("held"))
    main = held.groupBy(*by).agg(F.max_by("label", F.struct("held", "label")).alias("main"))
    rows = stage(opened.join(main, by))
    blocks = F.ceil(F.col("n") / CROWD).cast("int")
    x = rows.where("label <> main").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("x")
    y = rows.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).alias("y")
    meet = F.expr(" AND ".join(f"x.{c} = y.{c}" for c in [*by, "block"]) + " AND x.label <> y.label AND (x.fp < y.fp OR y.label = x.main)")
    pairs = x.join(y, meet & _close(F.col("x.fp"), F.col("y.fp"), distance))
    return pairs.select(F.least("x.label", "y.label").alias("a"), F.greatest("x.label", "y.label").alias("b")).distinct()


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints `fp` as all pairs within `distance` would.

    A link stands for its two nodes or for the groups that links before it have made of them.
    """
    nodes = nodes.select("fp")
    masks = _masks(list(range(64)), distance)
    # A key's mask is told by its place in the array. Labels meet nodes, not the rows of their keys.
    outer = lambda rows: rows.select("*", F.posexplode(_keys(F.expr(_longs(masks)))).alias("mask", "key"))
    found = _to_hubs(outer(nodes), ["key"], distance)
    opened = _open(outer(_labelled(nodes, found)), ["key"])
    found = stage(found.unionByName(_across(opened.where(F.col("n") <= CROWD), ["key"], distance)))

    crowded = opened.where(F.col("n") > CROWD).select("fp", "mask", "key")
    if crowded.isEmpty():
        return found
    rest = [_masks([b for b in range(64) if not m >> b & 1], distance) for m in masks]
    inner_masks = F.get(F.expr(f"array({', '.join(map(_longs, rest))})"), F.col("mask"))
    inner = lambda rows: rows.withColumn("inner", F.explode(_keys(inner_masks)))
    by = ["key", "inner"]
    found = stage(found.unionByName(_to_hubs(inner(crowded), by, distance)))
    return stage(found.unionByName(_across(_open(inner(_labelled(crowded, found)), by), by, distance)))


def groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id of its group)."""
    rows = stage(fingerprints(docs, shingle_words))
    nodes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    labels = connected(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    placed = nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    placed = stage(placed)
    first = placed.groupBy("label").agg(F.min("least").alias("first"))
    known = placed.join(first, "label").select("fp", "first")
    return rows.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("first") != SMALLEST_ID, F.col("first")).alias("component_id"))
