"""Near-duplicate groups: banded MinHash, sequential Bayesian verification, exact confirmation.

A document's set holds its distinct `shingle_words`-word shingles (A-Z lower-cased, words split
at blanks; a text of fewer words is one shingle). Two documents are linked when the Jaccard
similarity of their sets is at least `threshold`; groups are the connected documents.

1. Documents with equal sets are one node, so exact copies never meet as pairs.
2. Nodes that share a band of their signatures are candidates.
3. A candidate pair's signatures are compared in batches of 32. After each batch the pair goes if
   the posterior probability of reaching the threshold (uniform prior) is under `miss`.
4. What survives is confirmed on the full sets.

Groups need connections, not all pairs. So pairs are drawn in rounds, and a pair is drawn only
if earlier rounds left its nodes in different groups: first every node with the one hub (smallest
id in its bucket) that it meets most often, then with all its hubs, then nodes that still meet
across groups, less those whose rarest shingles rule a link out (`across_groups`). The last round
is complete, so no link between groups is lost beyond the chance of banding
((1 - 0.8^4)^32 = 5e-8 a pair) and `miss`.

A node is a set, named by a 64-bit hash of its two 64-bit keys; no doc_id takes part in it.

Defined cases: null and empty texts have no shingles and stand alone. A null doc_id counts as the
smallest id. Rows that share a doc_id (or have none) and differ in text are documents of their own;
each is linked by its own text, and a group's first row is that of the smallest (doc_id, hash of
text). Rows that repeat doc_id and text are one document and get equal results. Groups whose
smallest doc_id is the same show the same component_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.llm import words as W
from leasebook.llm.common import SMALLEST_ID, keyed, map_rows, stage, unwrapped, wrapped
from leasebook.llm.components import connected

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
BATCH = 32
MISS = 1e-7

_SLOTS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
_FACTORS = W.mix(_SLOTS) | np.uint64(1)
_SHIFTS = W.mix(_SLOTS + np.uint64(1 << 32))


def shingles(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text."""
    raw = raw.translate(W.LOWER)
    h = W.word_hashes(raw, *W.spans(raw, W.NOT_BLANK))
    return np.unique(W.gram_hashes(h, min(n, len(h)))) if len(h) else h


def signature(members: np.ndarray) -> np.ndarray:
    out = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(members), 4096):
        hashed = (members[at: at + 4096, None] * _FACTORS + _SHIFTS) >> np.uint64(32)
        np.minimum(out, hashed.min(axis=0).astype(np.uint32), out=out)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    out = np.zeros((len(signatures), BANDS), np.uint64)
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        out = W.mix(out * np.uint64(W.BASES[0]) + parts[:, :, r] + np.uint64(1))
    return W.mix(out + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(W.BASES[1]))


def fewest_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest equal values among n for which P(similarity >= threshold) is at least `miss`.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its upper tail at t is the
    probability of at most m successes in n + 1 trials of chance t.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, shingle_words: int, threshold: float, miss: float) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are similar enough."""
    least = [(n, fewest_matches(n, threshold, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]
    share = round(threshold * 100)

    def likely(batch: dict[str, list]) -> Iterator[tuple]:
        if not batch["a"]:
            return
        x, y = (np.frombuffer(b"".join(batch[c]), np.uint32).reshape(len(batch[c]), -1) for c in ("sig_a", "sig_b"))
        left, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
        for n, fewest in least:
            matches[left] += (x[left, n - BATCH: n] == y[left, n - BATCH: n]).sum(axis=1)
            left = left[matches[left] >= fewest]
        for i in left.tolist():
            yield batch["a"][i], batch["b"][i]

    def similar(batch: dict[str, list]) -> Iterator[tuple]:
        last, sets = None, (None, None)
        for a, b, x, y in zip(batch["a"], batch["b"], batch["raw_a"], batch["raw_b"]):
            if last != a:
                last, sets = a, shingles(x, shingle_words)
            other = shingles(y, shingle_words)
            both = len(np.intersect1d(sets, other, assume_unique=True))
            if 100 * both >= share * (len(sets) + len(other) - both):
                yield a, b

    def sides(frame: DataFrame, values: DataFrame, value: str) -> DataFrame:
        for side in ("a", "b"):
            frame = frame.join(values.select(F.col("node").alias(side), F.col(value).alias(f"{value}_{side}")), side)
        return frame.select("a", "b", f"{value}_a", f"{value}_b")

    near = map_rows(sides(pairs, sketches, "sig"), likely, "a long, b long")
    return stage(map_rows(sides(near, texts, "raw"), similar, "a long, b long").distinct())


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets whose nodes are in more than one group, with each node's group `label`."""
    placed = members.join(labels, "node", "left").select("bucket", "hub", "node", "n", F.coalesce("label", "node").alias("label"))
    several = placed.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    return stage(placed.join(several.select("bucket"), "bucket"))


def across_groups(placed: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, n, label) in different groups that can still reach the threshold.

    No such pair is missed: in an order of shingles from rare to frequent, let i and j be the places
    of the first shingle that two sets of n and m share. Then at most min(n - i, m - j) are shared.
    So the smaller set has its first common shingle among the first n - ceil(2t / (1 + t) n) + 1, the
    larger among the first m - ceil(t m) + 1. In a group of near copies whose members differ by
    shingles of their own, these fill the first places, and members too far from the rest drop out
    here, one by one, without being compared with all others. Of two nodes in different groups one
    is outside the group that holds most nodes under their shingle; only such nodes look for partners.
    """
    def exploded(batch: dict[str, list]) -> Iterator[tuple]:
        for node, label, raw in zip(batch["node"], batch["label"], batch["raw"]):
            own = shingles(raw, shingle_words)
            yield node, label, len(own), W.signed(own).tolist()

    sets = map_rows(placed.join(texts, "node").select("node", "label", "raw"), exploded, "node long, label long, n long, s array<long>", 64)
    held = stage(sets)
    rows = held.select(F.explode("s").alias("shingle"), "node")
    known = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    # Shingles of one set only come first in the order; their number is enough.
    shared = rows.join(known, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("shared"))
    prefix = (
        shared.join(held.select("node", "label", "n"), "node")
        .select("node", "label", "n", (F.col("n") - F.size("shared")).alias("own"),
                F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.size("shared") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))).alias("at", "x"))
        .select(F.col("x.shingle").alias("shingle"), "node", "label", "n", (F.col("own") + F.col("at")).alias("pos"))
    )
    prefix = stage(prefix)
    sizes = prefix.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("shingle").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    seeking = prefix.join(main, "shingle").where("label <> main")
    need = f"ceil((x.n + y.n) * {percent} / {100 + percent})"
    meet = F.expr(
        f"x.shingle = y.shingle AND x.label <> y.label AND (x.node < y.node OR y.label = x.main) AND least(x.n - x.pos, y.n - y.pos) >= {need}")
    pairs = seeking.alias("x").join(prefix.alias("y"), meet)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _grouped(docs: DataFrame, shingle_words: int, threshold: float, miss: float) -> DataFrame:
    """Per row of `docs`: doc_id, id, th, n and `first`, the smallest (id, th) of its group."""

    def sketch(batch: dict[str, list]) -> Iterator[tuple]:
        for doc_id, id_, th, raw in zip(batch["doc_id"], batch["id"], batch["th"], batch["raw"]):
            members = shingles(raw or b"", shingle_words)
            if len(members):
                k1, k2 = (int(W.signed(W.gram_hashes(members, len(members), lane))[0]) for lane in (0, 1))
                yield doc_id, id_, th, len(members), k1, k2, signature(members).tobytes()
            else:
                yield doc_id, id_, th, 0, None, None, None

    rows = keyed(docs).select("doc_id", "id", _text_hash("text"), F.col("text").cast("binary").alias("raw"))
    sketches = stage(map_rows(rows, sketch, "doc_id long, id long, th long, n long, k1 long, k2 long, sig binary").select(
        "doc_id", "id", "th", "n", F.when(F.col("n") > 0, F.xxhash64("k1", "k2")).alias("node"), "sig"))
    classes = stage(sketches.where("n > 0").groupBy("node").agg(
        F.min(F.struct("id", "th")).alias("head"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    nodes = classes.select("node", "n", "sig", F.col("head.id").alias("id"))

    def banded(batch: dict[str, list]) -> Iterator[tuple]:
        if batch["sig"]:
            keys = W.signed(bands(np.frombuffer(b"".join(batch["sig"]), np.uint32).reshape(len(batch["sig"]), -1)))
            yield from zip(batch["node"], batch["n"], batch["id"], keys.tolist())

    buckets = map_rows(nodes, banded, "node long, n long, id long, keys array<long>").select(
        F.explode("keys").alias("bucket"), "node", "n", F.struct("id", "node").alias("place"))
    hubs = buckets.groupBy("bucket").agg(F.min("place").alias("hub"), F.max("place").alias("other")).where("hub < other")
    members = stage(buckets.join(hubs.select("bucket", F.col("hub.node").alias("hub")), "bucket").drop("place"))
    heads = classes.select("node", "head.*").join(members.select("node").distinct(), "node")
    texts = stage(rows.join(heads, ["id", "th"]).select("node", "raw").dropDuplicates(["node"]))
    check = lambda pairs: verified(pairs, nodes, texts, shingle_words, threshold, miss)

    met = members.where("node <> hub").groupBy("hub", "node").agg(F.count(F.lit(1)).alias("shared"))
    best = met.groupBy("node").agg(F.max_by("hub", "shared").alias("hub"))
    links = check(best.select(F.col("hub").alias("a"), F.col("node").alias("b")))

    # Every hub with all nodes of its buckets that are still in other groups.
    placed = _open(members, connected(links))
    x, y = placed.where("node = hub").alias("x"), placed.alias("y")
    apart = F.expr(f"x.bucket = y.bucket AND x.label <> y.label AND least(x.n, y.n) >= {threshold} * greatest(x.n, y.n)")
    pairs = x.join(y, apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    links = stage(links.unionByName(check(pairs)))

    placed = _open(members, connected(links)).select("node", "n", "label").distinct()
    links = stage(links.unionByName(check(across_groups(placed, texts, shingle_words, round(threshold * 100)))))

    labels = connected(links)
    heads = classes.select("node", "head")
    firsts = labels.join(heads, "node").groupBy("label").agg(F.min("head").alias("first"))
    linked = labels.join(firsts, "label").select("node", "first")
    known = heads.join(linked, "node", "left").select("node", F.coalesce("first", "head").alias("first"))
    return sketches.select("doc_id", "id", "th", "n", "node").join(known, "node", "left").select(
        "doc_id", "id", "th", "n", F.coalesce("first", F.struct("id", "th")).alias("first"))


_KEPT = "struct(id, th) = first"


def _text_hash(text: str) -> Column:
    """64 bits: rows without a doc_id are told apart by this alone."""
    return F.xxhash64(text).alias("th")


def groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id of its group), kept."""
    first = F.col("first.id")
    return _grouped(docs, shingle_words, threshold, miss).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(first != SMALLEST_ID, first).alias("component_id"), F.expr(_KEPT).alias("kept"))


def without_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """`docs` with one row of each group: that of the smallest doc_id and hash of text, once."""
    kept = _grouped(docs, shingle_words, threshold, miss).where(_KEPT).select("id", "th").distinct()
    rows = wrapped(docs).select("row", "id", _text_hash("row.text"))
    return unwrapped(rows.join(kept, ["id", "th"]).dropDuplicates(["id", "th"]), docs.columns)
