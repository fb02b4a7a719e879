"""Removal of lines that are nearly equal to an earlier line: an exact set-similarity join.

A line's set holds its distinct lower-cased tokens (split at blanks). A line goes if an earlier
line (smaller doc_id, or before in the document) has a set whose Jaccard similarity to its own is at
least `percent`. Earlier lines count whether or not they go themselves. Lines of any number of
tokens are compared; only lines without a token stay as they are.

1. Lines with equal sets are one set, known by its first line; its other lines go at once. Sets too
   small to be similar to any but an equal one (n < t / (1 - t): up to 3 tokens at 80 percent) are
   done with this.
2. A set's tokens are ordered by rarity (a class from token counts, then a hash). Two similar sets
   share a token among the first n - ceil(t n) + 1, so only these prefixes are joined. Length,
   position, and the overlap that parity maps of tokens still allow are tested in the join; where
   all earlier sets are met, the maps of two sets of more than `LONG` tokens have 128 bits, as so many fill 64.
3. What is left is tested with parity maps of 256 bits and then verified on the lines themselves. Tables written on
   the way are deleted as soon as the last that reads them is written.

Sets are numbered in the order of their first lines, so that prefix rows and pairs carry one long for a place.

A match is needed for each line, not every match. Under tokens that stand in the prefixes of `HOT`
sets or more, a set therefore first meets four sets at most, the earliest of its own and of the two
neighbouring sizes and the one on most lines, and is verified with the most promising of all these; only sets that are
still without a match meet all earlier sets there. Nothing is capped.

Only Spark functions are used. The driver holds one table of `SLOTS` counts, whatever the input; a
token that shares its slot with a frequent one counts as frequent, which changes the order of tokens
and not the result.

Defined cases: null and empty texts have no lines to remove and stay as they are. A null doc_id
counts as the smallest. Rows that repeat doc_id and text are one document and get equal results. A very
long text is one row's array of lines, a very long line one of tokens. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.llm.common import KEY, keyed, stage, wrapped
from leasebook.sources.staging import discard

PERCENT = 80
SLOTS = 1 << 18
HOT = 64
PLACE = ["id", "line", "th"]
# Longs of a wide parity map.
LANES = 4
# Sets of more tokens carry a second long of their map.
LONG = 64


def _tokens(line: Column) -> Column:
    """Tokens in order, with repeats; blanks in a row leave empty ones."""
    return F.split(F.translate(F.lower(line), "\t\r\x0b\f\n", "     "), " ")


def _bit(hashed: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(63).cast("int"))


def _parity(hashes: Column) -> Column:
    """64 bits, each whether an odd number of hashes have its place in their low bits."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(_bit(h)))


def _slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(SLOTS - 1).cast("int")


def _rarity_class(count: int) -> int:
    return 48 + min(int(2 * math.log2(count)) + 1, 63)


def _rarity(docs: DataFrame) -> Column:
    """One byte a token slot: a class for the logarithm of its count over all documents."""
    words = keyed(docs).select(F.explode(_tokens(F.col("text"))).alias("t")).where("t <> ''")
    counts = words.groupBy(_slot(F.xxhash64("t")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    table = bytearray(b"0" * SLOTS)
    for row in counts.toLocalIterator():  # at most SLOTS rows
        table[row["slot"]] = _rarity_class(row["n"])
    return F.lit(bytes(table))


def _sets(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(lines with the key of their set, sets with number of lines, first line, size, map and prefix), sets numbered `s` by first line.

    A token is a long whose high bits are its rarity class and whose low bits a hash.
    """
    rarity = _rarity(docs)
    rare = lambda h: F.ascii(F.substring(rarity, _slot(h) + 1, F.lit(1)).cast("string")).cast("long")
    mark = lambda h: F.shiftleft(rare(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    n = F.size("marks")
    lines = keyed(docs).where("text IS NOT NULL").select(*KEY, F.posexplode(F.split("text", "\n")).alias("line", "content"))
    hashes = F.array_distinct(F.transform(F.array_remove(_tokens(F.col("content")), ""), lambda t: F.xxhash64(t)))
    marked = lines.select(*PLACE, F.sort_array(F.transform(hashes, mark)).alias("marks"))
    # Lines without tokens go after the write: a filter before it would make all marks twice.
    placed = stage(marked.select(
        *PLACE, F.xxhash64("marks").alias("k1"), F.xxhash64(F.lit(7), "marks").alias("k2"), n.alias("n"),
        _parity(F.col("marks")).alias("map"),
        F.when(n > LONG, _parity(F.filter("marks", lambda m: m.bitwiseAND(64) != 0))).alias("half"),
        F.slice("marks", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1).alias("prefix"))).where("n > 0")
    sets = placed.groupBy("k1", "k2").agg(F.min(F.struct(
        F.struct(*PLACE).alias("at"), "n", "map", "half", "prefix")).alias("s"), F.count(F.lit(1)).alias("times")).select(
        "k1", "k2", "times", "s.at.*", "s.n", "s.map", "s.half", "s.prefix")
    # Ranges of places in order, and rows in order within each: ids rise with the place.
    numbered = sets.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).withColumn("s", F.monotonically_increasing_id())
    return placed.select(*PLACE, "k1", "k2"), stage(numbered)


def _apart(x: str, y: str) -> Column:
    """Bits in which the maps of two sets differ: at most as many as tokens in which the sets do."""
    return F.bit_count(F.col(f"{x}.map").bitwiseXOR(F.col(f"{y}.map")))


def _far_apart(x: str, y: str) -> Column:
    """As `_apart`, of 128 bits where both sets have `half`: `map` covers all tokens, `half` those with one more bit of their hash."""
    whole = F.col(f"{x}.map").bitwiseXOR(F.col(f"{y}.map"))
    half = F.col(f"{x}.half").bitwiseXOR(F.col(f"{y}.half"))
    return F.coalesce(F.bit_count(half) + F.bit_count(half.bitwiseXOR(whole)), F.bit_count(whole))


def _could_match(x: str, y: str, percent: int, apart: Column) -> Column:
    """Length, position and map filters on two prefix rows of a common token; y is the earlier set.

    The position filter takes the token for the first that the sets share: it holds for the row of
    that token, and a similar pair needs no other.
    """
    xn, yn = F.col(f"{x}.n"), F.col(f"{y}.n")
    need = F.ceil((xn + yn) * percent / F.lit(100 + percent))
    i, j = F.col(f"{x}.pos"), F.col(f"{y}.pos")
    return (
        (F.least(xn, yn) * 100 >= F.greatest(xn, yn) * percent)
        & ((xn + yn - apart) >= need * 2) & (F.least(xn - i, yn - j) >= need) & (F.col(f"{y}.s") < F.col(f"{x}.s"))
    )


def _prefixes(sets: DataFrame, *more: str) -> DataFrame:
    """One row a prefix token of each set."""
    return sets.select("s", "n", "map", *more, F.posexplode("prefix").alias("pos", "mark"))


def _wide(tokens: Column) -> Column:
    """Parity map of 64 * LANES bits."""
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def lane(k: int) -> Column:
        own = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(LANES - 1) == k)
        return _parity(own)

    return F.struct(*[lane(k).alias(f"w{k}") for k in range(LANES)])


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Distinct `x` of those (x, y) whose sets are similar on the lines themselves; x and y are numbers of sets."""
    met = pairs = stage(pairs)
    wanted = sets.select("s", *PLACE).join(pairs.select(F.explode(F.array("x", "y")).alias("s")).distinct(), "s")
    by_doc = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("line", "s")).alias("lines"))
    # Rows that repeat a document give each of its lines once.
    found = keyed(docs).join(by_doc, KEY).select(F.split("text", "\n").alias("parts"), F.explode("lines").alias("at")).select(
        F.col("at.s").alias("s"), F.array_distinct(F.array_remove(_tokens(F.get("parts", F.col("at.line"))), "")).alias("tokens"))
    tokens = stage(found.dropDuplicates(["s"]).select("s", "tokens", F.size("tokens").alias("n"), _wide(F.col("tokens")).alias("wide")))
    for side in ("x", "y"):
        pairs = pairs.join(tokens.select(F.col("s").alias(side), F.col("n").alias(f"{side}_n"), F.col("wide").alias(f"{side}_wide")), side)
    # Maps differ in at most as many bits as the sets in tokens.
    apart = sum((F.bit_count(F.col(f"x_wide.w{k}").bitwiseXOR(F.col(f"y_wide.w{k}"))) for k in range(LANES)), F.lit(0))
    total = F.col("x_n") + F.col("y_n")
    near = pairs = stage(pairs.where((total - apart) * (100 + percent) >= total * percent * 2).select("x", "y"))
    discard(met)
    for side in ("x", "y"):
        pairs = pairs.join(tokens.select(F.col("s").alias(side), F.col("tokens").alias(f"{side}_tokens")), side)
    both = F.size(F.array_intersect("x_tokens", "y_tokens"))
    either = F.size("x_tokens") + F.size("y_tokens") - both
    similar = stage(pairs.where(both * 100 >= either * percent).select("x").distinct())
    discard(near)
    discard(tokens)
    return similar


def repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (id, line, th) of the lines that go; line is counted from 0."""
    lines, sets = _sets(docs, percent)
    open_sets = sets.where(F.col("n") * (100 - percent) >= percent)
    rows = _prefixes(open_sets, "times")
    # A hot token occurs `HOT` times at least, which its rarity class tells without a shuffle.
    rows = rows.where(F.shiftrightunsigned("mark", 56) >= _rarity_class(HOT))
    hot_marks = stage(rows.groupBy("mark").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") >= HOT).select("mark"))
    hot = rows.join(hot_marks, "mark")
    shown = ["s", "n", "map", "pos"]
    by_size = stage(hot.groupBy("mark", F.col("n").alias("for_n")).agg(
        F.min(F.struct(*shown)).alias("first"), F.min(F.struct(-F.col("times"), *shown)).alias("common")))
    common = by_size.groupBy("mark").agg(F.min("common").alias("y"))
    near = by_size.select("mark", F.explode(F.array(*[F.col("for_n") + k for k in (-1, 0, 1)])).alias("for_n"), "first.*")
    hubs = near.unionByName(by_size.select("mark", "for_n").join(common, "mark").select("mark", "for_n", *[f"y.{c}" for c in shown]))
    same = (F.col("x.mark") == F.col("y.mark")) & (F.col("x.n") == F.col("y.for_n"))
    pairs = hot.alias("x").join(hubs.alias("y"), same & _could_match("x", "y", percent, _apart("x", "y")))
    total, apart = F.col("x.n") + F.col("y.n"), _apart("x", "y")
    nearest = pairs.select(F.col("x.s").alias("x"), F.col("y.s").alias("y"), ((total - apart) / total).alias("alike"))
    done = _verified(nearest.groupBy("x").agg(F.max_by("y", "alike").alias("y")), sets, docs, percent)
    discard(by_size)
    discard(hot_marks)

    # Both sides of the join are one exchange: `left` is tested in the join, on columns of both.
    matched = done.select(F.col("x").alias("s"), F.lit(True).alias("matched"))
    rows = _prefixes(open_sets.join(matched, "s", "left").withColumn("left", F.col("matched").isNull()), "half", "left")
    still = F.col("x.left") | (F.col("y.left") & (F.col("y.n") < 0))
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.mark") == F.col("y.mark")) & still & _could_match("x", "y", percent, _far_apart("x", "y")))
    found = pairs.select(F.col("x.s").alias("x"), F.col("y.s").alias("y")).distinct()
    done = done.unionByName(_verified(found, sets, docs, percent))

    first = F.struct(*PLACE)
    gone = sets.select("k1", "k2", "s", first.alias("at")).join(done.withColumn("similar", F.lit(True)), F.col("s") == F.col("x"), "left").select(
        "k1", "k2", "at", F.coalesce("similar", F.lit(False)).alias("similar"))
    return lines.join(gone, ["k1", "k2"]).where(F.col("similar") | (F.struct(*PLACE) > F.col("at"))).select(*PLACE)


def without_repeated_lines(docs: DataFrame, percent: int = PERCENT, counted: bool = True) -> DataFrame:
    """`docs` with `text` less the lines that go, and (if `counted`) a last column n_removed in place of any other of that name."""
    by_doc = repeated_lines(docs, percent).groupBy(*KEY).agg(F.collect_set("line").alias("gone"))
    joined = wrapped(docs).join(by_doc, KEY, "left")
    parts = F.split(F.col("row.text"), "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    count = [F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")] if counted else []
    return joined.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if not (counted and c == "n_removed")], *count)
