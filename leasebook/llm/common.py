"""What several operators share: document rows, their keys, Arrow output.

A document row is known by `id` (its doc_id; a null id counts as the smallest) and `th`, a
64-bit hash of its text. Rows that repeat a doc_id with another text are therefore judged
apart, and repeated equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leasebook.sources.staging import stage

__all__ = ["SMALLEST_ID", "KEY", "bit_table", "documents", "join_spread", "keyed", "map_rows", "stage", "table", "unwrapped", "wrapped"]

SMALLEST_ID = -(2**63)
KEY = ["id", "th"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (id, th, doc_id, text); other columns are left behind, so their names cannot clash."""
    return docs.select(*_key(), "doc_id", "text")


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST_ID)).alias("id"), F.xxhash64("text").alias("th")]


def wrapped(docs: DataFrame) -> DataFrame:
    """Whole rows as one struct `row` beside their key, so that no column name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key())


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def map_rows(df: DataFrame, rows: Callable[[dict[str, list]], Iterator[tuple]], schema: str, flush: int = 4096) -> DataFrame:
    """Run a per-batch Python generator and return its tuples as columns.

    `rows` gets one Arrow batch as lists by column name and yields tuples in schema order.
    Output leaves in batches of `flush` rows, so a batch that yields many rows per document
    is never held whole.
    """
    empty = df.sparkSession.createDataFrame([], schema)
    names = empty.columns
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(pending: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pending)) or [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            pending: list[tuple] = []
            for start in range(0, batch.num_rows, 256):
                part = {n: c.slice(start, 256).to_pylist() for n, c in columns.items()}
                for row in rows(part):
                    pending.append(row)
                    if len(pending) >= flush:
                        yield pack(pending)
                        pending = []
            if pending:
                yield pack(pending)

    return df.mapInArrow(out, empty.schema)


def join_spread(rows: DataFrame, one: DataFrame, keys: list[str], n: str = "n", most: int = 1 << 14, least: int = 1024) -> DataFrame:
    """Inner join of `rows` with `one`, which has one row a key and in column `n` the number of its rows in `rows`.

    A key with more than one in `most` of all matches is spread over several tasks, and its row of `one` is
    copied to each. There are at most `most` such keys, whatever the input, so their list is broadcast; the copies
    are at most twice as many. `one` should be a written table, as it is read three times. NULL keys match nothing.
    """
    bar = max(-(-(one.agg(F.sum(n)).first()[0] or 0) // most), least)
    ways = F.ceil(F.col(n) / F.lit(bar)).cast("int")
    frequent = F.broadcast(one.where(F.col(n) > bar).select(*keys, ways.alias("_ways")))
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in keys]
    dealt = rows.join(frequent, keys, "left").withColumn(
        "_way", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_ways")), F.lit(0)).cast("int")).drop("_ways")
    copied = one.withColumn("_way", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > bar, ways - 1).otherwise(0)))).drop(n)
    return dealt.join(copied, [*keys, "_way"]).drop("_way")


def bit_table(slots: DataFrame, size: int):
    """A table of `size` bits with those in column `slot` set, handed to all tasks.

    The driver gets a row per 512 bits at most, whatever the number of slots.
    """
    blocks = slots.groupBy(F.shiftright("slot", 9).alias("block")).agg(F.collect_set(F.col("slot").bitwiseAND(511).cast("int")).alias("bits"))
    table = np.zeros((max(size >> 9, 1), 64), np.uint8)
    for row in blocks.toLocalIterator():
        bits = np.zeros(512, np.uint8)
        bits[row["bits"]] = 1
        table[row["block"]] = np.packbits(bits, bitorder="little")
    return slots.sparkSession.sparkContext.broadcast(table.tobytes())
