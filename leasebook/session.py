"""Session set-up: adaptive execution, skew splitting, partition sizing."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession

# One shuffle partition per this many bytes of input, before adaptive coalescing. Input files are columnar and compressed;
# rows of a join of them take many times these bytes in a task's memory.
BYTES_PER_PARTITION = 4 * 1024 * 1024
# Adaptive execution merges and splits shuffle partitions to at most this many (compressed) bytes.
SHUFFLED_BYTES_PER_PARTITION = 16 * 1024 * 1024
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where a later step must then shuffle again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "leasebook", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own to `tune_session`."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEASEBOOK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune_session(spark)


def tune_session(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if size_bytes(spark.conf.get(ADVISORY)) > SHUFFLED_BYTES_PER_PARTITION:
        spark.conf.set(ADVISORY, str(SHUFFLED_BYTES_PER_PARTITION))
    return spark


def size_bytes(text: str) -> int:
    """Bytes of a size as settings give it: 64MB, 16m, 1048576."""
    number = text.lower().rstrip("bkmgtp")
    return int(number) << 10 * "bkmgtp".index((text[len(number):].lower() or "b")[0])


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a plan, the figure its broadcast rule uses."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Start adaptive shuffles with enough partitions for the input; AQE merges small ones."""
    wanted = max(spark.sparkContext.defaultParallelism, math.ceil(input_bytes / BYTES_PER_PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return wanted
