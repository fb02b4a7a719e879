"""Written intermediate tables, for results that several outputs of one job read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Local sessions without the setting get a temporary folder. On a cluster the setting is
    required, because another machine could not read a local folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="leasebook-"))
    return context.getCheckpointDir()


# A staged table is computed once, so its shuffle files are of no use after the write.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of a write made herein at its end, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame) -> DataFrame:
    """Write a DataFrame as Parquet and read it back.

    Cuts the lineage like a checkpoint, so a lost executor does not repeat the work before
    it, while later readers keep column pruning and filter push-down. The disk holds the shuffles
    of one such step at a time, besides the staged tables.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = staged.sparkSession
    root = staging_root(spark).rstrip("/")
    for folder in {file.rsplit("/", 1)[0] for file in staged.inputFiles()}:
        if not folder.rsplit("/", 1)[1].startswith("stage-"):
            raise ValueError(f"not a staged table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder.rsplit('/', 1)[1]}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
