"""Package lines from XML files, one document a file.

Files are read by rows, not as whole texts, so a document of any size is never one value. As in a batch of documents, one
error refuses its whole file: a file gives all its lines or an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasebook.operators.submissions import BAD_DOCUMENT, BAD_VALUE, LINE_FIELDS, typed_line, unreadable_line
from leasebook.sources.staging import stage

ROW_TAG = "r"
_CORRUPT = "_corrupt"


class LineFiles:
    """All documents below a folder or matching a pattern. Files are parsed once, into a staged table."""

    def __init__(self, spark: SparkSession, path: str):
        fields = ", ".join(f"{name} string" for name in LINE_FIELDS)
        read = (
            spark.read.format("xml").schema(f"{fields}, {_CORRUPT} string").option("rowTag", ROW_TAG).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _CORRUPT).option("ignoreSurroundingSpaces", "false").load(path)
        )
        line = F.struct(*LINE_FIELDS)
        error = F.when(F.col(_CORRUPT).isNotNull(), BAD_DOCUMENT).when(unreadable_line(line), BAD_VALUE)
        self._rows = stage(read.select(F.col("_metadata.file_path").alias("File"), line.alias("_line"), error.alias("ParseError")))

    def errors(self) -> DataFrame:
        """(File, ParseError) of files that cannot be read; a malformed document counts before a bad value."""
        bad = self._rows.where("ParseError IS NOT NULL")
        malformed = F.bool_or(F.col("ParseError") == BAD_DOCUMENT)
        return bad.groupBy("File").agg(F.when(malformed, BAD_DOCUMENT).otherwise(BAD_VALUE).alias("ParseError"))

    def lines(self) -> DataFrame:
        """File and the typed lines of the files without an error."""
        good = self._rows.join(self.errors().select("File"), "File", "left_anti")
        return good.select("File", *typed_line("_line"))
