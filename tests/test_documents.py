"""Documents as files against the same documents as a column."""

import gzip

from pyspark.sql import functions as F

from leasebook.operators import submissions
from leasebook.plans import catalogue
from leasebook.sources.documents import LineFiles
from tests.test_disk import left_since, shuffle_files

DOCUMENTS = [
    "<Root><r><Row>1</Row><ItemName> A &amp; B </ItemName><ItemPrice>1.5</ItemPrice><Quantity> 2 </Quantity></r><r><Row>2</Row></r></Root>",
    "<Root><r><Row>1</Row><ItemName>A",
    "<Root></Root>",
    "<Root><r><Row>1</Row></r><r><Row>x</Row><ItemName>q</r><r><Row>3</Row></r></Root>",
    "<Root><r><Row>1</Row><Quantity>ten</Quantity></r><r><Row>2</Row><Quantity>3</Quantity></r></Root>",
    "<Root><r><Row>1</Row><ItemPrice></ItemPrice><ItemDiscount>0.05</ItemDiscount><LicenseFactor>0.1</LicenseFactor></r></Root>",
    "<Root><r><Row>7</Row><Other>left out</Other><ItemName>日本</ItemName></r></Root>",
]


def _named(df):
    return sorted(map(str, df.withColumn("File", F.regexp_extract("File", r"(\d+)\.xml$", 1).cast("long")).collect()))


def _written(folder, documents):
    for i, text in enumerate(documents):
        (folder / f"{i}.xml").write_text(text, encoding="utf-8")
    return str(folder)


def test_files_equal_columns(spark, tmp_path):
    files = LineFiles(spark, _written(tmp_path, DOCUMENTS))
    df = spark.createDataFrame(list(enumerate(DOCUMENTS)), "File long, LinesXml string").withColumnRenamed("File", "submission_id")
    named = lambda rows: rows.withColumnRenamed("submission_id", "File")
    assert _named(files.errors()) == sorted(map(str, named(submissions.parse_errors(df)).collect()))
    assert _named(files.lines()) == sorted(map(str, named(submissions.parse_lines(df)).collect()))


def test_a_long_document_is_read_by_rows(spark, tmp_path):
    rows = "".join(f"<r><Row>{i}</Row><ItemName>item {i}</ItemName></r>" for i in range(20000))
    lines = LineFiles(spark, _written(tmp_path, [f"<Root>{rows}</Root>", f"<Root>{rows}<r><Row>x</Row></r></Root>"]))
    assert lines.lines().agg(F.count_distinct("RowNo"), F.count("RowNo")).first() == (20000, 20000)
    assert lines.errors().count() == 1


def test_no_files_to_read(spark, tmp_path):
    files = LineFiles(spark, _written(tmp_path, ["<Root></Root>"]))
    assert files.lines().count() == files.errors().count() == 0


def test_compressed_files_equal_files(spark, tmp_path):
    plain, packed = tmp_path / "plain", tmp_path / "packed"
    plain.mkdir(), packed.mkdir()
    for i, text in enumerate(DOCUMENTS):
        (packed / f"{i}.xml.gz").write_bytes(gzip.compress(text.encode()))
    named = lambda df: _named(df.withColumn("File", F.regexp_replace("File", r"\.gz$", "")))
    a, b = LineFiles(spark, _written(plain, DOCUMENTS)), LineFiles(spark, str(packed))
    assert named(b.lines()) == _named(a.lines()) and named(b.errors()) == _named(a.errors())


def test_written_documents_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "staging_root", lambda _: str(tmp_path))
    before = shuffle_files(spark)
    lines = catalogue.run("parse_files", spark, "/root/testdata/sf0.001")
    assert not left_since(spark, before)
    written = list(tmp_path.glob("documents-*/part-*"))
    assert written and all(p.name.endswith(".xml.gz") for p in written)
    assert lines.count() > 5000
