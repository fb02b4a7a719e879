"""Queries against their SQL, and each stage of the pipeline against brute force."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from leasebook.llm import queries
from tests.compare import compare, connect
from tests.llm import frames

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, con, name):
    same, note = compare(spark, con, name, SMALL)
    assert same, note


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    before = pairs(docs)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        out = apply(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "byte_bpe":
            assert {r["doc_id"]: r["decoded"] for r in docs.collect()} == dict(before)
            break
        assert docs.columns == columns
        after = pairs(docs)
        if name == "quality":
            assert set(after) <= set(before) and len(after) > len(before) / 2
        if name == "line_dedup":
            gone = frames.repeated_lines(before)
            want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in before}
            assert dict(after) == want and len(after) == len(before)
        if name == "minhash_dedup":
            assert {i for i, _ in after} == {i for i, c in frames.shingle_groups(before).items() if i == c}
        if name == "decontamination":
            assert {i for i, _ in after} == {i for i, t in before if not frames.hit_words(t, items)[1]}
        before = after


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of it is here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (frames.odd(spark), frames.none(spark)):
        for _, apply in corpus_pipeline.STAGES[:-1]:
            out = apply(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.collect()


def test_line_stage_keeps_a_column_named_like_its_count(spark):
    docs = frames.odd(spark).selectExpr("*", "'own' AS n_removed")
    out = corpus_pipeline.lines(spark, docs, SMALL)
    assert out.columns == docs.columns and {r["n_removed"] for r in out.collect()} == {"own"}
