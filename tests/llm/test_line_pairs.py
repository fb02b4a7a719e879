"""Pairs of lines that are verified."""

import os
import random

from leasebook.llm import line_dedup
from tests.llm import frames


def test_pairs_far_apart_leave_before_their_lines_are_read(spark, monkeypatch):
    """A map of 64 bits cannot tell long lines apart; pairs are numbers of sets, and a wide map drops them."""
    pairs = []
    stage = line_dedup.stage

    def noted(df):
        staged = stage(df)
        if staged.columns == ["x", "y"]:
            pairs.append((staged.count(), dict(staged.dtypes)["x"]))
        return staged

    monkeypatch.setattr(line_dedup, "stage", noted)
    draw = random.Random(3)
    common = [f"c{i}" for i in range(150)]
    far = [(i, " ".join(["rare", *common, *[f"w{i}_{k}" for k in range(150)]])) for i in range(6)]
    near = [(10 + i, " ".join(draw.sample([f"n{k}" for k in range(40)], 38))) for i in range(6)]
    texts = [*far, *near, *[(20 + i, " ".join(draw.sample(common, 60))) for i in range(40)]]
    # Tokens of one line only are the commonest of all words, so that the others are its prefix.
    texts += [(100, "\n".join(" ".join([f"w{i}_{k}"] * 60) for i in range(6) for k in range(150)))]
    got = {(r["id"], r["line"]) for r in line_dedup.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == frames.repeated_lines(texts) and got
    assert {kind for _, kind in pairs} == {"bigint"}
    met, kept = sum(n for n, _ in pairs[0::2]), sum(n for n, _ in pairs[1::2])
    assert 0 < kept < met


def test_sets_are_numbered_by_their_first_lines(spark):
    draw = random.Random(5)
    texts = [(draw.choice([None, *range(-20, 20)]), "\n".join(f"a{draw.randrange(90)} b c d e" for _ in range(3))) for _ in range(60)]
    rows = line_dedup._sets(spark.createDataFrame(texts, "doc_id long, text string"), 80)[1].collect()
    assert len({r["s"] for r in rows}) == len(rows)
    by_number = [tuple(r[c] for c in line_dedup.PLACE) for r in sorted(rows, key=lambda r: r["s"])]
    assert by_number == sorted(by_number)


def test_long_lines_of_common_words_do_not_meet(spark, monkeypatch):
    """64 bits are full at such lengths, so that lines with a few words in common would all be pairs."""
    staged = []
    stage = line_dedup.stage

    def noted(df):
        staged.append(stage(df))
        return staged[-1] if staged[-1].columns != ["x", "y"] else counted(staged[-1])

    met = []

    def counted(pairs):
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(line_dedup, "stage", noted)
    draw = random.Random(11)
    words = [f"v{i}" for i in range(1500)]
    texts = [(i, " ".join(draw.sample(words, 150))) for i in range(60)]
    texts += [(100 + i, f"{texts[i][1]} more") for i in range(5)]
    got = {(r["id"], r["line"]) for r in line_dedup.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == frames.repeated_lines(texts) == {(100 + i, 0) for i in range(5)}
    # Without hot tokens the first round has none; the second meets the five copies and hardly more.
    assert met[0] == 0 and 5 <= met[2] < 50


def test_tables_on_the_way_are_deleted(spark, monkeypatch):
    folders = []
    stage = line_dedup.stage

    def noted(df):
        out = stage(df)
        folders.append((out.columns, {f.rsplit("/", 1)[0].removeprefix("file:") for f in out.inputFiles()}))
        return out

    monkeypatch.setattr(line_dedup, "stage", noted)
    texts = [(i, f"a b c d e f g h i j k l {i % 3}") for i in range(9)] + [(20, "a b c d e f g h i j k l x")]
    got = {(r["id"], r["line"]) for r in line_dedup.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == frames.repeated_lines(texts) and got
    passing = [f for columns, found in folders if columns in (["x", "y"], ["s", "tokens", "n", "wide"]) for f in found]
    assert passing and not any(os.path.exists(f) for f in passing)
