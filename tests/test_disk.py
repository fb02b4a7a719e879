"""Steps that are written leave no shuffle files behind."""

import time
from decimal import Decimal as D

from leasebook.operators import costs, finder
from leasebook.operators.finder import FinderSearch
from leasebook.operators.log_state import state_from_logs
from leasebook.sources.staging import stage
from tests.frames import rows, same_lines, submission, tables
from tests.test_save import soft_plan


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def left_since(spark, before: set[str]) -> set[str]:
    """Shuffle files that were not there before; they are removed in the background, so wait a little."""
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_a_staged_table_leaves_no_shuffles(spark):
    before = shuffle_files(spark)
    staged = stage(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    assert sum(r["count"] for r in staged.collect()) == 1000
    assert not left_since(spark, before)


def test_shuffles_outside_a_staged_table_stay_as_they_were(spark):
    kept = spark.range(1000).selectExpr("id % 5 AS k").groupBy("k").count()
    before = shuffle_files(spark)
    assert kept.count() == 5 and shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_costs_and_history_are_written_before_they_are_sorted(spark):
    t = tables(spark)
    before = shuffle_files(spark)
    costs.version_cost(t.change_log, t.change_items, t.detail_log, t.header_log)
    history = finder.finder_history(t, FinderSearch(inactive="1"))
    assert not left_since(spark, before)
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the sort's own
    everything = finder.finder_all(t, FinderSearch(history="yes", inactive="1"))
    assert len(rows(everything)) == len(rows(history)) + len(rows(finder.finder_current(t, FinderSearch(inactive="1"))))


def test_a_batch_for_many_outputs_leaves_no_shuffles(spark):
    before = shuffle_files(spark)
    b = soft_plan(spark, [submission(1, 10), submission(2, 0)], same_lines() + [(2, 1, "base", D(1), 1, D(0), D(0))])
    counts, log_rows = b.dry_run(), b.log_rows
    assert not left_since(spark, before)
    assert {r["Frame"]: r["RowCount"] for r in counts.collect()}["refused"] == 0
    state = state_from_logs(log_rows)  # of the two packages of the batch
    assert state.where("Part = 'header'").count() == 2
