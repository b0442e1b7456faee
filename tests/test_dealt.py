"""Large tables are dealt to as many tasks as their rows ask for, with the same results."""

import re

import pytest

import __spark_entry__ as entry
from stavelake.plans import bindings
from tests.harness import compare

#: Queries, with the most shuffles that their plan may have when everything is dealt.
NAMED = {"line_fonts": 2, "line_text": 2, "staff_bands": 6, "tie_add": 5, "lyric_zip": 9, "lyric_zip_voice": 9, "onset_clusters": 4, "onset_groups": 4, "rhythm_suspects": 8, "backup_align": 4, "timeline_rows": 60, "fix_apply": 14}


@pytest.fixture
def dealt(monkeypatch):
    monkeypatch.setattr(bindings, "ROWS_A_TASK", 500)
    monkeypatch.setattr(bindings, "FEW_TASKS", 2)


@pytest.mark.parametrize("name", NAMED)
def test_dealt_queries_keep_their_rows(spark, con, small, dealt, name):
    df = entry.queries()[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= NAMED[name]
    assert compare(df, entry.oracle_sql()[name], con) == ""


def test_tasks_grow_with_the_rows(spark, small, dealt):
    b = bindings.Bindings(spark, small)
    rows = b.table("lineitem").count()
    assert b.tasks("lineitem") == -(-rows // 500)
    assert b.gl.rdd.getNumPartitions() == b.by_measure.rdd.getNumPartitions() == b.tasks("lineitem")


def test_few_rows_are_left_to_spark(spark, small):
    assert "REPARTITION_BY_NUM" not in bindings.Bindings(spark, small).by_measure._jdf.queryExecution().executedPlan().toString()
