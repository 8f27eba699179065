"""What a task or the driver holds doesn't grow with the tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from cohortflow.functions import literals, text
from cohortflow.operators import agreement, bootstrap
from cohortflow.plans import fixtures, rating_queries
from cohortflow.sources import event_store

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plan_of(frame):
    return frame._jdf.queryExecution().sparkPlan().toString(), frame._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["ratings_wide", "confusion_counts", "judge_unanimity", "agreement_table", "majority_vote"])
def test_items_are_dealt_once_to_bounded_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(fixtures, "ITEMS", 100, raising=False)
    plan = plan_of(rating_queries.QUERIES[name](spark, SF))[1]
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "item_id" in x]
    assert len(dealt) == 1, plan
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert f", {-(-rows // 100)})" in dealt[0] or f", {-(-rows // 100)}), REPARTITION_BY_NUM" in dealt[0]


def test_majority_of_repeated_and_missing_ratings(spark):
    rows = [("i", "h", "A1", "1"), ("i", "h", "A1", "2"), ("i", "a", "A1", "2"), ("i", "b", "A1", "2"), ("j", "h", "A1", None), ("k", "a", "A1", "1"), (None, "h", "A1", "0"), (None, "a", "A1", "0"), (None, "b", "A1", "0")]
    f = spark.createDataFrame(rows, "item_id string, source string, axis string, rating string")
    r = agreement.majority_vote(f, "h", ("a", "b", "c")).first()
    got = [r[c] for c in ("total_items", "majority_available", "judges_unanimous", "exact_matches", "numeric_pairs", "both_na", "reference_na_only")]
    assert got == [4, 2, 0, 1, 2, 0, 0]
    assert agreement.majority_vote(f.limit(0), "h", ("a", "b", "c")).count() == 0


def test_bootstrap_never_repeats_units_for_slices(spark):
    rows = spark.range(50).select(F.col("id").alias("u"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    found = bootstrap.mean_bootstrap(rows, "v", unit="u", groups=("g",), resamples=250)
    plan = plan_of(found)[0]
    assert "FlatMapCoGroups" in plan and "collect_list(struct(k" not in plan
    assert [r["n_successful_resamples"] for r in found.collect()] == [250, 250]


def test_markers_are_searched_plainly_where_none_overlaps(spark):
    assert "regexp" not in str(text.marker_count(F.col("x"), "you are right")) and "regexp" in str(text.marker_count(F.col("x"), "so and so"))
    rows = spark.createDataFrame([("so and so and so you are right ünd you are right",), ("",), ("sou are right so",)], "x string")
    line = text.spaced(text.words(F.col("x")))
    assert [tuple(r) for r in rows.select(text.marker_count(line, "you are right"), text.marker_count(line, "so and so"), text.marker_count(line, "ünd")).collect()] == [(2, 2, 1), (0, 0, 0), (0, 0, 0)]


def test_errors_that_repeat_are_parsed_once():
    literals._known.cache_clear()
    assert [literals._known("{'code': 503, 'message': 'Busy'}", None) for _ in range(9)] == [(503, "Busy")] * 9
    assert literals._known.cache_info().misses == 1


def test_names_are_whole_where_the_beginning_is_not_enough(spark):
    assert "btrim" in str(event_store.safe_name(F.col("x")))
    names = ["a" * 179 + "/" * 2000, "." * 1030 + "b", "x" + "/" * 1500 + "y" * 300, "ab-" * 500, "é" * 3000 + "z", "..a..", "q" * 179 + "-" + "r" * 900, "w" * 178 + "-." + "é" * 2000]
    want = [re.sub(r"^[-._]+|[-._]+$", "", re.sub(r"[^A-Za-z0-9._-]+", "-", n))[:180] for n in names]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, x string").orderBy("i")
    assert [r[0] for r in rows.select(event_store.safe_name(F.col("x"))).collect()] == want
