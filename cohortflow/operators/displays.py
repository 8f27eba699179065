"""Frames behind report pages: significant rows, labels, formatted intervals, headline figures, job states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def significant(frame: DataFrame, column: str = "significant_0_05") -> DataFrame:
    """Rows marked true, whether as booleans or as text."""
    return frame.where(F.lower(F.trim(F.col(column).cast("string"))) == "true")


def label(value: Column, names: Mapping[str, str]) -> Column:
    """A known name, else the value in title case with blanks for underscores."""
    known = F.lit(None).cast("string")
    for k, v in names.items():
        known = F.when(value == k, v).otherwise(known)
    return F.coalesce(known, F.initcap(F.replace(value, F.lit("_"), F.lit(" "))))


def interval_text(mean: Column, low: Column, high: Column) -> Column:
    """'+0.32 [0.11, 0.53]'; null without an estimate."""
    return F.when(mean.isNotNull(), F.format_string("%+.2f [%.2f, %.2f]", mean, low, high))


def comparison_display(frame: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Comparisons as 'a → b' with formatted difference and a direction."""
    d = F.col("mean_difference")
    return frame.select(
        F.concat(label(F.col("level_a"), names), F.lit(" → "), label(F.col("level_b"), names)).alias("comparison"),
        "outcome",
        "n_pairs",
        F.format_string("%+.3f", d).alias("difference"),
        F.when(d > 0, "up").when(d < 0, "down").otherwise("none").alias("direction"),
    )


def union_families(families: Mapping[str, DataFrame]) -> DataFrame:
    """Tests of several families under one another; columns that a family lacks are null."""
    out = None
    for name, frame in families.items():
        own = frame.withColumn("family", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def headline(conversations: DataFrame) -> DataFrame:
    """Conversations, complete ones, those with the event and mean completeness, in one row."""
    return conversations.agg(F.count("*").alias("n"), F.sum(F.col("is_complete").cast("int")).cast("long").alias("complete"), F.sum(F.coalesce("any_A1_2", F.lit(False)).cast("int")).cast("long").alias("with_event"), F.avg("completeness_rate").alias("mean_completeness"))


def job_status(jobs: DataFrame) -> DataFrame:
    """BLOCKED before COMPLETE before RUNNING before RESUMABLE before NOT_STARTED; the first that holds.

    jobs: blocked, planned, done, running, attempts_left, and a reason to resume where there is one.
    """
    status = (
        F.when(F.coalesce("blocked", F.lit(False)), "BLOCKED")
        .when(F.col("done") >= F.col("planned"), "COMPLETE")
        .when(F.coalesce("running", F.lit(False)), "RUNNING")
        .when(F.col("attempts_left") <= 0, "BLOCKED")
        .when(F.col("done") > 0, "RESUMABLE")
        .otherwise("NOT_STARTED")
    )
    return jobs.withColumns({"status": status, "progress": F.when(F.col("planned") > 0, F.col("done") / F.col("planned"))})


def duration_text(seconds: Column) -> Column:
    """'1h 02m 03s'."""
    s = seconds.cast("long")
    return F.format_string("%dh %02dm %02ds", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
