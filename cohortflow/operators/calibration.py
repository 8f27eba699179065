"""Adaptive calibration of many studies at once: which condition comes next, and what the outcomes so far mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The conditions in the order in which they can come up.
CONDITIONS = ("native_1024", "disabled_1024", "disabled_2048", "disabled_4096", "native_1024_repeat", "disabled_1024_repeat", "native_2048", "native_4096")
#: A study makes at most this many requests.
MOST_REQUESTS = 6


def _finish(condition: str) -> Column:
    return F.col(f"{condition}.finish_reason")


def _met(condition: str, finish: str) -> Column:
    return F.coalesce(_finish(condition) == finish, F.lit(False))


def _open(condition: str) -> Column:
    return F.col(condition).isNull()


def outcomes(records: DataFrame, study: str = "study_id") -> DataFrame:
    """A row per study with a column per condition: its finish_reason and reasoning_tokens, null where it hasn't run.

    records: study, condition, finish_reason, reasoning_tokens, has_usage and responded. A condition that a study ran
    twice is an error, and so is one that isn't known.
    """
    twice = F.raise_error(F.concat(F.lit("a condition repeats in study "), F.col(study).cast("string"))).cast("boolean")
    odd = F.raise_error(F.concat(F.lit("no such condition: "), F.coalesce("condition", F.lit("null"))))
    known = records.withColumn("condition", F.when(F.col("condition").isin(*CONDITIONS), F.col("condition")).otherwise(odd))
    tokens = F.when(F.coalesce("has_usage", F.lit(False)), F.col("reasoning_tokens").cast("long"))
    value = F.struct("finish_reason", tokens.alias("reasoning_tokens"))
    one = lambda c: F.when(F.col("condition") == c, value)
    found = known.groupBy(study).agg(
        F.count("*").alias("requests"),
        F.count_distinct("condition").alias("_different"),
        F.max(~F.coalesce("responded", F.lit(False))).alias("stopped"),
        *(F.any_value(one(c), ignoreNulls=True).alias(c) for c in CONDITIONS),
    )
    once = F.when(F.col("_different") < F.col("requests"), twice).otherwise(F.col("stopped"))
    return found.withColumn("stopped", once).drop("_different")


def next_condition() -> Column:
    """The one condition that the outcomes so far call for; null when there is none.

    Both native and disabled reasoning start with 1,024 tokens. If both run out, disabled gets 2,048 and then 4,096. If only
    native runs out, both are repeated; should the repeats agree with them, native gets 2,048, and 4,096 once that runs out.
    """
    both_long = _met("native_1024", "length") & _met("disabled_1024", "length")
    differ = _met("native_1024", "length") & _met("disabled_1024", "stop")
    again = _met("native_1024_repeat", "length") & _met("disabled_1024_repeat", "stop")
    return (
        F.when(_open("native_1024"), "native_1024")
        .when(_open("disabled_1024"), "disabled_1024")
        .when(both_long & _open("disabled_2048"), "disabled_2048")
        .when(both_long & _met("disabled_2048", "length") & _open("disabled_4096"), "disabled_4096")
        .when(differ & _open("native_1024_repeat"), "native_1024_repeat")
        .when(differ & _open("disabled_1024_repeat"), "disabled_1024_repeat")
        .when(differ & again & _open("native_2048"), "native_2048")
        .when(differ & _met("native_2048", "length") & _open("native_4096"), "native_4096")
    )


def verdict() -> Column:
    """What the two conditions at 1,024 tokens say about the control of reasoning."""
    native, disabled = F.col("native_1024.reasoning_tokens"), F.col("disabled_1024.reasoning_tokens")
    supported = _met("native_1024", "length") & _met("disabled_1024", "stop") & (native > disabled)
    not_supported = _met("native_1024", "length") & (native == 0) & (disabled == 0)
    return F.when(F.coalesce(supported, F.lit(False)), "SUPPORTED").when(F.coalesce(not_supported, F.lit(False)), "NOT_SUPPORTED").when(F.col("requests") > 0, "INCONCLUSIVE").otherwise("NOT_RUN")


def calibration(studies: DataFrame, records: DataFrame, study: str = "study_id") -> DataFrame:
    """Per study: requests, verdict, and next_condition, null once the requests are used up, nothing is called for or the
    last request got no response. Studies without a record haven't run."""
    found = studies.select(study).distinct().join(outcomes(records, study), study, "left").withColumn("requests", F.coalesce("requests", F.lit(0)).cast("long"))
    due = F.when((F.col("requests") < MOST_REQUESTS) & ~F.coalesce("stopped", F.lit(False)), next_condition())
    return found.select(study, "requests", verdict().alias("verdict"), due.alias("next_condition"))
