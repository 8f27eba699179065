"""Matched-pair comparisons between levels of a condition.

A pair is a cell of the match keys; each side is the mean of its rows. Both sides come from one conditional aggregation,
so a comparison costs one shuffle and no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(condition: str, level, outcome: Column) -> Column:
    return F.when(F.col(condition) == F.lit(level), outcome)


def matched_pair_differences(conversations: DataFrame, outcome: str, condition: str, level_a, level_b, keys: Sequence[str] = ("script_id", "repetition")) -> DataFrame:
    """Per cell value_a, value_b, n_a, n_b and difference (b - a); cells with one side only are kept."""
    y = F.col(outcome).cast("double")
    rows = conversations.where(F.col(condition).isin(level_a, level_b) & y.isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    a, b = _side(condition, level_a, y), _side(condition, level_b, y)
    g = rows.groupBy(*keys).agg(F.avg(a).alias("value_a"), F.avg(b).alias("value_b"), F.count(a).alias("n_a"), F.count(b).alias("n_b"))
    nothing = lambda n: F.when(F.col(n) > 0, F.col(n)).alias(n)
    return g.select(*keys, "value_a", "value_b", nothing("n_a"), nothing("n_b"), (F.col("value_b") - F.col("value_a")).alias("difference"))


def matched_values(conversations: DataFrame, outcome: str, condition: str, level_a, level_b, keys: Sequence[str]) -> DataFrame:
    """Complete pairs only; a null key is a key like any other."""
    y = F.col(outcome).cast("double")
    a, b = _side(condition, level_a, y), _side(condition, level_b, y)
    g = conversations.where(F.col(condition).isin(level_a, level_b)).groupBy(*keys).agg(F.avg(a).alias("value_a"), F.avg(b).alias("value_b"))
    return g.where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull()).withColumn("difference", F.col("value_b") - F.col("value_a"))


def all_level_pairs(conversations: DataFrame, outcomes: Sequence[str], factors: Mapping[str, Sequence[str]]) -> DataFrame:
    """Cells of every pair of levels of every factor and outcome: factor, outcome, level_a < level_b, cell, values.

    A cell (a factor's match keys) gathers one mean per level, so the pairs are formed within small arrays of levels.
    """
    parts = None
    for factor, keys in factors.items():
        rows = conversations.select(F.col(factor).cast("string").alias("level"), F.to_json(F.struct(*keys)).alias("cell"), *(F.col(k).isNotNull().alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(o).cast("double").alias(o) for o in outcomes))
        for i in range(len(keys)):
            rows = rows.where(F.col(f"_k{i}"))
        long = rows.where(F.col("level").isNotNull()).unpivot(["level", "cell"], list(outcomes), "outcome", "y").where(F.col("y").isNotNull())
        own = long.groupBy("outcome", "cell", "level").agg(F.avg("y").alias("v")).withColumn("factor", F.lit(factor))
        parts = own if parts is None else parts.unionByName(own)
    return parts


def matched_comparisons(conversations: DataFrame, outcomes: Sequence[str], factors: Mapping[str, Sequence[str]]) -> DataFrame:
    """Descriptive statistics of the matched differences for every pair of levels, with counts of unmatched cells."""
    means = all_level_pairs(conversations, outcomes, factors)
    levels = means.select("factor", "outcome", "level").distinct()
    a, b = levels.alias("a"), levels.alias("b")
    pairs = a.join(b, (F.col("a.factor") == F.col("b.factor")) & (F.col("a.outcome") == F.col("b.outcome")) & (F.col("a.level") < F.col("b.level"))).select("a.factor", "a.outcome", F.col("a.level").alias("level_a"), F.col("b.level").alias("level_b"))
    x, y = F.col("value_a"), F.col("value_b")
    sided = means.join(pairs, ["factor", "outcome"]).where((F.col("level") == F.col("level_a")) | (F.col("level") == F.col("level_b")))
    cells = sided.groupBy("factor", "outcome", "level_a", "level_b", "cell").agg(F.max(F.when(F.col("level") == F.col("level_a"), F.col("v"))).alias("value_a"), F.max(F.when(F.col("level") == F.col("level_b"), F.col("v"))).alias("value_b"))
    d = y - x
    both = x.isNotNull() & y.isNotNull()
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return cells.groupBy("factor", "level_a", "level_b", "outcome").agg(
        count(both).alias("n_pairs"),
        F.avg(F.when(both, x)).alias("mean_a"),
        F.avg(F.when(both, y)).alias("mean_b"),
        F.avg(d).alias("mean_difference"),
        F.median(d).alias("median_difference"),
        F.stddev_samp(d).alias("std_difference"),
        F.min(d).alias("min_difference"),
        F.max(d).alias("max_difference"),
        count(x.isNotNull() & y.isNull()).alias("n_unmatched_a"),
        count(y.isNotNull() & x.isNull()).alias("n_unmatched_b"),
    )


def interaction(conversations: DataFrame, outcome: str, condition: str, level_a, level_b, moderator: str, low, high, keys: Sequence[str]) -> DataFrame:
    """Difference of differences: the condition's effect at the moderator's high level less that at its low level."""
    y = F.col(outcome).cast("double")

    def cell(m, level):
        return F.avg(F.when((F.col(moderator) == F.lit(m)) & (F.col(condition) == F.lit(level)), y))

    g = conversations.groupBy(*keys).agg(cell(low, level_a).alias("la"), cell(low, level_b).alias("lb"), cell(high, level_a).alias("ha"), cell(high, level_b).alias("hb"))
    g = g.withColumn("effect_low", F.col("lb") - F.col("la")).withColumn("effect_high", F.col("hb") - F.col("ha"))
    return g.where(F.col("effect_low").isNotNull() & F.col("effect_high").isNotNull()).select(*keys, "effect_low", "effect_high", (F.col("effect_high") - F.col("effect_low")).alias("difference"))


def family(conversations: DataFrame, outcomes: Sequence[str], condition: str, pairs: Sequence[tuple], keys: Sequence[str]) -> DataFrame:
    """The differences of a family of tests: comparison, outcome, difference for complete pairs, from one aggregation."""
    y = {o: F.col(o).cast("double") for o in outcomes}
    levels = list(dict.fromkeys(x for p in pairs for x in p))
    means = [F.avg(F.when(F.col(condition) == F.lit(lv), y[o])).alias(f"{o}|{i}") for o in outcomes for i, lv in enumerate(levels)]
    g = conversations.groupBy(*keys).agg(*means)
    at = {lv: i for i, lv in enumerate(levels)}
    tests = [F.struct(F.lit(f"{a}__{b}").alias("comparison"), F.lit(o).alias("outcome"), (F.col(f"`{o}|{at[b]}`") - F.col(f"`{o}|{at[a]}`")).alias("difference")) for o in outcomes for a, b in pairs]
    return g.select(*keys, F.explode(F.array(*tests)).alias("x")).select(*keys, "x.*").where(F.col("difference").isNotNull())
