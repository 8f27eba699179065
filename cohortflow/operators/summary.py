"""Score summaries over one or several factors. All groupings of a report come from one pass (grouping sets)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.ratings import ALL_AXES, lenient_rating, long_ratings, numeric_view


def _statistics() -> list[Column]:
    """Of rows counted by rating: every figure is a sum of a few products, the median is that of weighted values."""
    s, r, n = F.col("score"), F.col("rating"), F.col("n")
    number = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    numeric, total = F.sum(F.when(s.isNotNull(), n)), F.sum(s * n)
    spread = F.sum(s * s * n) - total * total / numeric
    return [
        F.sum(n).alias("n_total"),
        number(s.isNotNull()).alias("n_numeric"),
        number(r == "N/A").alias("n_na"),
        (total / numeric).alias("mean"),
        F.percentile(s, 0.5, n).alias("median"),
        F.when(numeric > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (numeric - 1))).alias("std"),
        *(number(s == k).alias(f"count_{k}") for k in (0, 1, 2)),
    ]


def _counted(turns: DataFrame, factors: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """(factors, axis, rating, score, n): as many rows as the factors have combinations, times axes and ratings."""
    rows = long_ratings(turns, list(factors), axes).groupBy(*factors, "axis", "raw").agg(F.count("*").alias("n"))
    r = lenient_rating(F.col("raw"))
    return rows.withColumn("rating", r).withColumn("score", numeric_view(r))


def score_summary(turns: DataFrame, factors: Sequence[str] = (), axes: Sequence[str] = ALL_AXES, overall: bool = True) -> DataFrame:
    """Per axis, overall and for every level of each factor; shares are of the numeric scores."""
    sets = [(f, f) for f in factors] + ([("overall", None)] if overall else [])
    rows = _counted(turns, factors, axes)
    # One expansion of the counts gives every grouping's rows; the aggregate is then a single one.
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("factor"), (F.col(f).cast("string") if f else F.lit("all")).alias("level")) for n, f in sets)))
    g = rows.select("axis", "rating", "score", "n", named.alias("x")).groupBy("x.factor", "x.level", "axis").agg(*_statistics())
    return g.withColumns({f"prop_{k}": F.when(F.col("n_numeric") > 0, F.col(f"count_{k}") / F.col("n_numeric")) for k in (0, 1, 2)})


def grouped_score_summary(turns: DataFrame, factors: Sequence[str], axes: Sequence[str] = ALL_AXES) -> DataFrame:
    """Per combination of factors and axis; the share of score 2 is of all rows, as long as one is numeric."""
    g = _counted(turns, factors, axes).groupBy(*factors, "axis").agg(*_statistics()).drop("std")
    return g.withColumn("prop_score_2", F.when(F.col("n_numeric") > 0, F.col("count_2") / F.col("n_total")))


def grouping_report(turns: DataFrame, groupings: Sequence[Sequence[str]], axes: Sequence[str] = ALL_AXES) -> DataFrame:
    """Several groupings in one pass: a null factor column is one that the row is not grouped by; `grouping` names those it is."""
    factors = list(dict.fromkeys(f for g in groupings for f in g))
    rows = _counted(turns, factors, axes)
    g = rows.groupingSets([[F.col(x) for x in [*own, "axis"]] for own in groupings], *(F.col(f) for f in factors), F.col("axis")).agg(*_statistics(), *(F.grouping(f).alias(f"_g_{f}") for f in factors))
    names = F.concat_ws("+", *(F.when(F.col(f"_g_{f}") == 0, F.lit(f)) for f in factors))
    return g.withColumn("grouping", F.when(names == "", "overall").otherwise(names)).drop(*(f"_g_{f}" for f in factors))


def turn_table(turns: DataFrame, factors: Sequence[str] = ("presentation_level", "model_slot", "turn_number"), axis: str = "A1") -> DataFrame:
    """Rows, mean score and share of score 2 among all rows, by turn."""
    s = numeric_view(F.col(axis))
    return turns.groupBy(*factors).agg(F.count("*").alias("n_rows"), F.avg(s).alias("mean_score"), F.avg(F.when(s == 2, 1.0).otherwise(0.0)).alias("proportion_2"))


def sensitivity(turns: DataFrame, flag: str, factors: Sequence[str], axis: str) -> DataFrame:
    """The same summary over all rows and over those that aren't flagged."""
    s = numeric_view(F.col(axis))
    both = turns.select(*factors, s.alias("s"), F.explode(F.array(F.struct(F.lit("all").alias("subset"), F.lit(True).alias("use")), F.struct(F.lit("unflagged").alias("subset"), (~F.coalesce(F.col(flag), F.lit(False))).alias("use")))).alias("x"))
    return both.where("x.use").groupBy("x.subset", *factors).agg(F.count("*").alias("n_rows"), F.avg("s").alias("mean_score"))
