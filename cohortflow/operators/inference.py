"""Inference on matched differences: signed ranks, rank-biserial effects, step-down correction, bootstraps.

Ranks, sums and the z value are native window and aggregate expressions, one partition of the window for each
comparison. Only the normal tail (and the exact small-sample tail) needs Python, on one row per comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest sample whose exact tail is computed, if it has neither ties nor zeros.
EXACT = 50


def signed_rank_statistics(differences: DataFrame, groups: Sequence[str], value: str = "difference", digits: int = 9) -> DataFrame:
    """Per group: n, zeros, n_nonzero, w_plus, w_minus, statistic, tie_sum, z, rank_biserial, mean and median difference.

    Zeros are dropped; equal absolute differences share their average rank. Differences are compared after rounding to
    `digits`, so means that differ in their last bits only still tie. Ranks need each value once: equal values are
    counted first, so a window sees distinct absolute values rather than rows.
    """
    d = F.round(F.col(value), digits)
    rows = differences.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_raw"), (d + F.lit(0.0)).alias("_d"))
    facts = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") == 0, 1).otherwise(0)).cast("long").alias("zeros"), F.avg("_raw").alias("mean_difference"), F.median("_raw").alias("median_difference"))
    size = rows.where("_d <> 0").groupBy(*groups, F.abs("_d").alias("_a")).agg(F.count("*").alias("t"), F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).cast("long").alias("plus"))
    before = Window.partitionBy(*groups).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2
    ranked = size.withColumn("_rank", rank)
    sums = ranked.groupBy(*groups).agg(
        F.sum(F.col("_rank") * F.col("plus")).alias("w_plus"),
        F.sum(F.col("_rank") * (F.col("t") - F.col("plus"))).alias("w_minus"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("long").alias("tie_sum"),
        F.sum("t").cast("long").alias("n_nonzero"),
    )
    null_safe = None
    for g in groups:
        own = F.col(f"f.{g}").eqNullSafe(F.col(f"s.{g}"))
        null_safe = own if null_safe is None else null_safe & own
    joined = facts.alias("f").join(sums.alias("s"), null_safe, "left") if groups else facts.alias("f").crossJoin(sums.alias("s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = joined.select(*(F.col(f"f.{g}").alias(g) for g in groups), "n", "zeros", "mean_difference", "median_difference", zero("n_nonzero").cast("long").alias("n_nonzero"), zero("w_plus").cast("double").alias("w_plus"), zero("w_minus").cast("double").alias("w_minus"), zero("tie_sum").cast("long").alias("tie_sum"))
    m, ties = F.col("n_nonzero").cast("double"), F.col("tie_sum").cast("double")
    spread = m * (m + 1) * (2 * m + 1) / 24 - ties / 48
    w = F.least("w_plus", "w_minus")
    return out.withColumns({
        "statistic": w,
        "z": F.when(spread > 0, (w - m * (m + 1) / 4) / F.sqrt(spread)),
        "rank_biserial": F.when(F.col("n_nonzero") > 0, (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus"))).otherwise(F.lit(0.0)),
    })


def _exact_tail(n: int, w: float) -> float:
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy()
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


@F.pandas_udf(T.DoubleType())
def _p_value(z: pd.Series, n: pd.Series, zeros: pd.Series, ties: pd.Series, w: pd.Series) -> pd.Series:
    from math import erfc, sqrt

    out = []
    for a, m, zero, tie, stat in zip(z, n, zeros, ties, w, strict=True):
        if m == 0:
            out.append(1.0 if zero > 0 else None)
        elif m <= EXACT and not tie and not zero:
            out.append(_exact_tail(int(m), stat))
        else:
            out.append(erfc(abs(a) / sqrt(2)))
    return pd.Series(out, dtype=object)


def signed_rank_test(differences: DataFrame, groups: Sequence[str], value: str = "difference") -> DataFrame:
    """The statistics with p_value and method: 'exact' for up to EXACT untied differences without zeros, else 'normal'.

    All-zero differences have statistic 0 and p 1; without any difference a group has no row.
    """
    s = signed_rank_statistics(differences, groups, value)
    exact = (F.col("n_nonzero") <= EXACT) & (F.col("tie_sum") == 0) & (F.col("zeros") == 0)
    p = _p_value(F.col("z"), F.col("n_nonzero"), F.col("zeros"), F.col("tie_sum"), F.col("statistic"))
    return s.withColumn("p_value", p).withColumn("method", F.when(F.col("n_nonzero") == 0, "all_zero").when(exact, "exact").otherwise("normal"))


def holm(tests: DataFrame, families: Sequence[str], p: str = "p_value", order: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Adds p_holm, step-down within each family, and significant_0_05; rows without a p don't count into the family."""
    number = F.col(p).cast("double")
    finite = number.isNotNull() & ~F.isnan(number)
    family = [F.col(f) for f in families] + [finite.alias("_finite")]
    keyed = tests.withColumn("_finite", finite)
    by = [*families, "_finite"]
    ranked = Window.partitionBy(*by).orderBy(number, *order)
    m = F.count("*").over(Window.partitionBy(*by))
    step = keyed.withColumn("_step", F.least(F.lit(1.0), (m - F.row_number().over(ranked) + 1) * number))
    running = F.max("_step").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = step.withColumn("p_holm", F.when(F.col("_finite"), running))
    del family
    return out.withColumn("significant_0_05", F.coalesce(F.col("p_holm") < alpha, F.lit(False))).drop("_step", "_finite")


def seeded_bootstrap(values: DataFrame, groups: Sequence[str], value: str, order: Sequence[str], resamples: int = 10_000, seed: int = 0, seed_column: str | None = None) -> DataFrame:
    """Percentile interval of the mean with numpy's seeded generator, on each group's values in the given order.

    The draws depend on the order of the values, so a group is sorted by `order` first. A group is one comparison; its
    resamples are drawn in slices, so memory stays a slice's, not resamples x values.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(list(order), kind="stable")[value].to_numpy(float)
        x = x[np.isfinite(x)]
        own = int(pdf[seed_column].iloc[0]) if seed_column else seed
        out = pdf[list(groups)].iloc[[0]].copy()
        if not len(x):
            return out.assign(n=0, estimate=None, ci_low=None, ci_high=None)
        rng = np.random.default_rng(own)
        means = np.empty(resamples)
        step = max(1, 4_000_000 // len(x))
        for a in range(0, resamples, step):
            b = min(resamples, a + step)
            means[a:b] = rng.choice(x, size=(b - a, len(x)), replace=True).mean(axis=1)
        low, high = np.quantile(means, [0.025, 0.975])
        return out.assign(n=len(x), estimate=float(x.mean()), ci_low=float(low), ci_high=float(high))

    kinds = ", ".join(f"{g} {values.schema[g].dataType.simpleString()}" for g in groups)
    return values.groupBy(*groups).applyInPandas(draw, f"{kinds}, n long, estimate double, ci_low double, ci_high double")


def counted_bootstrap(values: DataFrame, groups: Sequence[str], value: str, resamples: int = 10_000, seed: int = 0, slice_: int = 100) -> DataFrame:
    """Percentile interval of the mean for scores of few distinct values: a resample is a multinomial draw of their counts.

    That has the distribution of drawing rows. Slices of a group's resamples are rows of their own, dealt over the
    cluster; each gets the distinct values with their counts, never the group's rows.
    """
    v = F.col(value).cast("double")
    counted = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).groupBy(*groups, v.alias("_v")).agg(F.count("*").alias("_c"))
    sized = counted.groupBy(*groups).agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("estimate"), F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_x"))
    own = F.xxhash64(F.lit(seed), *(F.col(g).cast("string") for g in groups))
    slices = sized.select(*groups, "n", "estimate", "_x", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // slice_))).alias("_s"))

    def draw(batches):
        for pdf in batches:
            means = []
            for r in pdf.itertuples(index=False):
                own, s, n, x = r[-2], r[-1], r[-5], r[-3]
                count = np.array([e["_c"] for e in x], np.int64)
                rng = np.random.default_rng([own % (1 << 64), s])
                many = min(slice_, resamples - s * slice_)
                means.append(rng.multinomial(n, count / count.sum(), size=many) @ np.array([e["_v"] for e in x]) / n)
            yield pdf.iloc[:, :-3].assign(m=means)

    kinds = ", ".join(f"{g} {values.schema[g].dataType.simpleString()}" for g in groups)
    drawn = slices.repartition(*groups, "_s").mapInPandas(draw, f"{kinds}, n long, estimate double, m array<double>")
    ends = drawn.select(*groups, "n", "estimate", F.explode("m").alias("m")).groupBy(*groups, "n", "estimate").agg(F.count("*").alias("resamples"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return ends.select(*groups, "n", "estimate", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "resamples")


def unit_bootstrap(frame: DataFrame, statistic: Callable[[pd.DataFrame], float], unit: str = "run_id", cluster: str | None = None, order: Sequence[str] = (), resamples: int = 2_000, seed: int = 0) -> DataFrame:
    """Interval of any statistic of one row per unit, resampling units or whole clusters; estimates that fail or aren't finite are dropped."""
    if frame.groupBy(unit).count().where("count > 1").limit(1).count():
        raise ValueError(f"{unit} repeats: the statistic needs one row for each")

    def safe(pdf: pd.DataFrame) -> float:
        try:
            v = float(statistic(pdf))
        except Exception:  # noqa: BLE001  the caller's statistic may fail on a degenerate resample
            return float("nan")
        return v

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order) or [unit], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(seed)
        members = [g.index.to_numpy() for _, g in pdf.groupby(cluster, sort=False)] if cluster else [np.array([i]) for i in range(len(pdf))]
        found = []
        for _ in range(resamples):
            pick = rng.integers(0, len(members), len(members))
            found.append(safe(pdf.iloc[np.concatenate([members[i] for i in pick])]))
        ok = np.array([x for x in found if np.isfinite(x)])
        low, high = np.quantile(ok, [0.025, 0.975]) if len(ok) else (None, None)
        return pd.DataFrame({"estimate": [safe(pdf)], "ci_low": [low], "ci_high": [high], "n_units": [len(members)], "n_valid": [len(ok)]})

    return frame.groupBy(F.lit(1).alias("_all")).applyInPandas(draw, "estimate double, ci_low double, ci_high double, n_units long, n_valid long")


def hashed_bootstrap(values: DataFrame, groups: Sequence[str], value: str, order: Sequence[str], resamples: int = 200, seed: str = "s") -> DataFrame:
    """The distributed bootstrap: draw k of resample r is the value at place md5(seed|r|k) mod n. All native.

    Resamples are independent rows, dealt over the cluster; each joins its group's values by place.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    placed = values.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"), (F.row_number().over(w) - 1).alias("_k"))
    sizes = placed.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("_v").alias("estimate"))
    draws = sizes.select(*groups, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r")).select(*groups, "n", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("r").cast("string"), F.col("k").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")
    picked = draws.select(*groups, "r", place.cast("int").alias("_k")).join(placed, [*groups, "_k"])
    means = picked.groupBy(*groups, "r").agg(F.avg("_v").alias("m"))
    ends = means.groupBy(*groups).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return sizes.join(ends, list(groups)).select(*groups, "n", "estimate", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
