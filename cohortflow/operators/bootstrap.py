"""Cluster bootstrap of statistics that are made of sums, over any number of units.

A resample of n units with replacement is a multinomial vector of weights. It is drawn in two levels: how many of the n
draws fall into each block of units, then, within a block, on which unit. The first level is drawn once for each slice of
resamples, the second in the task that holds the block; both together have the distribution of drawing rows. Weighted sums
of blocks add up, so neither the units nor the resamples of a group ever meet in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a block on average, resamples of a slice.
BLOCK, SLICE = 4096, 100


def _kinds(frame: DataFrame, columns: Sequence[str]) -> str:
    return "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in columns)


def resampled_units(frame: DataFrame, sums: Mapping[str, Column], unit: str, cluster: str | None, groups: Sequence[str]) -> DataFrame:
    """A row per unit or cluster with its sums; a unit that repeats fails the query. Rows without unit, cluster or a value
    of the sums are left out."""
    key = cluster or unit
    own = frame.select(*groups, F.col(unit).alias("_unit"), F.col(key).alias("_key"), *(c.cast("double").alias(f"_s_{n}") for n, c in sums.items()))
    own = own.dropna(subset=["_unit", "_key", *(f"_s_{n}" for n in sums)])
    repeats = F.raise_error(F.concat(F.lit(f"{unit} repeats: "), F.col("_unit").cast("string"))).cast("double")
    once = own.groupBy(*groups, "_unit").agg(F.count("*").alias("_n"), F.any_value("_key").alias("_key"), *(F.any_value(f"_s_{n}").alias(f"_s_{n}") for n in sums))
    first = next(iter(sums))
    checked = once.withColumn(f"_s_{first}", F.when(F.col("_n") > 1, repeats).otherwise(F.col(f"_s_{first}")))
    return checked.groupBy(*groups, "_key").agg(F.count("*").alias("_rows"), *(F.sum(f"_s_{n}").alias(n) for n in sums))


def cluster_bootstrap(frame: DataFrame, sums: Mapping[str, Column], statistic: Column, unit: str = "run_id", cluster: str | None = None, groups: Sequence[str] = (), resamples: int = 2_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Per group: estimate, ci_lower and ci_upper (percentiles of the resamples), n_rows, n_units, n_resamples and
    n_successful_resamples, those whose statistic is a finite number.

    `sums` names the columns to add up over a sample, `statistic` is a column of those sums: a mean is
    sum / count, a difference of means, ratios and variances likewise. Resampled are units, or with `cluster` whole
    clusters of them. A group without a usable row gives no row.
    """
    if resamples < 1 or not 0 < confidence < 1:
        raise ValueError("resamples must be positive and the confidence between 0 and 1")
    names = list(sums)
    frame = frame.withColumn("_all", F.lit(0)) if not groups else frame
    by = list(groups) or ["_all"]
    units = resampled_units(frame, sums, unit, cluster, by)
    facts = units.groupBy(*by).agg(F.count("*").alias("n_units"), F.sum("_rows").alias("n_rows"), *(F.sum(n).alias(n) for n in names)).withColumn("estimate", statistic).drop(*names)
    own = F.xxhash64(F.lit(seed), *(F.col(g).cast("string") for g in by))

    # Blocks: as many as the group's units ask for; their sizes are counted, not assumed.
    count = facts.select(*by, F.ceil(F.col("n_units") / BLOCK).alias("_blocks"), own.alias("_own"))
    dealt = units.join(count, by).withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int"))
    blocks = dealt.groupBy(*by, "_own", "_block").agg(F.count("*").alias("_m"))
    # First level: a row per slice of resamples, with the blocks' sizes (one number for each 4,096 units).
    sizes = blocks.groupBy(*by, "_own").agg(F.array_sort(F.collect_list(F.struct("_block", "_m"))).alias("_sizes"))
    slices = sizes.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // SLICE))))
    place = _kinds(blocks, by)

    def deal(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                m = np.array([s["_m"] for s in row["_sizes"]], np.int64)
                rng = np.random.default_rng([row["_own"] % (1 << 64), row["_slice"]])
                many = min(SLICE, resamples - row["_slice"] * SLICE)
                totals = rng.multinomial(m.sum(), m / m.sum(), size=many)
                out = pd.DataFrame({g: [row[g]] * len(m) for g in by})
                yield out.assign(_own=row["_own"], _block=np.array([s["_block"] for s in row["_sizes"]], np.int32), _slice=row["_slice"], _totals=list(totals.T))

    totals = slices.repartition(*by, "_slice").select(*by, "_own", "_slice", "_sizes").mapInPandas(deal, f"{place}_own long, _block int, _slice int, _totals array<long>")
    rows = dealt.select(*by, "_block", F.col("_key").cast("string").alias("_k"), *names)

    def weigh(key, units, draws):
        """One block: its units once, for all slices, so a worker holds a block and a slice of weights."""
        x = units.sort_values("_k")[names].to_numpy(float)
        found = []
        for own, s, totals in zip(draws["_own"], draws["_slice"], draws["_totals"], strict=True):
            rng = np.random.default_rng([own % (1 << 64), s, key[-1] + 1])
            sums = np.stack([np.bincount(rng.integers(0, len(x), k), minlength=len(x)) for k in totals]) @ x
            found.append(pd.DataFrame({"_resample": s * SLICE + np.arange(len(sums)), **dict(zip(names, sums.T, strict=True))}))
        out = pd.concat(found)
        return pd.DataFrame({g: [v] * len(out) for g, v in zip(by, key, strict=False)}).assign(**{c: out[c].to_numpy() for c in out})

    drawn = rows.groupBy(*by, "_block").cogroup(totals.groupBy(*by, "_block")).applyInPandas(weigh, f"{place}_resample long, " + ", ".join(f"`{n}` double" for n in names))
    tried = drawn.groupBy(*by, "_resample").agg(*(F.sum(n).alias(n) for n in names)).withColumn("_v", statistic)
    fine = F.when(~F.isnan("_v") & (F.abs("_v") != float("inf")), F.col("_v"))
    alpha = (1 - confidence) / 2
    ends = tried.groupBy(*by).agg(F.count("*").alias("n_resamples"), F.count(fine).alias("n_successful_resamples"), F.percentile(fine, F.array(F.lit(alpha), F.lit(1 - alpha))).alias("_q"))
    out = facts.join(ends, by).select(*groups, "estimate", F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"), "n_rows", "n_units", "n_resamples", "n_successful_resamples")
    return out


def mean_bootstrap(frame: DataFrame, value: str, **options) -> DataFrame:
    """The cluster bootstrap of a column's mean."""
    return cluster_bootstrap(frame, {"total": F.col(value), "count": F.when(F.col(value).isNotNull(), 1)}, F.try_divide(F.col("total"), F.col("count")), **options)


def matched_bootstrap(conversations: DataFrame, outcome: str, condition: str, level_a: str, level_b: str, match: Sequence[str], cluster: str | None = None, **options) -> DataFrame:
    """The mean matched difference level_b - level_a with its interval: whole pairs are drawn, or with `cluster` (one of the
    matching columns) all pairs of a cluster together."""
    from cohortflow.operators.matched import matched_pair_differences

    pairs = matched_pair_differences(conversations, outcome, condition, level_a, level_b, list(match)).where("difference IS NOT NULL")
    pair = F.to_json(F.struct(*match))
    found = mean_bootstrap(pairs.withColumn("_pair", pair), "difference", unit="_pair", cluster=cluster, **options)
    return found.withColumns({"resample_unit": F.lit(cluster or "matched_pairs"), "level_a": F.lit(level_a), "level_b": F.lit(level_b), "n_pairs": F.col("n_rows")})
