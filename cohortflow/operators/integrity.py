"""Reconciliation predicates. Each gives rows (check, violations) or the violating rows; none collects its input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expectations(frame: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rule and how many rows break it, all rules in one pass; a null condition is a breach."""
    agg = frame.agg(*(F.coalesce(F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)), F.lit(0)).cast("long").alias(n) for n, c in rules.items()))
    return agg.unpivot([], list(rules), "rule", "violations")


def failed_checks(frame: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Each row with the names of the rules that it breaks and whether it passes all."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return frame.withColumn("failed_checks", names).withColumn("passes", F.size("failed_checks") == 0)


def missing(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(actual.select(*keys), list(keys), "left_anti")


def set_differences(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    return missing(expected, actual, keys).withColumn("side", F.lit("missing")).unionByName(missing(actual, expected, keys).withColumn("side", F.lit("unexpected")))


def multiset_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur in unequal numbers; one aggregation over both sides."""
    both = a.select(*keys, F.lit(1).alias("n")).unionByName(b.select(*keys, F.lit(-1).alias("n")))
    return both.groupBy(*keys).agg(F.sum("n").alias("surplus")).where("surplus <> 0")


def common(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Groups on both sides of a split; a sound split has none."""
    return train.select(key).distinct().join(test.select(key).distinct(), key, "left_semi")


def join_report(human: DataFrame, judges: DataFrame, key: str = "item_id", hash_column: str = "source_response_hash") -> DataFrame:
    """Per judge: rows, items, missing, extra and repeated items, and hashes that differ."""
    h = human.select(F.col(key).alias("_k"), F.col(hash_column).alias("_h")).distinct()
    j = judges.select("source", F.col(key).alias("_k"), F.col(hash_column).alias("_j"))
    n_human = F.broadcast(h.agg(F.count("*").alias("n_human")))  # one row
    m = j.join(h.withColumn("_in", F.lit(1)), "_k", "left")
    g = m.groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("_k").alias("items"), F.countDistinct(F.when(F.col("_in") == 1, F.col("_k"))).alias("matched"), F.count(F.when((F.col("_in") == 1) & (F.col("_j") != F.col("_h")), 1)).alias("hash_mismatches"))
    return g.crossJoin(n_human).select("source", "rows", "items", (F.col("n_human") - F.col("matched")).alias("missing_items"), (F.col("items") - F.col("matched")).alias("extra_items"), (F.col("rows") - F.col("items")).alias("repeated_rows"), "hash_mismatches")


def covers_all(ratings: DataFrame, items: DataFrame, who: str, key: str = "item_id") -> DataFrame:
    """Those who have rated every item (relational division)."""
    n = F.broadcast(items.select(key).distinct().agg(F.count("*").alias("_n")))  # one row
    g = ratings.join(items.select(key).distinct(), key, "left_semi").groupBy(who).agg(F.countDistinct(key).alias("c"))
    return g.crossJoin(n).where("c = _n").select(who)


def rejoin(ratings: DataFrame, item_map: DataFrame, runs: DataFrame, hash_column: str = "source_response_hash") -> DataFrame:
    """Ratings with their run's metadata; `problem` marks orphans and hashes that differ from the source's."""
    j = ratings.join(item_map, "item_id", "left").join(runs.withColumnRenamed(hash_column, "_source"), ["run_id", "turn_number"], "left")
    problem = F.when(F.col("run_id").isNull(), "unmapped_item").when(F.col("_source").isNull(), "unknown_run").when(F.col("_source") != F.col(hash_column), "hash_mismatch")
    return j.withColumn("problem", problem).drop("_source")


def changed_fields(stored: DataFrame, current: DataFrame, key: str, ignore: Sequence[str] = ("created_at",)) -> DataFrame:
    """Fields of immutable headers that differ, null-safe; columns to ignore aside."""
    columns = [c for c in stored.columns if c != key and c not in ignore and c in current.columns]
    a, b = stored.alias("a"), current.alias("b")
    names = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), names.alias("changed")).where(F.size("changed") > 0)


def replayed_requests(turns: DataFrame, stored_hash: str = "payload_hash") -> DataFrame:
    """Turns whose stored request hash differs from the one rebuilt from the earlier exchanges."""
    from cohortflow.operators.design import message_history

    built = message_history(turns)
    text = F.array_join(F.transform("request_messages", lambda m: F.concat(m["role"], F.lit("\x1f"), m["content"])), "\x1e")
    return built.withColumn("rebuilt_hash", F.sha2(text, 256)).where(F.col("rebuilt_hash") != F.coalesce(F.col(stored_hash), F.lit("")))


def request_hash(messages: Column) -> Column:
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("\x1f"), m["content"])), "\x1e"), 256)


def blockers(conditions: DataFrame) -> DataFrame:
    """Ordered distinct names of unmet conditions (position, name, met), and whether everything is ready."""
    unmet = F.collect_set(F.when(~F.coalesce("met", F.lit(False)), F.struct("position", "name")))
    names = F.array_distinct(F.transform(F.array_sort(unmet), lambda x: x["name"]))
    return conditions.agg(names.alias("blockers"), (F.size(names) == 0).alias("ready"))


def regression(actual: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-10) -> DataFrame:
    """Reported values that differ from the reference by more than the relative tolerance."""
    a = actual.select(*keys, F.col(value).alias("_a"))
    b = reference.select(*keys, F.col(value).alias("_b"))
    far = F.abs(F.col("_a") - F.col("_b")) > F.lit(tolerance) * F.greatest(F.abs("_a"), F.abs("_b"))
    return a.join(b, list(keys), "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull() | far)
