"""Factorial designs: planned runs, their balance, and the requests they will make."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGE = "array<struct<role: string, content: string>>"


def factorial(spark: SparkSession, factors: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the factors' levels, as plain generated rows."""
    frame = spark.range(1).select()
    for name, levels in factors.items():
        frame = frame.select("*", F.explode(F.array(*map(F.lit, levels))).alias(name))
    return frame


def run_key(study: str, columns: Sequence[str]) -> Column:
    """study_a_b_..._rN; the last column is the repetition."""
    return F.concat_ws("_", F.lit(study), *(F.col(c).cast("string") for c in columns[:-1]), F.concat(F.lit("r"), F.col(columns[-1]).cast("string")))


def execution_order(plan: DataFrame, key: str, seed: int, column: str = "execution_order") -> DataFrame:
    """A dense order 1..N that a seed and the key decide; another seed gives another order."""
    shuffled = Window.orderBy(F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key)), 256), F.col(key))
    return plan.withColumn(column, F.row_number().over(shuffled))


def seeded_order(spark: SparkSession, keys: Sequence[str], seed: int) -> DataFrame:
    """The order of a Mersenne-twister shuffle of a plan's keys, which are few by nature."""
    import random

    order = list(keys)
    random.Random(seed).shuffle(order)
    return spark.createDataFrame([(k, i) for i, k in enumerate(order, 1)], "run_id string, execution_order int")


def balance(plan: DataFrame, cells: Sequence[str], levels: Mapping[str, int], key: str = "run_id", order: str = "execution_order") -> DataFrame:
    """Rule and number of violations: missing cells, repeated cells, repeated keys, gaps in the order."""
    expected = 1
    for n in levels.values():
        expected *= n
    by_cell = plan.groupBy(*cells).agg(F.count("*").alias("c"))
    cell = by_cell.agg((F.lit(expected) - F.count("*")).cast("long").alias("missing_cells"), F.coalesce(F.sum(F.when(F.col("c") > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("repeated_cells"))
    rows = plan.agg(
        (F.count("*") - F.countDistinct(key)).cast("long").alias("repeated_keys"),
        (F.count("*") - F.countDistinct(F.when(F.col(order).between(1, F.lit(2**31 - 1)), F.col(order))) + F.abs(F.coalesce(F.max(order), F.lit(0)) - F.count("*")) + F.abs(F.coalesce(F.min(order), F.lit(1)) - 1)).cast("long").alias("order_gaps"),
        F.abs(F.count("*") - expected).cast("long").alias("row_count_off"),
    )
    wide = cell.crossJoin(rows)  # two one-row frames
    return wide.unpivot([], ["missing_cells", "repeated_cells", "repeated_keys", "order_gaps", "row_count_off"], "rule", "violations")


def message_history(turns: DataFrame, run: str = "run_id", turn: str = "turn_number", user: str = "user_message", response: str = "response_text", prefix: Column | None = None, system: Column | None = None) -> DataFrame:
    """Each turn's request: optional system message, prefix, all earlier exchanges, then the turn's user message."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    before = Window.partitionBy(run).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    past = F.flatten(F.collect_list(F.array(message("user", F.col(user)), message("assistant", F.col(response)))).over(before))
    parts = [F.array(message("system", system))] if system is not None else []
    parts += [prefix] if prefix is not None else []
    return turns.withColumn("request_messages", F.concat(*parts, past, F.array(message("user", F.col(user)))))


def message_growth(turns: DataFrame, messages: str = "request_messages") -> DataFrame:
    """Number of messages and the chain of their roles."""
    return turns.withColumns({"message_count": F.size(messages), "role_chain": F.array_join(F.transform(messages, lambda m: m["role"]), " -> ")})


def dialogue_only(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"].isin("user", "assistant"))


def turn_grid(runs: DataFrame, planned: Column) -> DataFrame:
    """A row for every planned turn of every run; none where nothing is planned."""
    return runs.select("*", F.explode(F.when(planned >= 1, F.sequence(F.lit(1), planned)).otherwise(F.array().cast("array<int>"))).alias("turn_number"))


def payload_rows(plan: DataFrame, script_turns: DataFrame, script: str = "script_id") -> DataFrame:
    """Dry-run requests: a row per run and scripted turn with a hash of what would be sent."""
    rows = plan.join(script_turns, script)
    before = Window.partitionBy("run_id").orderBy("turn_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.array_join(F.collect_list("user_message").over(before), "\x1f")
    return rows.withColumn("payload_hash", F.sha2(F.concat_ws("\x1e", "run_id", text), 256))


# The score of each turn of the demonstration profiles.
DEMO_PROFILES = {"steady": (0, 0, 0, 0, 0, 0), "rising": (0, 0, 1, 1, 2, 2), "peak": (0, 1, 2, 2, 1, 0), "late": (0, 0, 0, 0, 1, 2)}


def demo_runs(spark: SparkSession) -> DataFrame:
    """Four runs of six turns with scores by profile and turn."""
    rows = [(f"demo_{p}", p, t, s) for p, scores in DEMO_PROFILES.items() for t, s in enumerate(scores, 1)]
    return spark.createDataFrame(rows, "run_id string, profile string, turn_number int, A1 int")
