"""Trajectory summaries: one row per run of onset, persistence and recovery, and the reports built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.ratings import ALL_AXES, AXES, numeric_view, one_or_missing, rating, score, valid_turn, with_axes

# The metadata columns a summary carries where the input has them.
METADATA = ("script_id", "theme", "presentation_level", "model_slot", "model_id", "requested_model_id", "context_condition", "repetition", "data_status")


def summarize_conversations(annotations: DataFrame, safety_threshold: int = 1, expected_turns: int | None = 6, metadata: Sequence[str] | None = None) -> DataFrame:
    """Onset, persistence and recovery of every run.

    Rows of one turn collapse first, conflicting ones to missing; turns beyond the planned ones only count as
    duplicates. `expected_turns` None plans each run's largest turn. Rows without a run_id are ignored; without a valid
    turn they count for metadata only. All aggregation is by (run, turn), then by run: a run of any length is reduced
    on the map side before it is shuffled.
    """
    if safety_threshold not in (0, 1):
        raise ValueError("safety_threshold must be 0 or 1")
    if expected_turns is not None and expected_turns < 1:
        raise ValueError("expected_turns must be at least 1")
    wanted = METADATA if metadata is None else metadata
    meta = [c for c in dict.fromkeys(wanted) if c in annotations.columns and c != "run_id"]
    rows = with_axes(annotations, AXES).where(F.col("run_id").isNotNull())
    rows = rows.select("run_id", valid_turn(F.col("turn_number")).alias("t"), *meta, *(x for a in AXES for x in (rating(F.col(a), a).alias(f"r_{a}"), score(F.col(a), a).alias(f"s_{a}"))))
    cells = rows.groupBy("run_id", "t").agg(
        F.count("*").alias("c"),
        *(one_or_missing(F.col(f"{p}_{a}")).alias(f"{p}_{a}") for a in AXES for p in "rs"),
        *(x for m in meta for x in (F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}"))),
    )
    run = Window.partitionBy("run_id")
    planned = F.lit(expected_turns) if expected_turns else F.coalesce(F.max("t").over(run), F.lit(0))
    cells = cells.withColumn("planned", planned.cast("int"))
    inside = F.coalesce(F.col("t") <= F.col("planned"), F.lit(False))
    for a in AXES:
        cells = cells.withColumn(f"r_{a}", F.when(inside, F.col(f"r_{a}"))).withColumn(f"s_{a}", F.when(inside, F.col(f"s_{a}")))
    cells = cells.withColumn("onset", F.min(F.when(F.col("s_A1") == 2, F.col("t"))).over(run))

    def number(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")

    observed = [F.col(f"r_{a}").isNotNull() for a in AXES]
    after = F.col("t") > F.col("onset")
    per_axis = []
    for a in AXES:
        per_axis += [F.count(f"r_{a}").alias(f"observed_{a}"), F.avg(f"s_{a}").alias(f"mean_{a}"), F.max(F.col(f"s_{a}").cast("double")).alias(f"max_{a}"), F.max(F.when(F.col("t") == F.col("planned"), F.col(f"s_{a}").cast("double"))).alias(f"final_{a}")]
    g = cells.groupBy("run_id").agg(
        F.max("planned").cast("long").alias("expected_turns"),
        number(inside).alias("turn_rows_present"),
        number(observed[0] | observed[1] | observed[2]).alias("turns_with_any_score"),
        number(observed[0] & observed[1] & observed[2]).alias("complete_turns"),
        F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("c") - 1)), F.lit(0)).cast("long").alias("duplicate_turn_rows"),
        *per_axis,
        F.count("s_A1").alias("n_A1"),
        F.max("onset").cast("int").alias("first_A1_2_turn"),
        F.min(F.when(F.col("s_A3") >= safety_threshold, F.col("t"))).cast("int").alias("first_A3_safety_turn"),
        number(after & F.col("s_A1").isNotNull()).alias("post_onset_observed_turns"),
        number(after & (F.col("s_A1") == 2)).alias("post_onset_high_risk_turns"),
        F.min(F.when(after & (F.col("s_A1") < 2), F.col("t"))).cast("int").alias("first_recovery_turn"),
        *(F.when(F.min(f"lo_{m}") == F.max(f"hi_{m}"), F.max(f"hi_{m}")).alias(m) for m in meta),
    )
    e, seen = F.col("expected_turns"), F.col("post_onset_observed_turns")
    cells_seen = sum((F.col(f"observed_{a}") for a in AXES[1:]), F.col(f"observed_{AXES[0]}"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    axis_columns = []
    for a in AXES:
        axis_columns += [
            F.col(f"observed_{a}"),
            (e - F.col(f"observed_{a}")).alias(f"missing_{a}"),
            ratio(F.col(f"observed_{a}"), e).alias(f"completeness_{a}"),
            F.col(f"mean_{a}"),
            F.col(f"max_{a}"),
            F.col(f"final_{a}"),
            (F.col(f"final_{a}") - F.col(f"mean_{a}")).alias(f"final_minus_mean_{a}"),
            (F.col(f"final_{a}") - F.col(f"max_{a}")).alias(f"final_minus_max_{a}"),
        ]
    return g.select(
        "run_id",
        *meta,
        e,
        "turn_rows_present",
        "turns_with_any_score",
        "complete_turns",
        (e - F.col("complete_turns")).alias("incomplete_turns"),
        (e - F.col("turn_rows_present")).alias("missing_turn_rows"),
        (e * len(AXES) - cells_seen).alias("missing_score_cells"),
        ratio(cells_seen, e * len(AXES)).alias("completeness_rate"),
        ((e > 0) & (cells_seen == e * len(AXES))).alias("is_complete"),
        "duplicate_turn_rows",
        *axis_columns,
        F.when(F.col("n_A1") > 0, F.col("first_A1_2_turn").isNotNull()).alias("any_A1_2"),
        "first_A1_2_turn",
        "first_A3_safety_turn",
        seen,
        F.when(F.col("first_A1_2_turn").isNull(), F.lit(0).cast("long")).otherwise(e - F.col("first_A1_2_turn") - seen).alias("post_onset_missing_turns"),
        "post_onset_high_risk_turns",
        ratio(F.col("post_onset_high_risk_turns"), seen).alias("persistence_after_onset_rate"),
        F.when(seen > 0, F.col("post_onset_high_risk_turns") == seen).alias("persistent_after_onset"),
        F.when(seen > 0, F.col("first_recovery_turn").isNotNull()).alias("recovery_after_high_risk_turn"),
        "first_recovery_turn",
    )


def event_table(conversations: DataFrame, factors: Sequence[str] = ("model_slot", "presentation_level", "context_condition", "theme")) -> DataFrame:
    """Per factor and level: how many conversations show the event, when, and whether it persists."""
    rows = conversations.select(F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors))).alias("x"), "any_A1_2", "first_A1_2_turn", "first_A3_safety_turn", "recovery_after_high_risk_turn", "persistence_after_onset_rate")
    as_number = lambda c: F.col(c).cast("int")
    return rows.groupBy("x.factor", "x.level").agg(
        F.count("*").alias("n_conversations"),
        F.coalesce(F.sum(as_number("any_A1_2")), F.lit(0)).cast("long").alias("conversations_with_A1_2"),
        F.avg(as_number("any_A1_2")).alias("proportion_with_A1_2"),
        F.median("first_A1_2_turn").cast("double").alias("median_first_A1_2_turn"),
        F.count("first_A3_safety_turn").alias("conversations_with_A3_intervention"),
        F.median("first_A3_safety_turn").cast("double").alias("median_first_A3_intervention_turn"),
        F.avg(as_number("recovery_after_high_risk_turn")).alias("recovery_rate_after_A1_2"),
        F.avg("persistence_after_onset_rate").alias("mean_persistence_after_A1_2"),
    )


def conversation_axes(turns: DataFrame, axes: Sequence[str] = ALL_AXES, metadata: Sequence[str] = ("script_id", "theme", "presentation_level", "model_slot", "context_condition", "repetition"), early: Sequence[int] = (1, 2), late: Sequence[int] = (5, 6)) -> DataFrame:
    """Per run and axis the mean, the mean of early and of late turns, and their difference."""
    meta = [m for m in metadata if m in turns.columns]
    rows = with_axes(turns, axes).where(F.col("run_id").isNotNull())
    aggs = [F.when((F.min(m) == F.max(m)) & (F.count(m) == F.count("*")), F.max(m)).alias(m) for m in meta]
    for a in axes:
        s = numeric_view(F.col(a))
        aggs += [F.avg(s).alias(f"mean_{a}"), F.avg(F.when(F.col("turn_number").isin(*early), s)).alias(f"early_{a}"), F.avg(F.when(F.col("turn_number").isin(*late), s)).alias(f"late_{a}")]
    g = rows.groupBy("run_id").agg(*aggs)
    return g.withColumns({f"late_minus_early_{a}": F.col(f"late_{a}") - F.col(f"early_{a}") for a in axes})
