"""Audits of technical events: counts, distributions, medians, attempts, progress and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def study_audit(events: DataFrame, by: Sequence[str] = ("model_slot",)) -> DataFrame:
    """Per model: responses, errors, reporting rate, medians and sums; nulls are unreported."""
    ok = F.col("kind") == "success"
    n = number(ok)
    reported = number(ok & F.col("tokens").isNotNull())
    return events.groupBy(*by).agg(
        n.alias("responses"),
        number(~ok).alias("errors"),
        reported.alias("reporting_count"),
        F.when(n > 0, reported / n).alias("reporting_rate"),
        F.median(F.when(ok, F.col("tokens"))).alias("median_tokens"),
        F.median(F.when(ok, F.col("latency"))).alias("median_latency"),
        F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens_total"),
        F.round(F.sum(F.when(ok, F.col("latency"))), 4).alias("latency_total"),
    )


def distribution(events: DataFrame, *columns: str, missing: str = "unreported") -> DataFrame:
    """Counts of the columns' values, nulls under their own name."""
    return events.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns)).agg(F.count("*").alias("n"))


def distribution_map(events: DataFrame, by: Sequence[str], column: str, missing: str = "unreported") -> DataFrame:
    """The same as a map for each group, keys in order; a group has as many entries as the column has values."""
    counts = events.groupBy(*by, F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("k")).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))


def in_order(distinct: DataFrame, column: str, name: str) -> DataFrame:
    """The frame with a number from 1 in the column's order: by range partition, with the counts of those before."""
    dealt = distinct.repartitionByRange(column).withColumn("_p", F.spark_partition_id()).persist()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return dealt.withColumn("_place", place).join(F.broadcast(starts), "_p").withColumn(name, (F.col("_start") + F.col("_place")).cast("int")).drop("_p", "_place", "_start")


def execution_summary(plan: DataFrame, runs: DataFrame, planned_turns: int = 6, allowance: int | None = None) -> DataFrame:
    """One row over planned runs and what is stored of them.

    plan: run_id, execution_order; runs: run_id, turns, errors, attempts, closed (by truncation). The next run to
    execute is the first unfinished one that isn't closed, else the first that hasn't begun.
    """
    j = plan.join(runs, "run_id", "left")
    begun = F.col("turns").isNotNull()
    turns, errors = F.coalesce("turns", F.lit(0)), F.coalesce("errors", F.lit(0))
    closed = F.coalesce("closed", F.lit(False))
    g = j.agg(
        F.count("*").alias("planned"),
        number(turns >= planned_turns).alias("completed"),
        number((turns > 0) & (turns < planned_turns)).alias("partial"),
        number((turns == 0) & (errors > 0)).alias("failed"),
        F.coalesce(F.sum(turns), F.lit(0)).cast("long").alias("responses"),
        (F.count("*") * planned_turns - F.coalesce(F.sum(turns), F.lit(0))).cast("long").alias("missing"),
        F.coalesce(F.sum(F.when(closed, planned_turns - turns)), F.lit(0)).cast("long").alias("unfillable"),
        number(closed).alias("closed_by_truncation"),
        F.coalesce(F.sum(errors), F.lit(0)).cast("long").alias("errors"),
        F.coalesce(F.sum("attempts"), F.lit(0)).cast("long").alias("attempts"),
        F.coalesce(F.min(F.when(begun & (turns < planned_turns) & ~closed, F.col("execution_order"))), F.min(F.when(~begun, F.col("execution_order")))).alias("next_execution_order"),
    )
    out = g.withColumn("fillable", F.col("missing") - F.col("unfillable"))
    if allowance is not None:
        out = out.withColumn("remaining_allowance", F.greatest(F.lit(0).cast("long"), F.lit(allowance).cast("long") - F.col("attempts")))
        out = out.withColumn("allowance_sufficient", F.col("remaining_allowance") >= F.col("fillable"))
    return out


def budget_audit(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per configuration: medians of what is reported and whether ALL, PARTIALLY or NOT reported."""
    n, have = F.count("*"), F.count("tokens")
    status = F.when(have == n, "ALL").when(have > 0, "PARTIAL").otherwise("NOT")
    return events.groupBy(*keys).agg(n.alias("n"), F.median("tokens").alias("median_tokens"), have.alias("reported"), status.alias("reporting"))


#: What makes a configuration of the generation budget, and the figures whose medians are reported.
BUDGET_KEYS = ("requested_model", "resolved_model", "provider", "context_condition", "finish_reason", "truncated", "generation_version", "max_completion_tokens", "completion_limit_parameter", "reasoning_control_requested")
BUDGET_MEDIANS = ("prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens", "visible_completion_tokens", "cached_prompt_tokens", "visible_characters", "visible_words", "visible_sentences", "latency_ms")


def reporting_status(column: str) -> Column:
    """Whether all, some or none of a group's rows report a figure."""
    have = F.count(column)
    return F.when(have == F.count("*"), "REPORTED_ALL").when(have > 0, "REPORTED_PARTIAL").otherwise("NOT_REPORTED")


def generation_budget_audit(responses: DataFrame, pilots: Sequence[str] = ("pilot_version",)) -> DataFrame:
    """Per pilot and configuration: responses, medians of what is reported, reporting statuses and a map of HTTP statuses.

    responses: a row per successful response with the pilots' columns, BUDGET_KEYS, BUDGET_MEDIANS and http_status. A
    missing reasoning control is that of the old versions, NONE_LEGACY; null keys are a configuration like any other.
    """
    rows = responses.withColumn("reasoning_control_requested", F.coalesce("reasoning_control_requested", F.lit("NONE_LEGACY")))
    keys = [*pilots, *BUDGET_KEYS]
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("response_count"),
        *(F.median(c).alias(f"median_{c}") for c in BUDGET_MEDIANS),
        reporting_status("reasoning_tokens").alias("reasoning_usage_reporting_status"),
        reporting_status("visible_completion_tokens").alias("visible_token_reporting_status"),
    )
    # Statuses are counted before they meet: a map has an entry for each code that occurs.
    codes = rows.where("http_status IS NOT NULL").groupBy(*keys, F.col("http_status").cast("string").alias("_code")).agg(F.count("*").alias("_n"))
    maps = codes.groupBy(F.struct(*keys).alias("_key")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_code", "_n")))).alias("http_statuses"))
    joined = found.withColumn("_own", F.struct(*keys)).join(maps, F.col("_own").eqNullSafe(F.col("_key")), "left").drop("_own", "_key")
    return joined.withColumn("http_statuses", F.coalesce("http_statuses", F.from_json(F.lit("{}"), "map<string, long>")))


def budget_conclusion(audit: DataFrame) -> DataFrame:
    """One row: INCONCLUSIVE without a configuration or with one that reports no reasoning, else REQUIRES_REVIEW."""
    silent = F.sum(F.when(F.col("reasoning_usage_reporting_status") == "NOT_REPORTED", 1).otherwise(0))
    return audit.agg(F.count("*").alias("configurations"), F.when((F.count("*") == 0) | (silent > 0), "INCONCLUSIVE").otherwise("REQUIRES_REVIEW").alias("reasoning_contribution"))


def finish_audit(turns: DataFrame, amendments: DataFrame) -> DataFrame:
    """One row: counts of each finish status, anomalies approved by a valid amendment, those without any amendment, and
    amendments that don't match their evidence.

    turns: run_id, turn_number, finish_reason of successful turns. amendments: run_id, turn_number, amendment_id and
    failed, the names of the checks that the amendment fails (see rules.broken_rules). An amendment whose turn isn't there
    counts for nothing; two for one turn fail the query.
    """
    from cohortflow.functions.taxonomy import finish_status

    twice = F.raise_error(F.concat_ws(" ", F.lit("two amendments for"), "run_id", F.col("turn_number").cast("string"))).cast("boolean")
    once = amendments.groupBy("run_id", "turn_number").agg(F.count("*").alias("_n"), F.max(F.size("failed") == 0).alias("_valid"))
    once = once.select("run_id", "turn_number", F.when(F.col("_n") > 1, twice).otherwise(F.col("_valid")).alias("_valid"))
    j = turns.select("run_id", "turn_number", finish_status(F.col("finish_reason")).alias("_s")).join(once, ["run_id", "turn_number"], "left")
    s, valid = F.col("_s"), F.col("_valid")
    kinds = ("unreported", "reported_stop", "reported_length", "reported_other")
    return j.agg(
        *(number(s == k).alias(k) for k in kinds),
        number(valid).alias("approved_anomaly_count"),
        number(valid.isNull() & (s != "reported_stop")).alias("unapproved_anomaly_count"),
        number(~valid).alias("invalid_amendments"),
    )


def metadata_keys(events: DataFrame, column: str) -> DataFrame:
    """How often each key of a JSON object column occurs."""
    keys = F.explode(F.json_object_keys(column)).alias("key")
    return events.select(keys).groupBy("key").agg(F.count("*").alias("n"))


def eta(events: DataFrame, remaining: Column | int, last: int = 30, floor: float = 5.0, least: int = 3) -> DataFrame:
    """Seconds left per model: mean latency of its last responses, not below the pacing floor, times what remains."""
    order = Window.partitionBy("model_slot").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    recent = events.where("kind = 'success' AND latency IS NOT NULL").withColumn("n", F.row_number().over(order)).where(F.col("n") <= last)
    left = remaining if isinstance(remaining, Column) else F.lit(remaining)
    return recent.groupBy("model_slot").agg(F.count("*").alias("n_recent"), F.when(F.count("*") >= least, F.greatest(F.lit(floor), F.avg("latency")) * left).alias("eta_seconds"))


def mean_rate_eta(progress: DataFrame) -> DataFrame:
    """elapsed / done * remaining over all rows of done, total and elapsed; null before anything is done."""
    done, total = F.sum("done"), F.sum("total")
    return progress.agg(done.alias("done"), total.alias("total"), F.when(done > 0, F.max("elapsed") / done * (total - done)).alias("eta_seconds"))


def criteria_verdict(criteria: DataFrame) -> DataFrame:
    """A verdict from criteria (name, status PASS, FAIL, INCOMPLETE or NOT_RUN): the worst that applies."""
    n = lambda s: number(F.col("status") == s)
    verdict = F.when(F.count("*") == n("NOT_RUN"), "NOT_RUN").when(n("FAIL") > 0, "FAIL").when(n("INCOMPLETE") + n("NOT_RUN") > 0, "INCOMPLETE").otherwise("PASS")
    return criteria.agg(F.count("*").alias("criteria"), n("PASS").alias("passed"), verdict.alias("verdict"))


def pilot_statistics(events: DataFrame, cell: Sequence[str], planned: int) -> DataFrame:
    """Per cell: completed, errors by status code, attempts (one more than the retries), verdict."""
    ok = F.col("kind") == "success"
    code = F.regexp_extract("error_code", r"^http_(\d{3})$", 1).try_cast("int")
    done = number(ok)
    verdict = F.when(F.count("*") == 0, "NOT_RUN").when(number(code.isin(404)) > 0, "FAIL").when(done < planned, "INCOMPLETE").otherwise("PASS")
    return events.groupBy(*cell).agg(done.alias("completed"), number(code.isNotNull()).alias("http_errors"), number(code == 429).alias("http_429"), F.count("*").alias("attempts"), verdict.alias("verdict"))


def judge_progress(successes: DataFrame, errors: DataFrame, total: int) -> DataFrame:
    """Per judge: done, remaining, retries, tokens and cost, errors."""
    s = successes.groupBy("judge_id").agg(F.count("*").alias("done"), F.coalesce(F.sum("retries"), F.lit(0)).cast("long").alias("retries"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.sum("cost").alias("cost"))
    e = errors.groupBy("judge_id").agg(F.count("*").alias("errors"))
    j = s.join(e, "judge_id", "full_outer")
    return j.withColumns({"done": F.coalesce("done", F.lit(0)), "errors": F.coalesce("errors", F.lit(0))}).withColumn("remaining", F.lit(total) - F.col("done"))
