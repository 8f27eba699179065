"""Event-sourced logs: latest revisions, statuses derived from evidence, truncation, blinding and sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.hashing import opaque_token, response_hash


def latest_revisions(log: DataFrame, keys: Sequence[str] = ("item_id", "annotator_id"), saved: str = "saved_at", index: str = "log_index") -> DataFrame:
    """The last saved row of each key, a tie going to the later line of the log.

    An aggregate of the whole row by its order: it combines before the shuffle, so a key with very many revisions
    costs no more than one with few.
    """
    rest = [c for c in log.columns if c not in keys]
    g = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(saved, index)).alias("_r"))
    return g.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*log.columns)


def with_revision(log: DataFrame, keys: Sequence[str] = ("item_id", "annotator_id"), index: str = "log_index") -> DataFrame:
    """Each row's ordinal among its key's, in log order."""
    return log.withColumn("revision", F.row_number().over(Window.partitionBy(*keys).orderBy(index)))


def latest_by_source(log: DataFrame, item_map: DataFrame, annotator: str, rating_round: str = "initial") -> DataFrame:
    """One annotator's latest row of a round for each source (run_id, turn_number), with the log's other columns.

    item_map has item_id, run_id, turn_number and rating_round. Items that it lacks are left out. Two things fail the
    query: an item that the map holds twice, and one that the map gives another round than the log.
    """
    twice = F.raise_error(F.concat(F.lit("the blinding map holds twice: "), F.col("item_id")))
    once = item_map.groupBy("item_id").agg(F.count("*").alias("_n"), F.any_value(F.struct("run_id", "turn_number", F.col("rating_round").alias("_round"))).alias("_s"))
    checked = once.select("item_id", F.when(F.col("_n") > 1, twice).otherwise(F.col("_s._round")).alias("_round"), F.col("_s.run_id").alias("run_id"), F.col("_s.turn_number").alias("turn_number"))
    rows = log.where((F.col("annotator_id") == annotator) & (F.col("rating_round") == rating_round)).join(checked, "item_id")
    other = F.raise_error(F.concat(F.lit("rating rounds differ for "), F.col("item_id")))
    # A map entry without a round can't agree with the log's either.
    rows = rows.withColumn("rating_round", F.when(F.coalesce(F.col("_round") == F.col("rating_round"), F.lit(False)), F.col("rating_round")).otherwise(other)).drop("_round")
    return latest_revisions(rows, ("run_id", "turn_number"))


def incomplete_items(items: DataFrame, log: DataFrame, axes: Sequence[str], annotator: str) -> DataFrame:
    """Items that the annotator hasn't rated on all axes yet, in the items' order."""
    done = latest_revisions(log.where(F.col("annotator_id") == annotator)).where(" AND ".join(f"{a} IS NOT NULL" for a in axes)).select("item_id")
    return items.join(done, "item_id", "left_anti").orderBy("item_id")


def annotation_progress(items: DataFrame, log: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Per annotator: complete and remaining items."""
    total = items.agg(F.count("*").alias("items"))
    complete = F.lit(True)
    for a in axes:
        complete = complete & F.col(a).isNotNull()
    g = latest_revisions(log).groupBy("annotator_id").agg(F.count(F.when(complete, 1)).alias("complete"))
    return g.crossJoin(F.broadcast(total)).select("annotator_id", "items", "complete", (F.col("items") - F.col("complete")).alias("remaining"))  # one row


def default_annotator(progress: DataFrame) -> DataFrame:
    """The annotator with the most complete items, the last name of equals."""
    return progress.agg(F.max_by("annotator_id", F.struct("complete", "annotator_id")).alias("annotator_id"))


def run_status(headers: DataFrame, events: DataFrame, planned: int = 6, run: str = "run_id") -> DataFrame:
    """Status of every run from its successes and errors alone: nothing is a stored counter.

    planned, partial (some successes), failed (errors only) or completed, with its last response's time.
    """
    ok, bad = F.col("kind") == "success", F.col("kind") == "error"
    g = events.groupBy(run).agg(F.count(F.when(ok, 1)).alias("turns"), F.count(F.when(bad, 1)).alias("errors"), F.max(F.when(ok, F.col("ts"))).alias("last_response"))
    j = headers.join(g, run, "left").withColumns({"turns": F.coalesce("turns", F.lit(0)), "errors": F.coalesce("errors", F.lit(0))})
    status = F.when(F.col("turns") >= planned, "completed").when(F.col("turns") > 0, "partial").when(F.col("errors") > 0, "failed").otherwise("planned")
    return j.withColumns({"status": status, "completed_at": F.when(status == "completed", F.col("last_response"))}).drop("last_response")


def gaps(turns: DataFrame, run: str = "run_id", turn: str = "turn_number") -> DataFrame:
    """Runs whose turns aren't 1..k without gap or repeat."""
    g = turns.groupBy(run).agg(F.count("*").alias("rows"), F.countDistinct(turn).alias("distinct_turns"), F.min(turn).alias("first"), F.max(turn).alias("last"))
    return g.where((F.col("first") != 1) | (F.col("last") != F.col("rows")) | (F.col("distinct_turns") != F.col("rows")))


def scorability(turns: DataFrame, run: str = "run_id", turn: str = "turn_number", truncated: str = "truncated", finish: str | None = "finish_reason") -> DataFrame:
    """primary_scorable and reason: a truncated turn and all after it are not scorable."""
    cut = F.coalesce(F.col(truncated), F.lit(False))
    if finish:
        cut = cut | (F.lower(F.trim(F.coalesce(F.col(finish), F.lit("")))) == "length")
    before = Window.partitionBy(run).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    out = turns.withColumn("_cut", cut).withColumn("_before", F.coalesce(F.max("_cut").over(before), F.lit(False)))
    reason = F.when(F.col("_before"), "downstream_of_truncation").when(F.col("_cut"), "truncated").otherwise("complete_pre_truncation")
    return out.withColumns({"reason": reason, "primary_scorable": reason == "complete_pre_truncation"}).drop("_cut", "_before")


def blinded_items(turns: DataFrame, key: bytes, text: str = "response_text") -> tuple[DataFrame, DataFrame]:
    """Items for annotators and the map back to runs, as two frames that share the opaque id only."""
    usable = turns.where(F.col("primary_scorable") & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
    source = response_hash(F.col(text))
    token = F.concat(F.lit("item_"), opaque_token(key, "annotation-item-v1", [F.lit("initial"), F.col("run_id"), F.col("turn_number"), source]))
    rows = usable.withColumns({"source_response_hash": source, "item_id": token})
    context = ["conversation_context"] if "conversation_context" in rows.columns else []
    items = rows.select("item_id", F.lit("initial").alias("rating_round"), "turn_number", *context, F.col(text).alias("response_to_score"), "source_response_hash")
    return items, rows.select("item_id", "run_id", "turn_number", F.lit("initial").alias("rating_round"))


def rerating_sample(items: DataFrame, item_map: DataFrame, key: bytes, seed: str, size: float) -> tuple[DataFrame, DataFrame]:
    """A keyed sample of initial items under new ids: `size` is a count (int) or a share (float).

    Items are ranked by their token; a count is a top-k, which Spark merges from each partition's own k.
    """
    initial = items.where("rating_round = 'initial'")
    rank = opaque_token(str(seed).encode(), "rerating-selection-v1", [F.col("item_id"), F.col("source_response_hash")])
    n = min(initial.count(), size) if isinstance(size, int) and not isinstance(size, bool) else math.ceil(initial.count() * float(size))
    chosen = initial.withColumn("_rank", rank).orderBy("_rank", "item_id").limit(n).drop("_rank")
    j = chosen.join(item_map.where("rating_round = 'initial'").select("item_id", "run_id"), "item_id")
    token = F.concat(F.lit("item_"), opaque_token(key, "annotation-item-v1", [F.lit("rerating"), F.lit(str(seed)), F.col("run_id"), F.col("turn_number"), F.col("source_response_hash")]))
    rows = j.withColumns({"item_id": token, "rating_round": F.lit("rerating")})
    return rows.select(*items.columns), rows.select("item_id", "run_id", "turn_number", "rating_round")


def duplicates(frame: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def new_events(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't there yet: what an append-only log may take."""
    return incoming.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def with_amendments(turns: DataFrame, amendments: DataFrame, run: str = "run_id", turn: str = "turn_number") -> DataFrame:
    """Each turn's own amendment and those of earlier turns of its run."""
    j = turns.join(amendments.select(run, turn, "amendment_id"), [run, turn], "left")
    before = Window.partitionBy(run).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return j.withColumn("earlier_amendments", F.collect_list("amendment_id").over(before))


def latest_error(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Each run's last error."""
    e = events.where("kind = 'error'")
    return e.groupBy(run).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("error_code", F.struct("ts", "event_id")).alias("error_code"), F.max("ts").alias("ts"))


def errors_since(events: DataFrame, seen: Column | int) -> DataFrame:
    """Errors after the first `seen` of each run, in order of time."""
    order = Window.partitionBy("run_id").orderBy("ts", "event_id")
    return events.where("kind = 'error'").withColumn("n", F.row_number().over(order)).where(F.col("n") > seen)


def select_in_order(verdicts: DataFrame, position: str = "position", verdict: str = "verdict") -> DataFrame:
    """The first candidate in a frozen order that isn't FAIL: it is selected if PASS, else the selection waits for it."""
    at = F.min(F.when(F.col(verdict) != "FAIL", F.struct(position, verdict, "candidate"))).alias("r")
    return verdicts.agg(at).select(F.when(F.col("r").isNull(), "EXHAUSTED").when(F.col(f"r.{verdict}") == "PASS", "SELECTED").otherwise("WAITING").alias("outcome"), F.col("r.candidate").alias("candidate"))
