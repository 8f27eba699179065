"""Frozen results against what their raw evidence gives today: catalogues, selections, bundles and all that was built on them.

Nulls compare as values. Repeated rows count: a row that was frozen twice and comes out once is a change. Empty tables
give empty results. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions import hashing, taxonomy
from cohortflow.operators.integrity import multiset_differences

#: An entry of a raw catalogue, as its JSON has it; prices are texts or numbers.
ENTRY = (
    "array<struct<id string, canonical_slug string, name string, description string, context_length long, pricing struct<prompt string, completion string>, "
    "architecture struct<input_modalities array<string>, output_modalities array<string>>, supported_parameters array<string>, "
    "top_provider struct<max_completion_tokens long>, per_request_limits struct<completion_tokens long>, availability string, status string, expiration_date string>>"
)
#: What is kept of an entry and of its evaluation, and so compared.
FIELDS = (
    "canonical_slug", "prompt_price", "completion_price", "input_modalities", "output_modalities", "parameters", "context_length", "completion_limits",
    "availability", "status", "expires_at", "rejection_reasons", "eligible", "maximum_completion_capability", "completion_limit_parameter", "warned", "position",
)


def catalogue_entries(snapshots: DataFrame) -> DataFrame:
    """A row for each entry of each raw snapshot: snapshot_id, retrieved_at and the columns that `eligibility` takes.

    snapshots: snapshot_id, retrieved_at (timestamp) and body, a JSON list. A body that can't be read gives one row
    without an id, and an empty list none.
    """
    parsed = snapshots.select("snapshot_id", "retrieved_at", F.from_json("body", ENTRY).alias("e"))
    e = F.col("e")
    rows = parsed.select("snapshot_id", "retrieved_at", F.explode(F.coalesce(e, F.array(F.lit(None)))).alias("e"))
    limits = F.array_compact(F.array(F.col("e.top_provider.max_completion_tokens"), F.col("e.per_request_limits.completion_tokens")))
    return rows.select(
        "snapshot_id", "retrieved_at", "e.id", "e.canonical_slug", "e.name", "e.description", "e.context_length", F.col("e.pricing.prompt").alias("prompt_price"), F.col("e.pricing.completion").alias("completion_price"),
        "e.architecture.input_modalities", "e.architecture.output_modalities", F.col("e.supported_parameters").alias("parameters"), limits.alias("completion_limits"), "e.availability", "e.status", F.col("e.expiration_date").alias("expires_at"),
    )


def evaluated(snapshots: DataFrame, phrases: tuple[str, ...] = (), banned: tuple[str, ...] = ()) -> DataFrame:
    """Every entry with its evaluation and, where it is eligible, its position among its snapshot's candidates.

    Candidates without a warning phrase come first, then by id in lower case, then by id. A snapshot is one JSON text, so
    its entries fit in a row and their order is a window of its own.
    """
    rows = taxonomy.eligibility(catalogue_entries(snapshots).where("id IS NOT NULL"), F.col("retrieved_at"), banned)
    text = F.concat_ws(" ", "id", "name", "description")
    rows = rows.withColumn("warned", F.size(taxonomy.phrase_warnings(text, phrases)) > 0 if phrases else F.lit(False))
    order = Window.partitionBy("snapshot_id", "eligible").orderBy("warned", F.lower("id"), "id")
    return rows.withColumn("position", F.when(F.col("eligible"), F.row_number().over(order))).select("snapshot_id", "id", *FIELDS)


def changes(frozen: DataFrame, rebuilt: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys whose rows differ: n_frozen and n_rebuilt, the rows of a side that the other lacks, a verdict (unexpected: frozen
    only, missing: rebuilt only, changed) and the names of the fields that differ, in the order given.

    Rows that agree cancel out in the first aggregation, so only differences reach the second. Where a key has
    several rows on a side, a field differs if its least, largest or number of values does; `combination` stands for rows
    whose fields differ in none of these.
    """
    odd = multiset_differences(frozen.select(*keys, *fields), rebuilt.select(*keys, *fields), [*keys, *fields])
    old, new = F.col("surplus") > 0, F.col("surplus") < 0
    facts = [f(F.when(side, F.col(c))).alias(f"_{c}_{f.__name__}_{n}") for c in fields for n, side in (("a", old), ("b", new)) for f in (F.min, F.max, F.count)]
    one = odd.groupBy(*keys).agg(F.sum(F.when(old, F.col("surplus")).otherwise(0)).alias("n_frozen"), F.sum(F.when(new, -F.col("surplus")).otherwise(0)).alias("n_rebuilt"), *facts)
    same = lambda c, f: F.col(f"_{c}_{f}_a").eqNullSafe(F.col(f"_{c}_{f}_b"))
    names = F.array_compact(F.array(*(F.when(~(same(c, "min") & same(c, "max") & (same(c, "count") | (F.col("n_frozen") != F.col("n_rebuilt")))), F.lit(c)) for c in fields)))
    verdict = F.when(F.col("n_rebuilt") == 0, "unexpected").when(F.col("n_frozen") == 0, "missing").otherwise("changed")
    named = F.when(verdict != "changed", F.array().cast("array<string>")).when(F.size(names) == 0, F.array(F.lit("combination"))).otherwise(names)
    return one.select(*keys, "n_frozen", "n_rebuilt", verdict.alias("verdict"), named.alias("fields"))


def stale_catalogue(frozen: DataFrame, snapshots: DataFrame, phrases: tuple[str, ...] = (), banned: tuple[str, ...] = ()) -> DataFrame:
    """(snapshot_id, id, problem, fields): what a frozen evaluation holds that its raw snapshot doesn't give.

    problem is an entry's verdict of `changes`, or evidence_missing or evidence_malformed, without an id, for all
    entries of a snapshot that is lost or can't be read. frozen: snapshot_id, id and FIELDS.
    """
    readable = snapshots.groupBy("snapshot_id").agg(F.min(F.from_json("body", ENTRY).isNotNull()).alias("_ok"))
    entries = changes(frozen, evaluated(snapshots, phrases, banned), ("snapshot_id", "id"), FIELDS)
    sound = entries.join(readable.where("_ok"), "snapshot_id", "left_semi").select("snapshot_id", "id", F.col("verdict").alias("problem"), "fields")
    lost = frozen.select("snapshot_id").distinct().join(readable, "snapshot_id", "left_anti").withColumn("problem", F.lit("evidence_missing"))
    broken = readable.where("NOT _ok").select("snapshot_id", F.lit("evidence_malformed").alias("problem"))
    whole = lost.unionByName(broken).select("snapshot_id", F.lit(None).cast("string").alias("id"), "problem", F.array().cast("array<string>").alias("fields"))
    return sound.unionByName(whole)


def decisions(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A row per snapshot: the first candidate that passed, unless one before it is unresolved.

    candidates: as `evaluated` gives them; verdicts: snapshot_id, id, verdict (PASS, FAIL, INCOMPLETE, NOT_RUN; none counts as
    NOT_RUN, and of several for one candidate the last in that order counts). status is SELECTABLE, BLOCKED (blocker
    names the state of the earlier candidate), EXHAUSTED (all failed) or NO_CANDIDATE.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("PASS", "FAIL", "INCOMPLETE", "NOT_RUN"))), F.col("verdict")), F.lit(0))
    one = verdicts.groupBy("snapshot_id", "id").agg(F.max_by("verdict", rank).alias("verdict"))
    j = candidates.select("snapshot_id", "id", "position", "completion_limit_parameter").join(one, ["snapshot_id", "id"], "left")
    verdict = F.coalesce("verdict", F.lit("NOT_RUN"))
    at = F.struct("position", "id", "completion_limit_parameter", verdict.alias("verdict"))
    chosen = F.col("position").isNotNull()
    ordered = F.transform(F.array_sort(F.collect_list(F.when(chosen, F.struct("position", "id")))), lambda x: x["id"])
    g = j.groupBy("snapshot_id").agg(F.min(F.when(chosen & (verdict == "PASS"), at)).alias("p"), F.min(F.when(chosen & verdict.isin("NOT_RUN", "INCOMPLETE"), at)).alias("u"), ordered.alias("candidate_ordering"))
    p, u = F.col("p"), F.col("u")
    free = p.isNotNull() & (u.isNull() | (p["position"] < u["position"]))
    status = F.when(free, "SELECTABLE").when(u.isNotNull(), "BLOCKED").when(F.size("candidate_ordering") > 0, "EXHAUSTED").otherwise("NO_CANDIDATE")
    blocker = F.when(status == "BLOCKED", F.concat(F.lit("earlier_candidate_"), F.lower(u["verdict"])))
    return g.select("snapshot_id", status.alias("status"), blocker.alias("blocker"), F.when(free, p["id"]).alias("selected_model_id"), F.when(free, p["completion_limit_parameter"]).alias("completion_limit_parameter"), "candidate_ordering", hashing.canonical_json_hash(F.to_json("candidate_ordering")).alias("candidate_ordering_hash"))


def selection_problems(records: DataFrame, decided: DataFrame) -> DataFrame:
    """Each frozen selection with the names of what no longer holds: not_selectable, or the fields that differ; a record of a
    snapshot without evidence has evidence_missing."""
    fields = ("selected_model_id", "completion_limit_parameter", "candidate_ordering_hash")
    j = records.join(decided.select("snapshot_id", "status", *(F.col(c).alias(f"_{c}") for c in fields)), "snapshot_id", "left")
    lost = F.col("status").isNull()
    found = [F.when(lost, F.lit("evidence_missing")), F.when(F.col("status") != "SELECTABLE", F.lit("not_selectable")), *(F.when(~lost & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in fields)]
    return j.withColumn("problems", F.array_compact(F.array(*found))).drop("status", *(f"_{c}" for c in fields))


def bundle_problems(items: DataFrame, members: DataFrame, sources: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """(bundle_id, bundle_path, problem) of bundles whose files or sources are no longer what their listing says.

    items: bundle_id, bundle_path, source_scope, source_path, sha256, as recorded; members: bundle_id, bundle_path, sha256 of the
    files there are; sources: source_scope, source_path, sha256 of today's. Problems: listed_twice, not_in_bundle,
    bundle_mismatch, unknown_scope, source_missing, source_mismatch, unlisted. A digest that is null matches none.
    """
    at = ["bundle_id", "bundle_path"]
    listed = items.groupBy(*at).agg(F.count("*").alias("n"), F.max(F.struct("source_scope", "source_path", "sha256")).alias("i"), F.lit(True).alias("listed"))
    listed = listed.select(*at, "n", "listed", "i.source_scope", "i.source_path", "i.sha256")
    there = members.groupBy(*at).agg(F.max("sha256").alias("own"), F.lit(True).alias("here"))
    today = sources.groupBy("source_scope", "source_path").agg(F.max("sha256").alias("now"), F.lit(True).alias("kept"))
    j = listed.join(there, at, "full_outer").join(today, ["source_scope", "source_path"], "left")
    known = F.coalesce(F.col("source_scope").isin(*scopes), F.lit(False))
    differs = lambda c: F.coalesce(F.col(c) != F.col("sha256"), F.lit(True))
    on, rules = F.col("listed").isNotNull(), []
    rules += [("listed_twice", on & (F.col("n") > 1)), ("not_in_bundle", on & F.col("here").isNull()), ("bundle_mismatch", on & F.col("here").isNotNull() & differs("own"))]
    rules += [("unknown_scope", on & ~known), ("source_missing", on & known & F.col("kept").isNull()), ("source_mismatch", on & known & F.col("kept").isNotNull() & differs("now")), ("unlisted", ~on)]
    return j.select(*at, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))).alias("problem"))


def stale_artifacts(artifacts: DataFrame, uses: DataFrame) -> DataFrame:
    """(artifact_id, distance): what has to be made again because something it was made from has changed.

    artifacts: artifact_id and sha256, as they are today; uses: artifact_id, source_id and source_sha256, what the source was
    when it was used. An artifact one of whose sources is lost or has another digest is at distance 0; one that uses
    a stale artifact is a step further than the nearest. Cycles end. A round is a join for each level of
    dependence, over that level's artifacts only; rounds are written to the shared folder.
    """
    from cohortflow.sources.event_store import shared_folder

    spark = artifacts.sparkSession
    shared_folder(spark)
    now = artifacts.groupBy("artifact_id").agg(F.max("sha256").alias("now")).withColumnRenamed("artifact_id", "source_id")
    off = F.coalesce(F.col("now") != F.col("source_sha256"), F.lit(True))
    found = level = uses.join(now, "source_id", "left").where(off).select("artifact_id").distinct().withColumn("distance", F.lit(0)).checkpoint()
    edges = uses.select("artifact_id", "source_id").distinct()
    for distance in range(1, 1 << 30):
        above = edges.join(level.select(F.col("artifact_id").alias("source_id")), "source_id").select("artifact_id").distinct()
        level = above.join(found, "artifact_id", "left_anti").withColumn("distance", F.lit(distance)).checkpoint()
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    return found


#: What a status row says; anything else in it is refused.
STATUS_FIELDS = ("version", "replacement_endpoint_status", "pilot_status", "final_pair_status", "final_pair_source", "replacement_required", "main_study_status", "blocker", "intended_model_a", "intended_model_b")


def status_guards(statuses: DataFrame, version: str, keys: Sequence[str] = ()) -> DataFrame:
    """replacement_not_frozen and pair_not_qualified of each status row; a null counts as not yet.

    A column that isn't of STATUS_FIELDS or the keys is refused, as is a missing one; a row of another version fails the query.
    """
    odd = set(statuses.columns) ^ {*STATUS_FIELDS, *keys}
    if odd:
        raise ValueError(f"unknown or missing status fields: {sorted(odd)}")
    right = F.col("version").eqNullSafe(F.lit(version))
    checked = lambda c: F.when(right, c).otherwise(F.raise_error(F.concat(F.lit(f"expected {version}, got "), F.coalesce("version", F.lit("null")))))
    frozen, qualified = (F.coalesce(F.col(c) == v, F.lit(False)) for c, v in (("replacement_endpoint_status", "FROZEN"), ("final_pair_status", "QUALIFIED")))
    return statuses.withColumns({"replacement_not_frozen": checked(F.coalesce("replacement_required", F.lit(True)) & ~frozen), "pair_not_qualified": checked(~qualified)})
