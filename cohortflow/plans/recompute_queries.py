"""Queries of recomputed catalogues, selections, bundles, what was built on them, and status guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions import hashing
from cohortflow.operators import recompute
from cohortflow.plans.event_queries import _table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# A catalogue for each customer with an entry for each of its orders; since it was frozen some entries came, some went,
# some cost something. Every seventh was never eligible, every eleventh has a phrase that warns.
_CATALOGUES = """o AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS k, 'vendor/m' || o_orderkey || ':free' AS id FROM orders),
f AS (SELECT *, k % 7 <> 0 AS ok, CASE WHEN k % 7 <> 0 THEN row_number() OVER (PARTITION BY c, k % 7 <> 0 ORDER BY k % 11 = 0, id) END AS pos FROM o WHERE k % 31 <> 0),
t AS (SELECT *, k % 7 <> 0 AND k % 23 <> 0 AS ok, CASE WHEN k % 7 <> 0 AND k % 23 <> 0 THEN row_number() OVER (PARTITION BY c, k % 7 <> 0 AND k % 23 <> 0 ORDER BY k % 11 = 0, id) END AS pos FROM o WHERE k % 29 <> 0 AND c % 17 <> 0 AND c % 19 <> 0)"""
_PHRASES = ("medical",)


def _snapshots(spark, sf_dir, today: bool):
    """Raw catalogues as JSON texts; of today's, some are lost and some cut off. One whose entries have all gone is an empty list."""
    k = F.col("o_orderkey")
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").distinct()
    listed = (k % 29 != 0) if today else (k % 31 != 0)
    price = F.when((k % 23 == 0) & F.lit(today), "0.5").otherwise("0")
    texts = F.array(F.lit("text"))
    entry = F.struct(
        F.concat(F.lit("vendor/m"), k.cast("string"), F.lit(":free")).alias("id"),
        F.when(k % 11 == 0, "A Medical model").otherwise("A model").alias("name"),
        F.when(k % 7 == 0, 1024).otherwise(65536).alias("context_length"),
        F.struct(price.alias("prompt"), F.lit("0").alias("completion")).alias("pricing"),
        F.struct(texts.alias("input_modalities"), texts.alias("output_modalities")).alias("architecture"),
        F.array(F.lit("seed"), F.lit("max_tokens")).alias("supported_parameters"),
        F.struct(F.lit(8192).alias("max_completion_tokens")).alias("top_provider"),
        F.lit("active").alias("status"),
    )
    body = F.to_json(F.collect_list(F.when(listed, entry)))  # a customer's orders
    if today:
        body = F.when(F.col("o_custkey") % 17 == 0, F.concat(F.lit("<"), body)).otherwise(body)
    found = o.groupBy(F.col("o_custkey").alias("snapshot_id")).agg(body.alias("body"), F.count(F.when(listed, 1)).alias("n"))
    found = found.where("CASE WHEN snapshot_id % 17 = 0 THEN n > 0 ELSE snapshot_id % 19 <> 0 END") if today else found
    return found.select("snapshot_id", F.to_timestamp(F.lit("2026-09-01 00:00:00")).alias("retrieved_at"), "body")


@query(f"""WITH {_CATALOGUES}, b AS (SELECT * FROM f WHERE c % 17 <> 0 AND c % 19 <> 0), j AS (SELECT coalesce(b.c, t.c) AS snapshot_id, coalesce(b.id, t.id) AS id, coalesce(b.k, t.k) AS k, b.c IS NULL AS fresh, t.c IS NULL AS gone, b.ok AS ok, b.pos IS DISTINCT FROM t.pos AS moved FROM b FULL JOIN t USING (c, id)),
d AS (SELECT *, CASE WHEN fresh OR gone THEN '' ELSE array_to_string(list_filter([CASE WHEN k % 23 = 0 THEN 'prompt_price' END, CASE WHEN k % 23 = 0 THEN 'rejection_reasons' END, CASE WHEN k % 23 = 0 AND ok THEN 'eligible' END, CASE WHEN moved THEN 'position' END], lambda x: x IS NOT NULL), ',') END AS fields FROM j)
SELECT snapshot_id, id, CASE WHEN fresh THEN 'missing' WHEN gone THEN 'unexpected' ELSE 'changed' END AS problem, fields FROM d WHERE fresh OR gone OR fields <> ''
UNION ALL SELECT c, NULL, 'evidence_malformed', '' FROM o WHERE c % 17 = 0 AND k % 29 <> 0 GROUP BY c
UNION ALL SELECT c, NULL, 'evidence_missing', '' FROM f WHERE (c % 17 <> 0 AND c % 19 = 0) OR (c % 17 = 0 AND c NOT IN (SELECT c FROM o WHERE k % 29 <> 0)) GROUP BY c""")
def catalogue_recomputation(spark, sf_dir):
    """Frozen evaluations against those of today's raw catalogues."""
    frozen = recompute.evaluated(_snapshots(spark, sf_dir, False), _PHRASES)
    return recompute.stale_catalogue(frozen, _snapshots(spark, sf_dir, True), _PHRASES).withColumn("fields", F.array_join("fields", ","))


_DECIDED = lambda s: f"""SELECT c, CASE WHEN p IS NOT NULL AND (u IS NULL OR p < u) THEN 'SELECTABLE' WHEN u IS NOT NULL THEN 'BLOCKED' WHEN n > 0 THEN 'EXHAUSTED' ELSE 'NO_CANDIDATE' END AS status, CASE WHEN p IS NOT NULL AND (u IS NULL OR p < u) THEN pid END AS model, CASE WHEN u IS NOT NULL AND (p IS NULL OR p > u) THEN 'earlier_candidate_' || lower(uv) END AS blocker, sha256('[' || coalesce(ids, '') || ']') AS h
  FROM (SELECT c, min(pos) FILTER (WHERE v = 'PASS') AS p, min_by(id, pos) FILTER (WHERE v = 'PASS' AND pos IS NOT NULL) AS pid, min(pos) FILTER (WHERE v IN ('NOT_RUN', 'INCOMPLETE')) AS u, min_by(v, pos) FILTER (WHERE v IN ('NOT_RUN', 'INCOMPLETE') AND pos IS NOT NULL) AS uv, count(pos) AS n, string_agg('"' || id || '"', ',' ORDER BY pos) FILTER (WHERE pos IS NOT NULL) AS ids
    FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 'PASS' WHEN k % 9 = 1 THEN 'INCOMPLETE' WHEN k % 13 = 1 THEN 'NOT_RUN' ELSE 'FAIL' END AS v FROM {s}) GROUP BY c)"""  # noqa: E731


@query(f"""WITH {_CATALOGUES}, a AS ({_DECIDED("f")}), b AS ({_DECIDED("t")})
SELECT a.c AS snapshot_id, a.model AS selected_model_id, b.status AS status, b.blocker AS blocker, CASE WHEN b.c IS NULL THEN 'evidence_missing' ELSE array_to_string(list_filter([CASE WHEN b.status <> 'SELECTABLE' THEN 'not_selectable' END, CASE WHEN a.model IS DISTINCT FROM b.model THEN 'selected_model_id' END, CASE WHEN b.status <> 'SELECTABLE' THEN 'completion_limit_parameter' END, CASE WHEN a.h <> b.h THEN 'candidate_ordering_hash' END], lambda x: x IS NOT NULL), ',') END AS problems
FROM a LEFT JOIN b USING (c) WHERE a.status = 'SELECTABLE'""")
def selection_recomputation(spark, sf_dir):
    """Frozen selections against those that today's catalogues and the screens' verdicts lead to."""
    k = F.regexp_extract("id", r"m(\d+):", 1).cast("long")
    decided = []
    for today in (False, True):
        candidates = recompute.evaluated(_snapshots(spark, sf_dir, today), _PHRASES)
        verdicts = candidates.select("snapshot_id", "id", F.when(k % 4 == 0, "PASS").when(k % 9 == 1, "INCOMPLETE").when(k % 13 != 1, "FAIL").alias("verdict")).where("verdict IS NOT NULL")
        decided.append(recompute.decisions(candidates, verdicts))
    records = decided[0].where("status = 'SELECTABLE'").select("snapshot_id", "selected_model_id", "completion_limit_parameter", "candidate_ordering_hash")
    found = recompute.selection_problems(records, decided[1]).select("snapshot_id", "selected_model_id", F.array_join("problems", ",").alias("problems"))
    return found.join(decided[1].select("snapshot_id", "status", "blocker"), "snapshot_id", "left").select("snapshot_id", "selected_model_id", "status", "blocker", "problems")


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
i AS (SELECT *, (o + n) AS s, CASE WHEN p % 41 = 0 THEN 'elsewhere' ELSE 'known' END AS scope, 'f' || n AS bundle_path FROM l),
q AS (SELECT i.*, r.p_partkey IS NOT NULL AS kept FROM i LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_partkey % 59 <> 0) r ON i.p = r.p_partkey)
SELECT o AS bundle_id, bundle_path, unnest(list_filter([CASE WHEN s % 53 = 0 THEN 'listed_twice' END, CASE WHEN s % 37 = 0 THEN 'not_in_bundle' END, CASE WHEN s % 37 <> 0 AND s % 43 = 0 THEN 'bundle_mismatch' END, CASE WHEN scope = 'elsewhere' THEN 'unknown_scope' END,
  CASE WHEN scope = 'known' AND NOT kept THEN 'source_missing' END, CASE WHEN scope = 'known' AND kept AND p % 13 = 0 THEN 'source_mismatch' END], lambda x: x IS NOT NULL)) AS problem FROM q
UNION ALL SELECT DISTINCT o, 'extra', 'unlisted' FROM l WHERE o % 47 = 0""")
def bundle_staleness(spark, sf_dir):
    """A bundle for each order, a file for each line: what is lost, altered, listed twice or not at all, or has another source by now."""
    p, s = F.col("p"), F.col("bundle_id") + F.col("l_linenumber")
    sha = lambda c, end: hashing.portable_hash(F.concat(F.lit("part "), c.cast("string"), end))
    scope = lambda c: F.when(c % 41 == 0, "elsewhere").when(c % 2 == 0, "repository").otherwise("artifact")
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bundle_id"), "l_linenumber").agg(F.min("l_partkey").alias("p"))
    listed = lines.withColumns({"bundle_path": F.concat(F.lit("f"), F.col("l_linenumber").cast("string")), "sha256": sha(p, F.lit("\n"))})
    copies = F.explode(F.when(s % 53 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    items = listed.select("bundle_id", "bundle_path", scope(p).alias("source_scope"), F.concat(F.lit("p"), p.cast("string")).alias("source_path"), "sha256", copies.alias("copy")).drop("copy")
    members = listed.where(s % 37 != 0).select("bundle_id", "bundle_path", F.when(s % 43 == 0, "altered").otherwise(F.col("sha256")).alias("sha256"))
    extra = lines.select("bundle_id").distinct().where("bundle_id % 47 = 0").select("bundle_id", F.lit("extra").alias("bundle_path"), F.lit("any").alias("sha256"))
    k = F.col("p_partkey")
    end = F.when(k % 13 == 0, " altered\n").when(k % 3 == 0, "\r\n").otherwise("\n")
    sources = _table(spark, sf_dir, "part").where(k % 59 != 0).select(scope(k).alias("source_scope"), F.concat(F.lit("p"), k.cast("string")).alias("source_path"), sha(k, end).alias("sha256"))
    return recompute.bundle_problems(items, members.unionByName(extra), sources, ("repository", "artifact"))


@query("""WITH RECURSIVE o AS (SELECT DISTINCT o_orderkey AS k FROM orders), s(k, d) AS (SELECT k, 0 FROM o WHERE k >= 4 AND (k % 97 = 0 OR k // 4 NOT IN (SELECT k FROM o)) UNION SELECT o.k, s.d + 1 FROM o JOIN s ON o.k >= 4 AND o.k // 4 = s.k)
SELECT k AS artifact_id, min(d) AS distance FROM s GROUP BY k""")
def stale_artifacts(spark, sf_dir):
    """An artifact for each order, made from the one with a quarter of its number; every 97th from an older state of it."""
    k = F.col("o_orderkey")
    sha = lambda c: F.sha2(c.cast("string"), 256)
    o = _table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    source = F.floor(k / 4).cast("long")
    uses = o.where(k >= 4).select(k.alias("artifact_id"), source.alias("source_id"), F.when(k % 97 == 0, "older").otherwise(sha(source)).alias("source_sha256"))
    return recompute.stale_artifacts(o.select(k.alias("artifact_id"), sha(k).alias("sha256")), uses)


@query("""SELECT o_orderkey, o_orderstatus <> 'O' AND o_orderkey % 3 > 0 AS replacement_not_frozen, o_orderkey % 5 > 0 AS pair_not_qualified FROM orders""")
def study_status_guards(spark, sf_dir):
    """A status row for each order."""
    k, text = F.col("o_orderkey"), F.lit("x")
    given = {"version": F.lit("status-2"), "replacement_endpoint_status": F.when(k % 3 == 0, "FROZEN").when(k % 3 == 1, "OPEN"), "final_pair_status": F.when(k % 5 == 0, "QUALIFIED").when(k % 5 == 1, "OPEN"), "replacement_required": F.col("o_orderstatus") != "O"}
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", *(given.get(c, text).alias(c) for c in recompute.STATUS_FIELDS))
    return recompute.status_guards(rows, "status-2", ("o_orderkey",)).select("o_orderkey", "replacement_not_frozen", "pair_not_qualified")
