"""Queries of embedded errors, calibration, rule files, reliability from logs, cluster bootstraps and evidence labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions import hashing, literals, taxonomy
from cohortflow.operators import agreement, baseline, bootstrap, calibration, rules, telemetry
from cohortflow.plans.event_queries import _table
from cohortflow.plans.rating_queries import _kappa_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- embedded errors -------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, event_type, 380 + CAST(event_id % 250 AS INT) AS code, event_id % 9 AS form FROM events),
p AS (SELECT *, CASE WHEN form IN (0, 1, 4) THEN code WHEN form = 6 THEN CASE event_id % 4 WHEN 0 THEN 503 END WHEN form = 7 THEN 402 END AS raw_code,
  CASE WHEN form IN (0, 3, 4) THEN event_type || ' it''s "so"' WHEN form = 1 THEN event_type || ' plain' WHEN form = 7 THEN 'pay' END AS embedded_message FROM e),
c AS (SELECT *, CASE WHEN raw_code BETWEEN 100 AND 599 THEN raw_code END AS embedded_code FROM p)
SELECT event_id, embedded_code, embedded_message, CASE WHEN embedded_code = 402 THEN 'operator_recoverable' WHEN embedded_code IN (408, 429, 500, 502, 503, 504) THEN 'upstream_transient' ELSE 'permanent' END AS category,
  coalesce(embedded_code IN (408, 429, 500, 502, 503, 504), false) AS retryable, CASE WHEN embedded_code IS NULL THEN 'provider_body_error' ELSE 'upstream_http_' || embedded_code END AS reason_code FROM c""")
def embedded_error_codes(spark, sf_dir):
    """Messages of nine forms, some of them no literals at all; what they hold goes on into the classification of errors."""
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", (380 + F.col("event_id") % 250).cast("string").alias("code"))
    q, slash = F.lit('"'), F.lit("\\")
    said = F.concat(F.lit("'"), "event_type", F.lit(" it"), slash, F.lit("'s "), slash, q, F.lit("so"), q, F.lit("'"))
    forms = [
        F.concat(F.lit("{'code': "), "code", F.lit(", 'message': "), said, F.lit("}")),
        F.concat(F.lit("{'metadata': {'raw': [1, (2.5e3, None), {'x', b'y'}]}, 'code': ' "), "code", F.lit(" ', 'message': '  "), "event_type", F.lit("' ' \\n plain',}")),
        F.concat(F.lit("{'code': "), "code", F.lit(", 'message': "), said),
        F.concat(F.lit("{'code': True, 'message': "), said, F.lit("}")),
        F.concat(F.lit("{'error': {'code': "), "code", F.lit(", 'message': "), said, F.lit("}}")),
        F.concat(F.lit("[{'code': "), "code", F.lit("}]")),
        F.concat(F.lit("{'code': "), F.when(F.col("event_id") % 4 == 0, "503").otherwise("(503)[0]"), F.lit(", 'deep': "), F.repeat(F.lit("["), 300), F.repeat(F.lit("]"), 300), F.lit("}")),
        F.concat(F.lit("{'code': 0x192, 'message': r'pay'}")),
        F.concat(F.lit("upstream said "), "code"),
    ]
    form = F.col("event_id") % 9
    text = forms[8]
    for i, f in enumerate(forms[:8]):
        text = F.when(form == i, f).otherwise(text)
    parsed = literals.embedded_errors(e.withColumns({"error_message": text, "error_type": F.lit("provider_body_error")}), within="error")
    return taxonomy.classify_errors(parsed, upstream="embedded_code").select("event_id", "embedded_code", "embedded_message", "category", "retryable", "reason_code")


# --- calibration -----------------------------------------------------------------------------------------------------

_CONDITION = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(calibration.CONDITIONS))
_STATES = ", ".join(f"max(f) FILTER (WHERE condition = '{c}') AS {c}, max(t) FILTER (WHERE condition = '{c}') AS t_{c}, count(*) FILTER (WHERE condition = '{c}') AS n_{c}" for c in calibration.CONDITIONS)


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 < 6 THEN CASE o_orderkey % 11 % 2 WHEN 0 THEN 0 ELSE 1 END ELSE o_orderkey % 8 END AS c FROM orders),
r AS (SELECT o_custkey AS study_id, CASE c {_CONDITION} END AS condition, CASE WHEN min(o_orderkey) % 10 < 4 + 3 * (c % 2) THEN 'stop' WHEN min(o_orderkey) % 10 = 9 THEN NULL ELSE 'length' END AS f,
    CASE WHEN min(o_orderkey) % 7 > 0 THEN CASE WHEN min(o_orderkey) % 5 = 0 THEN 0 ELSE min(o_orderkey) % 900 END END AS t, min(o_orderkey) % 23 > 0 AS responded FROM o GROUP BY o_custkey, c),
s AS (SELECT c_custkey AS study_id, count(condition) AS requests, coalesce(bool_or(NOT responded), false) AS stopped, {_STATES} FROM customer LEFT JOIN r ON study_id = c_custkey GROUP BY c_custkey)
SELECT study_id, requests,
  CASE WHEN native_1024 = 'length' AND disabled_1024 = 'stop' AND t_native_1024 > t_disabled_1024 THEN 'SUPPORTED' WHEN native_1024 = 'length' AND t_native_1024 = 0 AND t_disabled_1024 = 0 THEN 'NOT_SUPPORTED'
    WHEN requests > 0 THEN 'INCONCLUSIVE' ELSE 'NOT_RUN' END AS verdict,
  CASE WHEN requests >= 6 OR stopped THEN NULL WHEN n_native_1024 = 0 THEN 'native_1024' WHEN n_disabled_1024 = 0 THEN 'disabled_1024'
    WHEN native_1024 = 'length' AND disabled_1024 = 'length' THEN CASE WHEN n_disabled_2048 = 0 THEN 'disabled_2048' WHEN disabled_2048 = 'length' AND n_disabled_4096 = 0 THEN 'disabled_4096' END
    WHEN native_1024 = 'length' AND disabled_1024 = 'stop' THEN CASE WHEN n_native_1024_repeat = 0 THEN 'native_1024_repeat' WHEN n_disabled_1024_repeat = 0 THEN 'disabled_1024_repeat'
      WHEN native_1024_repeat = 'length' AND disabled_1024_repeat = 'stop' AND n_native_2048 = 0 THEN 'native_2048' WHEN native_2048 = 'length' AND n_native_4096 = 0 THEN 'native_4096' END END AS next_condition
FROM s""")
def adaptive_condition(spark, sf_dir):
    """A study for each customer, a request for each condition that its orders stand for."""
    k = F.col("o_orderkey")
    place = F.when(k % 11 < 6, k % 11 % 2).otherwise(k % 8)
    o = _table(spark, sf_dir, "orders").groupBy("o_custkey", place.cast("int").alias("c")).agg(F.min("o_orderkey").alias("k"))
    k = F.col("k")
    records = o.select(
        F.col("o_custkey").alias("study_id"),
        F.element_at(F.array(*map(F.lit, calibration.CONDITIONS)), F.col("c") + 1).alias("condition"),
        F.when(k % 10 < 4 + 3 * (F.col("c") % 2), "stop").when(k % 10 != 9, "length").alias("finish_reason"),
        F.when(k % 5 == 0, 0).otherwise(k % 900).alias("reasoning_tokens"),
        (k % 7 > 0).alias("has_usage"),
        (k % 23 > 0).alias("responded"),
    )
    return calibration.calibration(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study_id")), records)


# --- rule files ------------------------------------------------------------------------------------------------------

_MANIFEST = """m AS (SELECT 'run_' || (o_orderkey - CASE WHEN o_orderkey % 97 = 0 AND o_orderkey > 0 THEN 1 ELSE 0 END) AS run_id, 'theme_' || (o_orderkey % 3) AS theme, CASE o_orderstatus WHEN 'F' THEN 'fixed_belief' WHEN 'O' THEN 'control' ELSE 'ambiguous' END AS presentation_level,
  'model_' || (o_custkey % 2) AS model_slot, o_custkey % 4 < 2 AS context_condition, CAST(1 + o_orderkey % 2 AS INT) AS repetition,
  CASE WHEN o_orderkey % 50 = 1 THEN 'maker/model-latest:free' WHEN o_orderkey % 50 = 2 THEN 'maker/model' ELSE 'maker/model-' || (o_custkey % 2) || ':free' END AS requested_model_id,
  CASE WHEN o_orderkey % 40 = 3 THEN 'generation-v3' ELSE 'generation-v4' END AS generation_config_version, CASE WHEN o_orderkey % 30 = 4 THEN 0 ELSE 100 + o_orderkey % 2 END AS planned_seed,
  CASE WHEN o_orderkey % 60 = 5 THEN NULL ELSE 'v2' END AS study_version, o_orderkey + 1 AS execution_order FROM orders)"""


@query(f"""WITH {_MANIFEST}, g AS (SELECT count(*) AS c FROM m GROUP BY theme, presentation_level, model_slot, context_condition, repetition), n AS (SELECT count(*) AS n, count(DISTINCT model_slot) AS s, count(DISTINCT execution_order) AS d, min(execution_order) AS lo, max(execution_order) AS hi FROM m)
SELECT 1 AS position, 'exactly_two_model_slots' AS rule, 'table' AS level, CAST(s <> 2 AS BIGINT) AS violations, s = 2 AS passes FROM n
UNION ALL SELECT 2, 'configured_model_slots', 'table', CAST(count(*) > 0 AS BIGINT), count(*) = 0 FROM m WHERE model_slot NOT IN ('model_0', 'model_1')
UNION ALL SELECT 3, 'configured_model_id', 'row', count(*), count(*) = 0 FROM m WHERE requested_model_id <> 'maker/' || replace(model_slot, '_', '-') || ':free'
UNION ALL SELECT 4, 'configured_generation_version', 'row', count(*), count(*) = 0 FROM m WHERE generation_config_version <> 'generation-v4'
UNION ALL SELECT 5, 'configured_seed', 'row', count(*), count(*) = 0 FROM m WHERE planned_seed <> 99 + repetition
UNION ALL SELECT 6, 'frozen_study_version', 'row', count(*), count(*) = 0 FROM m WHERE study_version IS DISTINCT FROM 'v2'
UNION ALL SELECT 7, 'fixed_free_model_id', 'row', count(*), count(*) = 0 FROM m WHERE requested_model_id LIKE '%latest%' OR requested_model_id NOT LIKE '%:free'
UNION ALL SELECT 8, 'expected_row_count', 'table', CAST(n <> 72 OR n <> 36 * s AS BIGINT), n = 72 AND n = 36 * s FROM n
UNION ALL SELECT 9, 'unique_run_ids', 'group', count(*), count(*) = 0 FROM (SELECT run_id FROM m GROUP BY run_id HAVING count(*) > 1)
UNION ALL SELECT 10, 'complete_execution_order', 'table', CAST(lo <> 1 OR hi <> n OR d <> n AS BIGINT), lo = 1 AND hi = n AND d = n FROM n
UNION ALL SELECT 11, 'balanced_cells', 'group', count(*) FILTER (WHERE c <> 1), count(*) FILTER (WHERE c <> 1) = 0 FROM g
UNION ALL SELECT 12, 'all_cells_present', 'table', CAST((SELECT count(*) FROM g) <> 36 * s AS BIGINT), (SELECT count(*) FROM g) = 36 * s FROM n
UNION ALL SELECT 13, 'planned_response_slots', 'table', CAST(6 * n <> 432 AS BIGINT), 6 * n = 432 FROM n""")
def manifest_rules(spark, sf_dir):
    """All rules of a manifest over a plan with a row for each order; most of them are broken by design."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    plan = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), s(k - F.when((k % 97 == 0) & (k > 0), 1).otherwise(0))).alias("run_id"),
        F.concat(F.lit("theme_"), s(k % 3)).alias("theme"),
        F.when(F.col("o_orderstatus") == "F", "fixed_belief").when(F.col("o_orderstatus") == "O", "control").otherwise("ambiguous").alias("presentation_level"),
        F.concat(F.lit("model_"), s(c % 2)).alias("model_slot"),
        (c % 4 < 2).alias("context_condition"),
        (1 + k % 2).cast("int").alias("repetition"),
        F.when(k % 50 == 1, "maker/model-latest:free").when(k % 50 == 2, "maker/model").otherwise(F.concat(F.lit("maker/model-"), s(c % 2), F.lit(":free"))).alias("requested_model_id"),
        F.when(k % 40 == 3, "generation-v3").otherwise("generation-v4").alias("generation_config_version"),
        F.when(k % 30 == 4, 0).otherwise(100 + k % 2).alias("planned_seed"),
        F.when(k % 60 != 5, "v2").alias("study_version"),
        (k + 1).alias("execution_order"),
    )
    return rules.violations(plan, rules.bundled("manifest-v2"), manifest_parameters(["model_0", "model_1"], ["maker/model-0:free", "maker/model-1:free"], {1: 100, 2: 101}, "generation-v4", "v2"))


def manifest_parameters(slots, ids, seeds, generation, study):
    """The configuration that manifest-v2 compares with, as its `param`."""
    text = lambda xs: F.array(*map(F.lit, xs))
    return F.struct(
        text(sorted(slots)).alias("model_slots"),
        F.map_from_arrays(text(slots), text(ids)).alias("model_ids"),
        F.map_from_arrays(F.array(*map(F.lit, seeds)), F.array(*(F.lit(v).cast("long") for v in seeds.values()))).alias("seeds"),
        F.lit(generation).alias("generation_version"),
        F.lit(study).alias("study_version"),
        F.lit(72).alias("planned_rows"),
        F.lit(432).alias("planned_responses"),
    )


#: (field, value that breaks it, the checks that then fail), one for each kind of fault; {x} is the order's key.
FAULTS = (
    ("header.study_version", "'v1'", ("study version",)),
    ("header.run_id", "'run_x'", ("run ID",)),
    ("event.turn_number", "7", ("turn number",)),
    ("event.event_id", "'e'", ("event ID",)),
    ("event.request_payload_hash", "NULL", ("request payload hash",)),
    ("amendment.generation_id", "'g'", ("generation ID",)),
    ("event.request_model_id", "'m'", ("requested model",)),
    ("amendment.resolved_model_id", "NULL", ("resolved model",)),
    ("result.resolved_model_id", "'m'", ("resolved model", "requested/resolved identity")),
    ("amendment.provider_name", "'p'", ("provider",)),
    ("result.status", "'error'", ("response status",)),
    ("result.text", "'  '", ("non-empty content",)),
    ("metadata.choice_count", "2", ("choice count",)),
    ("metadata.content_present", "NULL", ("content presence",)),
    ("result.finish_reason", "'stop'", ("result finish reason",)),
    ("metadata.finish_reason", "'stop'", ("metadata finish reason",)),
    ("metadata.native_finish_reason", "'stop'", ("native finish reason",)),
    ("result.truncated", "true", ("not truncated",)),
    ("usage.completion_tokens", "NULL", ("completion usage present", "completion usage exact", "completion usage positive", "completion below envelope", "external completion usage")),
    ("amendment.completion_tokens", "5", ("completion usage exact",)),
    ("usage.completion_tokens", "0", ("completion usage exact", "completion usage positive", "external completion usage")),
    ("header.completion_envelope_tokens", "9", ("completion below envelope",)),
    ("result.error_message", "'bad'", ("no stored error",)),
    ("external.generation_id", "'g'", ("external generation ID",)),
    ("external.provider_name", "NULL", ("external provider",)),
    ("external.tokens_prompt", "1", ("external prompt usage",)),
    ("external.native_tokens_completion", "1", ("external completion usage",)),
    ("external.native_finish_reason", "'stop'", ("external finish metadata",)),
    ("external.cancelled", "true", ("external not cancelled",)),
)

_EVIDENCE = {
    "header": {"study_version": "'v2'", "run_id": "concat('run_', x)", "requested_model_id": "'maker/model:free'", "completion_envelope_tokens": "4096"},
    "event": {"run_id": "concat('run_', x)", "turn_number": "CAST(1 + x % 6 AS INT)", "event_id": "concat('event_', x)", "request_payload_hash": "sha2(CAST(x AS STRING), 256)", "request_model_id": "'maker/model:free'"},
    "result": {"generation_id": "concat('gen_', x)", "requested_model_id": "'maker/model:free'", "resolved_model_id": "'maker/model:free'", "provider_name": "'maker'", "status": "'response'", "text": "concat('text ', x)", "finish_reason": "CAST(NULL AS STRING)", "truncated": "false", "error_type": "CAST(NULL AS STRING)", "error_message": "CAST(NULL AS STRING)"},
    "metadata": {"choice_count": "1", "content_present": "true", "finish_reason": "CAST(NULL AS STRING)", "native_finish_reason": "CAST(NULL AS STRING)"},
    "usage": {"prompt_tokens": "50 + x % 9", "completion_tokens": "CAST(100 + x % 9 AS INT)"},
    "amendment": {"study_version": "'v2'", "run_id": "concat('run_', x)", "turn_number": "CAST(1 + x % 6 AS INT)", "event_id": "concat('event_', x)", "request_payload_hash": "sha2(CAST(x AS STRING), 256)", "generation_id": "concat('gen_', x)", "requested_model_id": "'maker/model:free'", "resolved_model_id": "'maker/model:free'", "provider_name": "'maker'", "choice_count": "1", "completion_tokens": "CAST(100 + x % 9 AS INT)", "completion_envelope_tokens": "4096"},
    "external": {"generation_id": "concat('gen_', x)", "provider_name": "'maker'", "tokens_prompt": "50 + x % 9", "native_tokens_prompt": "50 + x % 9", "tokens_completion": "CAST(100 + x % 9 AS INT)", "native_tokens_completion": "CAST(100 + x % 9 AS INT)", "finish_reason": "CAST(NULL AS STRING)", "native_finish_reason": "CAST(NULL AS STRING)", "cancelled": "false"},
}


def amended_evidence(keys):
    """Evidence and amendments that agree, a row for each key x, but for fault x % 30 where there is one of that number."""
    out = keys
    for part, fields in _EVIDENCE.items():
        whole = []
        for name, value in fields.items():
            broken = "".join(f" WHEN x % 30 = {i} THEN {v}" for i, (field, v, _) in enumerate(FAULTS) if field == f"{part}.{name}")
            whole.append(f"{f'CASE{broken} ELSE {value} END' if broken else value} AS {name}")
        out = out.withColumn(part, F.expr(f"struct({', '.join(whole)})"))
    return out


_FAILED = " ".join(f"WHEN {i} THEN '{', '.join(names)}'" for i, (_, _, names) in enumerate(FAULTS))


@query(f"SELECT o_orderkey AS x, CASE o_orderkey % 30 {_FAILED} ELSE '' END AS failed, o_orderkey % 30 = 29 AS passes FROM orders")
def amendment_checks(spark, sf_dir):
    """Amendments of orders, 29 of 30 with a fault of a kind of its own."""
    rows = amended_evidence(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x")))
    found = rules.broken_rules(rows, rules.bundled("finish-amendment-v1"))
    return found.select("x", F.array_join("failed", ", ").alias("failed"), (F.size("failed") == 0).alias("passes"))


# --- reliability from the log ----------------------------------------------------------------------------------------

_LOGGED = """log AS (SELECT 'run_' || (l_orderkey % 3000) AS run_id, l_linenumber AS turn_number, 'annotator_' || (l_suppkey % 2) AS annotator_id, CASE WHEN l_partkey % 3 < 2 THEN 'initial' ELSE 'rerating' END AS rating_round,
  l_shipdate AS saved_at, l_partkey * 1000003 + CAST(round(l_extendedprice * 100) AS BIGINT) AS log_index, CAST(CAST(floor(l_quantity) AS INT) % 3 AS VARCHAR) AS A1, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 7 = 1 THEN 'N/A' ELSE CAST(l_suppkey % 3 AS VARCHAR) END AS A2, CAST(l_orderkey % 2 AS VARCHAR) AS A3, CASE WHEN l_tax > 1 THEN '0' END AS B1 FROM lineitem),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, turn_number, annotator_id, rating_round ORDER BY saved_at DESC, log_index DESC) AS r FROM log) WHERE r = 1)"""
_AXES = ("A1", "A2", "A3", "B1")


def _reliability_sql(a: str, b: str) -> str:
    union = " UNION ALL ".join(f"SELECT '{x}' AS axis, TRY_CAST(a.{x} AS INT) AS na, TRY_CAST(b.{x} AS INT) AS nb FROM latest a JOIN latest b USING (run_id, turn_number) WHERE {a} AND {b}" for x in _AXES)
    both = "count(*) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL)"
    return f"""WITH {_LOGGED}, pairs AS ({union}), k AS (SELECT axis, count(*) AS matched_items, {both} AS n_pairs, avg(CASE WHEN na = nb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL) AS exact_agreement, {_kappa_sql("na", "nb", "")} AS cohen_kappa FROM pairs GROUP BY axis)
      SELECT axis, matched_items, n_pairs, exact_agreement, cohen_kappa, CASE axis WHEN 'A3' THEN 'unweighted' ELSE 'linear_weighted' END AS kappa_method, CASE WHEN n_pairs = 0 THEN 'No paired complete scores are available for this axis' END AS reason FROM k"""


def rating_log(spark, sf_dir):
    """A log of two annotators and two rounds, with item ids that hide the source, and the map back."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_tax")
    s = lambda x: x.cast("string")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    own = li.select(
        F.concat(F.lit("run_"), s(F.col("l_orderkey") % 3000)).alias("run_id"),
        F.col("l_linenumber").alias("turn_number"),
        F.concat(F.lit("annotator_"), s(supp % 2)).alias("annotator_id"),
        F.when(part % 3 < 2, "initial").otherwise("rerating").alias("rating_round"),
        F.col("l_shipdate").alias("saved_at"),
        (part * 1000003 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("log_index"),
        s(F.col("l_quantity").cast("int") % 3).alias("A1"),
        F.when(part % 7 == 1, "N/A").when(part % 7 > 1, s(supp % 3)).alias("A2"),
        s(F.col("l_orderkey") % 2).alias("A3"),
        F.when(F.col("l_tax") > 1, "0").alias("B1"),
    ).withColumn("item_id", F.sha2(F.concat_ws("|", "run_id", "turn_number", "rating_round"), 256))
    return own.drop("run_id", "turn_number"), own.select("item_id", "run_id", "turn_number", "rating_round").distinct()


@query(_reliability_sql("a.annotator_id = 'annotator_0' AND a.rating_round = 'initial'", "b.annotator_id = 'annotator_0' AND b.rating_round = 'rerating'"))
def intra_rater_report(spark, sf_dir):
    return agreement.intra_rater(*rating_log(spark, sf_dir), "annotator_0", _AXES)


@query(_reliability_sql("a.annotator_id = 'annotator_0' AND a.rating_round = 'initial'", "b.annotator_id = 'annotator_1' AND b.rating_round = 'initial'"))
def inter_rater_report(spark, sf_dir):
    return agreement.inter_rater(*rating_log(spark, sf_dir), "annotator_0", "annotator_1", _AXES)


# --- bootstraps and labels -------------------------------------------------------------------------------------------


@query()
def script_cluster_bootstrap(spark, sf_dir):
    """Orders by priority: the mean price with customers as clusters, 2,000 resamples."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return bootstrap.mean_bootstrap(o, "o_totalprice", unit="o_orderkey", cluster="o_custkey", groups=("o_orderpriority",), seed=20260814)


@query()
def matched_comparison_bootstrap(spark, sf_dir):
    """The matched difference of two order states, pairs by customer and year."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderstatus", "o_totalprice")
    return bootstrap.matched_bootstrap(o, "o_totalprice", "o_orderstatus", "F", "O", ("o_custkey", "year"), cluster="o_custkey", seed=20260814)


@query("""WITH s AS (SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN CASE WHEN o_orderkey % 9 = 0 THEN ' Demo ' ELSE 'main_study' END WHEN o_custkey % 4 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'PILOT' ELSE 'technical_pilot' END WHEN o_custkey % 4 = 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'main_study' ELSE 'pilot' END END AS s FROM orders)
SELECT o_custkey, CASE WHEN bool_or(coalesce(lower(trim(s)) IN ('demo', 'demo_fixture'), false)) THEN 'DEMO FIXTURE - NOT RESEARCH DATA' WHEN count(s) > 0 AND bool_and(coalesce(lower(trim(s)) IN ('pilot', 'technical_pilot'), true)) THEN 'TECHNICAL PILOT - DESCRIPTIVE ONLY' ELSE 'EXPLORATORY BASELINE - NOT DISSERTATION EVIDENCE' END AS label FROM s GROUP BY o_custkey""")
def evidence_labels(spark, sf_dir):
    """The label of each customer's set of statuses."""
    c, k = F.col("o_custkey") % 4, F.col("o_orderkey")
    status = F.when(c == 0, F.when(k % 9 == 0, " Demo ").otherwise("main_study")).when(c == 1, F.when(k % 2 == 0, "PILOT").otherwise("technical_pilot")).when(c == 2, F.when(k % 5 == 0, "main_study").otherwise("pilot"))
    return _table(spark, sf_dir, "orders").select("o_custkey", status.alias("s")).groupBy("o_custkey").agg(baseline.evidence_label(F.col("s")).alias("label"))


# --- configuration bundles -------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, CASE c_custkey % 4 WHEN 0 THEN 'generation-v4' ELSE 'generation-v3' END AS g, CASE WHEN c_custkey % 3 = 0 THEN '1.4' ELSE '2.0' END AS v FROM customer),
s AS (SELECT o_custkey AS k, string_agg('{"script_id":"' || printf('%012d', o_orderkey) || '","steps":[1,{"a":null,"z":true}],"theme":"' || o_orderpriority || '"}', ',' ORDER BY o_orderkey) AS scripts FROM (SELECT DISTINCT o_custkey, o_orderkey, o_orderpriority FROM orders) GROUP BY o_custkey)
SELECT k AS bundle_id, sha256('{"histories":[{"history_id":"h","text":"é \\"' || segment || '\\""}],"models":{"generation":{' || CASE g WHEN 'generation-v4' THEN '"completion_limit_parameter":"max_tokens","reasoning_policy":null,"seed":7,' ELSE '"seed":7,' END || '"version":"' || g || '"' || CASE g WHEN 'generation-v4' THEN ',"visible_response_instruction":"' || name || '"' ELSE '' END
  || '},"model_slots":{"a":{' || CASE g WHEN 'generation-v4' THEN '"completion_limit_parameter":"x",' ELSE '' END || '"id":"' || name || '"}}' || CASE v WHEN '2.0' THEN ',"provider_routing":{"pinned":[]}' ELSE '' END || ',"version":"' || v || '"},"scripts":[' || coalesce(scripts, '') || ']}') AS bundle_sha256
FROM b LEFT JOIN s USING (k)""")
def bundle_hashes(spark, sf_dir):
    """A bundle for each customer: a script for each of its orders, one history, and models of four kinds of versions."""
    s = lambda x: x.cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    key, name = F.col("c_custkey"), F.col("c_name")
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority").distinct()
    of = F.lpad(s(F.col("o_orderkey")), 12, "0")
    scripts = o.select(F.col("o_custkey").alias("bundle_id"), F.lit("scripts").alias("kind"), of.alias("document_id"), text('{"theme": "', F.col("o_orderpriority"), '", "script_id": "', of, '", "steps": [1, {"z": true, "a": null}]}').alias("document"))
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    scripts = scripts.join(c.select(key.alias("bundle_id")), "bundle_id", "left_semi")
    generation = text('{"version": "', F.when(key % 4 == 0, "generation-v4").otherwise("generation-v3"), '", "seed": 7, "reasoning_policy": null, "completion_limit_parameter": "max_tokens", "visible_response_instruction": "', name, '"}')
    models = text('{"version": "', F.when(key % 3 == 0, "1.4").otherwise("2.0"), '", "provider_routing": {"pinned": []}, "model_slots": {"a": {"id": "', name, '", "completion_limit_parameter": "x"}}, "generation": ', generation, "}")
    others = [("models", models), ("histories", text('{"text": "\\u00e9 \\"', F.col("c_mktsegment"), '\\"", "history_id": "h"}'))]
    rest = [c.select(key.alias("bundle_id"), F.lit(kind).alias("kind"), F.lit(kind).alias("document_id"), d.alias("document")) for kind, d in others]
    return hashing.bundle_hashes(scripts.unionByName(rest[0]).unionByName(rest[1]))


# --- generation budget and finish metadata ---------------------------------------------------------------------------

_RESPONSES = """r AS (SELECT 'pilot_v' || (4 + user_id % 2) AS pilot_version, 'model_' || (user_id % 2) AS requested_model, CASE WHEN k % 10 = 0 THEN NULL ELSE 'model_' || (user_id % 2) END AS resolved_model, event_type AS provider,
  CASE WHEN user_id % 3 = 0 THEN 'preloaded' ELSE 'no_preloaded' END AS context_condition, CASE WHEN k % 5 = 0 THEN 'length' WHEN k % 5 < 4 THEN 'stop' END AS finish_reason, k % 5 = 0 AS truncated, 'generation-v4' AS generation_version, 1024 AS max_completion_tokens, 'max_tokens' AS completion_limit_parameter,
  CASE WHEN user_id % 2 = 1 THEN 'DISABLED' ELSE 'NONE_LEGACY' END AS reasoning_control_requested, CASE WHEN k % 6 > 0 THEN k + 100 END AS prompt_tokens, CASE WHEN k % 6 > 0 THEN 3 * k END AS completion_tokens, CASE WHEN k % 6 > 0 THEN 4 * k + 100 END AS total_tokens,
  CASE WHEN event_type <> 'view' AND (event_type = 'click' OR k % 4 > 0) THEN k END AS reasoning_tokens, CASE WHEN k % 2 = 0 THEN k END AS visible_completion_tokens, CAST(NULL AS INT) AS cached_prompt_tokens, 10 * k AS visible_characters, 2 * k AS visible_words, k // 7 AS visible_sentences, value AS latency_ms,
  CASE WHEN k % 9 < 7 THEN 200 WHEN k % 9 = 7 THEN 206 END AS http_status FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
_KEYS = ", ".join(telemetry.BUDGET_KEYS)
_STATUS = lambda c: f"CASE WHEN count({c}) = count(*) THEN 'REPORTED_ALL' WHEN count({c}) > 0 THEN 'REPORTED_PARTIAL' ELSE 'NOT_REPORTED' END"
_BUDGET = f"""WITH {_RESPONSES}, g AS (SELECT pilot_version, {_KEYS}, count(*) AS response_count, {", ".join(f"median({c})::DOUBLE AS median_{c}" for c in telemetry.BUDGET_MEDIANS)},
  {_STATUS("reasoning_tokens")} AS reasoning_usage_reporting_status, {_STATUS("visible_completion_tokens")} AS visible_token_reporting_status, count(*) FILTER (WHERE http_status = 200) AS ok, count(*) FILTER (WHERE http_status = 206) AS part FROM r GROUP BY ALL)"""


def budget_responses(spark, sf_dir):
    """A response for each event, in the roles of the budget audit."""
    k, user, kind = F.get_json_object("props", "$.k").cast("int"), F.col("user_id"), F.col("event_type")
    s = lambda x: x.cast("string")
    used = lambda x: F.when(k % 6 > 0, x)
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("pilot_v"), s(4 + user % 2)).alias("pilot_version"),
        F.concat(F.lit("model_"), s(user % 2)).alias("requested_model"),
        F.when(k % 10 != 0, F.concat(F.lit("model_"), s(user % 2))).alias("resolved_model"),
        kind.alias("provider"),
        F.when(user % 3 == 0, "preloaded").otherwise("no_preloaded").alias("context_condition"),
        F.when(k % 5 == 0, "length").when(k % 5 < 4, "stop").alias("finish_reason"),
        (k % 5 == 0).alias("truncated"),
        F.lit("generation-v4").alias("generation_version"),
        F.lit(1024).alias("max_completion_tokens"),
        F.lit("max_tokens").alias("completion_limit_parameter"),
        F.when(user % 2 == 1, "DISABLED").alias("reasoning_control_requested"),
        used(k + 100).alias("prompt_tokens"),
        used(3 * k).alias("completion_tokens"),
        used(4 * k + 100).alias("total_tokens"),
        F.when((kind != "view") & ((kind == "click") | (k % 4 > 0)), k).alias("reasoning_tokens"),
        F.when(k % 2 == 0, k).alias("visible_completion_tokens"),
        F.lit(None).cast("int").alias("cached_prompt_tokens"),
        (10 * k).alias("visible_characters"),
        (2 * k).alias("visible_words"),
        F.floor(k / 7).alias("visible_sentences"),
        F.col("value").alias("latency_ms"),
        F.when(k % 9 < 7, 200).when(k % 9 == 7, 206).alias("http_status"),
    )


@query(f"{_BUDGET} SELECT * EXCLUDE (ok, part), concat_ws(',', CASE WHEN ok > 0 THEN '200:' || ok END, CASE WHEN part > 0 THEN '206:' || part END) AS http_statuses FROM g")
def generation_budget_groups(spark, sf_dir):
    found = telemetry.generation_budget_audit(budget_responses(spark, sf_dir))
    return found.withColumn("http_statuses", F.array_join(F.transform(F.map_entries("http_statuses"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


@query(f"{_BUDGET} SELECT count(*) AS configurations, CASE WHEN count(*) = 0 OR bool_or(reasoning_usage_reporting_status = 'NOT_REPORTED') THEN 'INCONCLUSIVE' ELSE 'REQUIRES_REVIEW' END AS reasoning_contribution FROM g")
def generation_budget_conclusion(spark, sf_dir):
    return telemetry.budget_conclusion(telemetry.generation_budget_audit(budget_responses(spark, sf_dir)))


@query("""WITH o AS (SELECT DISTINCT o_orderkey AS x, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' STOP ' WHEN 2 THEN 'length' WHEN 3 THEN 'stop' ELSE 'other' END AS f, o_orderkey % 7 = 0 AS amended FROM orders)
SELECT count(*) FILTER (WHERE f IS NULL) AS unreported, count(*) FILTER (WHERE x % 5 IN (1, 3)) AS reported_stop, count(*) FILTER (WHERE f = 'length') AS reported_length, count(*) FILTER (WHERE f = 'other') AS reported_other,
  count(*) FILTER (WHERE amended AND x % 30 = 29) AS approved_anomaly_count, count(*) FILTER (WHERE NOT amended AND x % 5 NOT IN (1, 3)) AS unapproved_anomaly_count, count(*) FILTER (WHERE amended AND x % 30 <> 29) AS invalid_amendments FROM o""")
def finish_metadata_audit(spark, sf_dir):
    """A turn for each order; every seventh has an amendment, one in thirty of which matches its evidence."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x")).distinct()
    x = F.col("x")
    run = F.concat(F.lit("run_"), x.cast("string"))
    finish = F.when(x % 5 == 1, " STOP ").when(x % 5 == 2, "length").when(x % 5 == 3, "stop").when(x % 5 == 4, "other")
    turns = o.select(run.alias("run_id"), F.lit(1).alias("turn_number"), finish.alias("finish_reason"))
    checked = rules.broken_rules(amended_evidence(o.where("x % 7 = 0")), rules.bundled("finish-amendment-v1"))
    return telemetry.finish_audit(turns, checked.select(run.alias("run_id"), F.lit(1).alias("turn_number"), run.alias("amendment_id"), "failed"))
