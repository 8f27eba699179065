"""Queries of designs, event logs, telemetry, integrity and hashing; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions import hashing, taxonomy
from cohortflow.operators import design, events, integrity, telemetry
from cohortflow.plans.fixtures import CALLS, LOG, RATERS, TURNS, annotation_log, rater_items, technical_events, turn_ratings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = b"a fixed key for tests"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- designs ---------------------------------------------------------------------------------------------------------

FACTORS = {"theme": ["t0", "t1", "t2"], "presentation_level": ["ambiguous", "control", "fixed_belief"], "model_slot": ["model_0", "model_1"], "context_condition": ["no_preloaded", "preloaded"], "repetition": [1, 2]}
_PLAN = "plan AS (SELECT concat_ws('_', 'v2', theme, presentation_level, model_slot, context_condition, 'r' || repetition) AS run_id, theme, presentation_level, model_slot, context_condition, repetition FROM (VALUES ('t0'), ('t1'), ('t2')) a(theme), (VALUES ('ambiguous'), ('control'), ('fixed_belief')) b(presentation_level), (VALUES ('model_0'), ('model_1')) c(model_slot), (VALUES ('no_preloaded'), ('preloaded')) d(context_condition), (VALUES (1), (2)) e(repetition))"
_ORDERED = f"{_PLAN}, ordered AS (SELECT *, CAST(row_number() OVER (ORDER BY sha256('20260901|' || run_id), run_id) AS INT) AS execution_order FROM plan)"


def _plan(spark):
    p = design.factorial(spark, FACTORS)
    return design.execution_order(p.withColumn("run_id", design.run_key("v2", list(FACTORS))), "run_id", 20260901)


@query(f"WITH {_ORDERED} SELECT * FROM ordered")
def factorial_plan(spark, sf_dir):
    return _plan(spark)


@query("SELECT * FROM (VALUES ('missing_cells', 0::BIGINT), ('repeated_cells', 0::BIGINT), ('repeated_keys', 0::BIGINT), ('order_gaps', 0::BIGINT), ('row_count_off', 0::BIGINT)) v(rule, violations)")
def factorial_balance(spark, sf_dir):
    return design.balance(_plan(spark), list(FACTORS), {k: len(v) for k, v in FACTORS.items()})


@query(f"""WITH {TURNS}, r AS (SELECT run_id, theme, presentation_level, model_slot, context_condition, repetition FROM turns GROUP BY ALL)
  SELECT theme, presentation_level, model_slot, context_condition, repetition, count(*) AS n FROM r GROUP BY ALL""")
def experimental_cells(spark, sf_dir):
    cells = ["theme", "presentation_level", "model_slot", "context_condition", "repetition"]
    return turn_ratings(spark, sf_dir).select("run_id", *cells).distinct().groupBy(*cells).agg(F.count("*").alias("n"))


_EXCHANGES = """u AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT 'conv_' || conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_number, text AS user_message, coalesce(next_text, '') AS response_text FROM u WHERE role = 'user' AND next_role = 'assistant')"""


def exchanges(spark, sf_dir):
    """User messages with the responses that follow them."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _table(spark, sf_dir, "conversations").where("role <> 'system'").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    x = c.where("role = 'user' AND next_role = 'assistant'")
    return x.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("run_id"), F.row_number().over(w).cast("long").alias("turn_number"), F.col("text").alias("user_message"), F.coalesce("next_text", F.lit("")).alias("response_text"))


_HISTORY = f"""{_EXCHANGES}, h AS (SELECT *, coalesce(string_agg('user' || chr(31) || user_message || chr(30) || 'assistant' || chr(31) || response_text, chr(30)) OVER (PARTITION BY run_id ORDER BY turn_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || chr(30), '') || 'user' || chr(31) || user_message AS request FROM x)"""


@query(f"WITH {_HISTORY} SELECT run_id, turn_number, CAST(2 * turn_number - 1 AS INT) AS message_count, repeat('user -> assistant -> ', CAST(turn_number - 1 AS INT)) || 'user' AS role_chain, sha256(request) AS request_hash FROM h")
def message_histories(spark, sf_dir):
    h = design.message_growth(design.message_history(exchanges(spark, sf_dir)))
    return h.select("run_id", "turn_number", "message_count", "role_chain", integrity.request_hash(F.col("request_messages")).alias("request_hash"))


@query(f"WITH {_HISTORY} SELECT run_id, turn_number FROM h WHERE turn_number % 5 = 0")
def request_replay(spark, sf_dir):
    """Stored hashes, some of them wrong on purpose, against rebuilt requests."""
    h = design.message_history(exchanges(spark, sf_dir))
    stored = h.withColumn("payload_hash", F.when(F.col("turn_number") % 5 == 0, "tampered").otherwise(integrity.request_hash(F.col("request_messages")))).drop("request_messages")
    return integrity.replayed_requests(stored).select("run_id", "turn_number")


@query(f"""WITH {TURNS}, r AS (SELECT run_id, max(turn_number) AS planned FROM turns GROUP BY run_id) SELECT run_id, planned, CAST(unnest(range(1, planned + 1)) AS INT) AS turn_number FROM r""")
def expected_turn_grid(spark, sf_dir):
    runs = turn_ratings(spark, sf_dir).groupBy("run_id").agg(F.max("turn_number").alias("planned"))
    return design.turn_grid(runs, F.col("planned"))


@query(f"""WITH {_ORDERED}, s AS (SELECT unnest(['ambiguous', 'control', 'fixed_belief']) AS presentation_level), t AS (SELECT presentation_level, CAST(i AS INT) AS turn_number, presentation_level || ' turn ' || i AS user_message FROM s, range(1, 7) r(i))
SELECT run_id, turn_number, sha256(concat_ws(chr(30), run_id, string_agg(user_message, chr(31)) OVER (PARTITION BY run_id ORDER BY turn_number))) AS payload_hash FROM ordered JOIN t USING (presentation_level)""")
def dry_run_payloads(spark, sf_dir):
    script = spark.range(1).select(F.explode(F.array(*map(F.lit, FACTORS["presentation_level"]))).alias("presentation_level")).select("presentation_level", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("turn_number"))
    script = script.withColumn("user_message", F.concat("presentation_level", F.lit(" turn "), F.col("turn_number").cast("string")))
    return design.payload_rows(_plan(spark), script, "presentation_level").select("run_id", "turn_number", "payload_hash")


@query("SELECT 'demo_' || p AS run_id, p AS profile, CAST(t AS INT) AS turn_number, CAST(s[t] AS INT) AS A1 FROM (VALUES ('steady', [0, 0, 0, 0, 0, 0]), ('rising', [0, 0, 1, 1, 2, 2]), ('peak', [0, 1, 2, 2, 1, 0]), ('late', [0, 0, 0, 0, 1, 2])) v(p, s), range(1, 7) r(t)")
def demo_fixture(spark, sf_dir):
    return design.demo_runs(spark)


# --- logs ------------------------------------------------------------------------------------------------------------


@query(f"WITH {LOG} SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY item_id, annotator_id ORDER BY saved_at DESC, log_index DESC) = 1")
def latest_revisions(spark, sf_dir):
    return events.latest_revisions(annotation_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT *, CAST(row_number() OVER (PARTITION BY item_id, annotator_id ORDER BY log_index) AS INT) AS revision FROM log")
def revision_ordinals(spark, sf_dir):
    return events.with_revision(annotation_log(spark, sf_dir))


@query(f"""WITH {LOG}, l AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY item_id, annotator_id ORDER BY saved_at DESC, log_index DESC) = 1),
n AS (SELECT count(DISTINCT item_id) AS items FROM log) SELECT annotator_id, items, count(*) FILTER (WHERE A1 IS NOT NULL AND A2 IS NOT NULL) AS complete, items - count(*) FILTER (WHERE A1 IS NOT NULL AND A2 IS NOT NULL) AS remaining FROM l, n GROUP BY annotator_id, items""")
def annotation_progress(spark, sf_dir):
    log = annotation_log(spark, sf_dir)
    return events.annotation_progress(log.select("item_id").distinct(), log, ("A1", "A2"))


@query(f"""WITH {LOG}, l AS (SELECT * FROM log WHERE annotator_id = 'annotator_0' QUALIFY row_number() OVER (PARTITION BY item_id, annotator_id ORDER BY saved_at DESC, log_index DESC) = 1)
  SELECT DISTINCT item_id FROM log WHERE item_id NOT IN (SELECT item_id FROM l WHERE A1 IS NOT NULL AND A2 IS NOT NULL)""")
def incomplete_items(spark, sf_dir):
    log = annotation_log(spark, sf_dir)
    return events.incomplete_items(log.select("item_id").distinct(), log, ("A1", "A2"), "annotator_0")


@query(f"""WITH {CALLS}, h AS (SELECT DISTINCT run_id FROM calls UNION ALL SELECT 'run_none'), g AS (SELECT run_id, count(*) FILTER (WHERE kind = 'success') AS turns, count(*) FILTER (WHERE kind = 'error') AS errors, max(ts) FILTER (WHERE kind = 'success') AS last FROM calls GROUP BY run_id)
  SELECT run_id, coalesce(turns, 0) AS turns, coalesce(errors, 0) AS errors, CASE WHEN turns >= 150 THEN 'completed' WHEN turns > 0 THEN 'partial' WHEN errors > 0 THEN 'failed' ELSE 'planned' END AS status, CASE WHEN turns >= 150 THEN last END AS completed_at FROM h LEFT JOIN g USING (run_id)""")
def run_statuses(spark, sf_dir):
    e = technical_events(spark, sf_dir)
    headers = e.select("run_id").distinct().unionByName(spark.sql("SELECT 'run_none' AS run_id"))
    return events.run_status(headers, e, planned=150)


@query(f"""WITH {TURNS}, g AS (SELECT run_id, count(*) AS rows, count(DISTINCT turn_number) AS distinct_turns, min(turn_number) AS first, max(turn_number) AS last FROM turns GROUP BY run_id) SELECT * FROM g WHERE first <> 1 OR last <> rows OR distinct_turns <> rows""")
def turn_gaps(spark, sf_dir):
    return events.gaps(turn_ratings(spark, sf_dir))


_CUT = f"{_EXCHANGES}, c AS (SELECT *, length(response_text) % 9 = 0 AS truncated, CASE WHEN turn_number % 7 = 3 THEN ' Length ' ELSE 'stop' END AS finish_reason FROM x), d AS (SELECT *, truncated OR lower(trim(finish_reason)) = 'length' AS cut FROM c), e AS (SELECT *, coalesce(bool_or(cut) OVER (PARTITION BY run_id ORDER BY turn_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM d), scorable AS (SELECT *, CASE WHEN before THEN 'downstream_of_truncation' WHEN cut THEN 'truncated' ELSE 'complete_pre_truncation' END AS reason FROM e)"


def _scorable(spark, sf_dir):
    x = exchanges(spark, sf_dir).withColumns({"truncated": F.length("response_text") % 9 == 0, "finish_reason": F.when(F.col("turn_number") % 7 == 3, " Length ").otherwise("stop")})
    return events.scorability(x)


@query(f"WITH {_CUT} SELECT run_id, turn_number, reason, reason = 'complete_pre_truncation' AS primary_scorable FROM scorable")
def scorability(spark, sf_dir):
    return _scorable(spark, sf_dir).select("run_id", "turn_number", "reason", "primary_scorable")


def _hex_pad(x):
    return bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex()


_HMAC = f"sha256(unhex('{_hex_pad(0x5C)}') || unhex(sha256(unhex('{_hex_pad(0x36)}') || encode(message))))"


@query(f"WITH {_CUT}, m AS (SELECT *, concat_ws(chr(31), 'annotation-item-v1', 'initial', run_id, turn_number, sha256(response_text)) AS message FROM scorable WHERE reason = 'complete_pre_truncation' AND trim(response_text) <> '') SELECT run_id, turn_number, sha256(response_text) AS source_response_hash, {_HMAC} AS digest FROM m")
def blinding_digests(spark, sf_dir):
    t = _scorable(spark, sf_dir).where("primary_scorable AND trim(response_text) <> ''")
    message = F.concat_ws("\x1f", F.lit("annotation-item-v1"), F.lit("initial"), "run_id", F.col("turn_number").cast("string"), hashing.response_hash(F.col("response_text")))
    return t.select("run_id", "turn_number", hashing.response_hash(F.col("response_text")).alias("source_response_hash"), hashing.hmac_sha256(KEY, message).alias("digest"))


def _token(digest):
    """Twenty base-32 letters of a hex digest: four for each five hex digits."""
    return " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz234567', CAST((CAST('0x' || substr({digest}, {5 * (i // 4) + 1}, 5) AS BIGINT) >> {15 - 5 * (i % 4)}) & 31 AS INT) + 1, 1)" for i in range(20))


def _keyed(message, key=KEY):
    """The token of a message under a key, as SQL."""
    outer, inner = (bytes(b ^ pad for b in key.ljust(64, b"\0")).hex() for pad in (0x5C, 0x36))
    return _token(f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))")


_ITEMS = f"""{_CUT}, usable AS (SELECT *, sha256(response_text) AS source_response_hash FROM scorable WHERE reason = 'complete_pre_truncation' AND trim(response_text) <> ''),
items AS (SELECT 'item_' || {_keyed("concat_ws(chr(31), 'annotation-item-v1', 'initial', run_id, turn_number, source_response_hash)")} AS item_id, run_id, turn_number, response_text AS response_to_score, source_response_hash FROM usable)"""


@query(f"WITH {_ITEMS} SELECT item_id, 'initial' AS rating_round, turn_number, response_to_score, source_response_hash FROM items")
def blinded_items(spark, sf_dir):
    return events.blinded_items(_scorable(spark, sf_dir), KEY)[0]


@query(f"""WITH {_ITEMS}, ranked AS (SELECT *, row_number() OVER (ORDER BY {_keyed("concat_ws(chr(31), 'rerating-selection-v1', item_id, source_response_hash)", b"seed-1")}, item_id) AS r, count(*) OVER () AS c FROM items)
  SELECT 'item_' || {_keyed("concat_ws(chr(31), 'annotation-item-v1', 'rerating', 'seed-1', run_id, turn_number, source_response_hash)")} AS item_id, 'rerating' AS rating_round, turn_number, response_to_score, source_response_hash FROM ranked WHERE r <= ceil(c * 0.2)""")
def rerating_sample(spark, sf_dir):
    items, item_map = events.blinded_items(_scorable(spark, sf_dir), KEY)
    return events.rerating_sample(items, item_map, KEY, "seed-1", 0.2)[0]


@query(f"""WITH {CALLS} SELECT run_id, arg_max(event_id, ts) AS event_id, arg_max(error_code, ts) AS error_code, max(ts) AS ts FROM calls WHERE kind = 'error' GROUP BY run_id""")
def latest_errors(spark, sf_dir):
    return events.latest_error(technical_events(spark, sf_dir))


@query(f"WITH {CALLS}, n AS (SELECT run_id, event_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS INT) AS n FROM calls WHERE kind = 'error') SELECT * FROM n WHERE n > 3")
def new_errors(spark, sf_dir):
    return events.errors_since(technical_events(spark, sf_dir), 3).select("run_id", "event_id", "n")


@query(f"""WITH {TURNS}, t AS (SELECT DISTINCT run_id, turn_number FROM turns), a AS (SELECT *, CASE WHEN turn_number % 3 = 1 THEN run_id || '_a' || turn_number END AS amendment_id FROM t)
SELECT run_id, turn_number, amendment_id, coalesce(array_to_string(list(amendment_id) FILTER (WHERE amendment_id IS NOT NULL) OVER (PARTITION BY run_id ORDER BY turn_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ','), '') AS earlier FROM a""")
def amendment_provenance(spark, sf_dir):
    t = turn_ratings(spark, sf_dir).select("run_id", "turn_number").distinct()
    a = t.where("turn_number % 3 = 1").withColumn("amendment_id", F.concat("run_id", F.lit("_a"), F.col("turn_number").cast("string")))
    return events.with_amendments(t, a).select("run_id", "turn_number", "amendment_id", F.array_join("earlier_amendments", ",").alias("earlier"))


@query("SELECT 'SELECTED' AS outcome, 'c3' AS candidate")
def frozen_order_selection(spark, sf_dir):
    v = spark.createDataFrame([(1, "c1", "FAIL"), (2, "c2", "FAIL"), (3, "c3", "PASS"), (4, "c4", "NOT_RUN")], "position int, candidate string, verdict string")
    return events.select_in_order(v)


@query(f"WITH {LOG} SELECT item_id, annotator_id, count(*) AS n FROM log GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return events.duplicates(annotation_log(spark, sf_dir), "item_id", "annotator_id")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0")
def append_only_events(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id")
    return events.new_events(e.where("event_id % 3 = 0"), e.unionByName(e.where("event_id % 5 = 1")), "event_id")


# --- telemetry -------------------------------------------------------------------------------------------------------


@query(f"""WITH {CALLS} SELECT model_slot, count(*) FILTER (WHERE kind = 'success') AS responses, count(*) FILTER (WHERE kind <> 'success') AS errors, count(tokens) FILTER (WHERE kind = 'success') AS reporting_count,
  count(tokens) FILTER (WHERE kind = 'success') / nullif(count(*) FILTER (WHERE kind = 'success'), 0) AS reporting_rate, median(tokens) FILTER (WHERE kind = 'success') AS median_tokens, median(latency) AS median_latency,
  CAST(coalesce(sum(tokens) FILTER (WHERE kind = 'success'), 0) AS BIGINT) AS tokens_total, round(sum(latency), 4) AS latency_total FROM calls GROUP BY model_slot""")
def study_audit(spark, sf_dir):
    return telemetry.study_audit(technical_events(spark, sf_dir))


@query(f"WITH {CALLS} SELECT model_slot, coalesce(error_code, 'unreported') AS error_code, count(*) AS n FROM calls GROUP BY ALL")
def safe_crosstab(spark, sf_dir):
    return telemetry.distribution(technical_events(spark, sf_dir), "model_slot", "error_code")


@query(f"WITH {CALLS}, c AS (SELECT model_slot, coalesce(error_code, 'unreported') AS k, count(*) AS n FROM calls GROUP BY ALL) SELECT model_slot, string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM c GROUP BY model_slot")
def error_histograms(spark, sf_dir):
    m = telemetry.distribution_map(technical_events(spark, sf_dir), ("model_slot",), "error_code")
    return m.select("model_slot", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


_RUNS = f"""{CALLS}, plan AS (SELECT run_id, CAST(row_number() OVER (ORDER BY run_id) AS INT) AS execution_order FROM (SELECT DISTINCT run_id FROM calls UNION ALL SELECT 'run_x' UNION ALL SELECT 'run_y')),
runs AS (SELECT run_id, least(6, count(*) FILTER (WHERE kind = 'success') % 8) AS turns, count(*) FILTER (WHERE kind = 'error') AS errors, count(*) AS attempts, count(*) % 11 = 0 AS closed FROM calls GROUP BY run_id),
j AS (SELECT execution_order, runs.turns IS NOT NULL AS begun, coalesce(turns, 0) AS turns, coalesce(errors, 0) AS errors, attempts, coalesce(closed, false) AS closed FROM plan LEFT JOIN runs USING (run_id)),
g AS (SELECT count(*) AS planned, count(*) FILTER (WHERE turns >= 6) AS completed, count(*) FILTER (WHERE turns > 0 AND turns < 6) AS "partial", count(*) FILTER (WHERE turns = 0 AND errors > 0) AS failed, CAST(sum(turns) AS BIGINT) AS responses, CAST(count(*) * 6 - sum(turns) AS BIGINT) AS missing,
  CAST(coalesce(sum(6 - turns) FILTER (WHERE closed), 0) AS BIGINT) AS unfillable, count(*) FILTER (WHERE closed) AS closed_by_truncation, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(attempts) AS BIGINT) AS attempts,
  coalesce(min(execution_order) FILTER (WHERE begun AND turns < 6 AND NOT closed), min(execution_order) FILTER (WHERE NOT begun)) AS next_execution_order FROM j)"""


@query(f"WITH {_RUNS} SELECT *, missing - unfillable AS fillable, greatest(0, 576 - attempts) AS remaining_allowance, greatest(0, 576 - attempts) >= missing - unfillable AS allowance_sufficient FROM g")
def execution_summary(spark, sf_dir):
    e = technical_events(spark, sf_dir)
    ids = e.select("run_id").distinct().unionByName(spark.sql("SELECT explode(array('run_x', 'run_y')) AS run_id"))
    plan = telemetry.in_order(ids, "run_id", "execution_order")
    ok = F.count(F.when(F.col("kind") == "success", 1))
    runs = e.groupBy("run_id").agg(F.least(F.lit(6), ok % 8).alias("turns"), F.count(F.when(F.col("kind") == "error", 1)).alias("errors"), F.count("*").alias("attempts"), (F.count("*") % 11 == 0).alias("closed"))
    return telemetry.execution_summary(plan, runs, allowance=576)


@query(f"WITH {CALLS} SELECT model_slot, kind, count(*) AS n, median(tokens) AS median_tokens, count(tokens) AS reported, CASE WHEN count(tokens) = count(*) THEN 'ALL' WHEN count(tokens) > 0 THEN 'PARTIAL' ELSE 'NOT' END AS reporting FROM calls GROUP BY ALL")
def generation_budget(spark, sf_dir):
    return telemetry.budget_audit(technical_events(spark, sf_dir), ("model_slot", "kind"))


@query("SELECT 'k' AS key, count(*) AS n FROM events")
def metadata_key_counts(spark, sf_dir):
    return telemetry.metadata_keys(_table(spark, sf_dir, "events"), "props")


@query(f"WITH {CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY model_slot ORDER BY ts DESC, event_id DESC) AS n FROM calls WHERE kind = 'success' AND latency IS NOT NULL) SELECT model_slot, count(*) AS n_recent, CASE WHEN count(*) >= 3 THEN greatest(5.0::DOUBLE, avg(latency)) * 40 END AS eta_seconds FROM r WHERE n <= 30 GROUP BY model_slot")
def latency_eta(spark, sf_dir):
    return telemetry.eta(technical_events(spark, sf_dir), 40)


@query(f"""WITH {CALLS}, c AS (SELECT *, TRY_CAST(substr(error_code, 6) AS INT) AS code FROM calls) SELECT model_slot, run_id, count(*) FILTER (WHERE kind = 'success') AS completed, count(code) AS http_errors, count(*) FILTER (WHERE code = 429) AS http_429, count(*) AS attempts,
  CASE WHEN count(*) FILTER (WHERE code = 404) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE kind = 'success') < 100 THEN 'INCOMPLETE' ELSE 'PASS' END AS verdict FROM c GROUP BY ALL""")
def pilot_statistics(spark, sf_dir):
    return telemetry.pilot_statistics(technical_events(spark, sf_dir), ("model_slot", "run_id"), 100)


@query(f"""WITH {CALLS}, c AS (SELECT event_id, error_code, TRY_CAST(substr(error_code, 6) AS INT) AS code, kind, CASE WHEN event_id % 17 = 0 THEN 'length' ELSE 'stop' END AS finish FROM calls)
SELECT event_id, CASE WHEN kind = 'success' THEN CASE WHEN finish = 'stop' THEN 'success' ELSE 'scientific_hard_stop' END WHEN code IN (408, 429, 500, 502, 503, 504) THEN 'outer_http_transient' ELSE 'permanent' END AS category,
  kind <> 'success' AND code IN (408, 429, 500, 502, 503, 504) AS retryable, CASE WHEN kind = 'success' THEN CASE WHEN finish = 'stop' THEN 'response' ELSE 'incomplete_result' END ELSE error_code END AS reason_code FROM c""")
def error_taxonomy(spark, sf_dir):
    e = technical_events(spark, sf_dir).withColumns({"finish": F.when(F.col("event_id") % 17 == 0, "length").otherwise("stop"), "responded": F.col("kind") == "success"})
    return taxonomy.classify_errors(e, "error_code", finish="finish", responded="responded").select("event_id", "category", "retryable", "reason_code")


@query(f"WITH {CALLS}, n AS (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS k FROM calls WHERE kind = 'error') SELECT run_id, event_id, least(60.0::DOUBLE, 3.0::DOUBLE * pow(2, k - 1)) AS wait_seconds FROM n")
def retry_waits(spark, sf_dir):
    return events.errors_since(technical_events(spark, sf_dir), 0).select("run_id", "event_id", taxonomy.retry_wait(F.col("n")).alias("wait_seconds"))


# --- integrity -------------------------------------------------------------------------------------------------------


@query(f"""WITH {TURNS} SELECT unnest(['turn_in_range', 'a1_present', 'known_level']) AS rule, unnest([CAST(count(*) FILTER (WHERE turn_number NOT BETWEEN 1 AND 6) AS BIGINT), count(*) FILTER (WHERE A1 IS NULL), CAST(0 AS BIGINT)]) AS violations FROM turns""")
def data_expectations(spark, sf_dir):
    return integrity.expectations(turn_ratings(spark, sf_dir), {"turn_in_range": F.col("turn_number").between(1, 6), "a1_present": F.col("A1").isNotNull(), "known_level": F.col("presentation_level").isin("control", "ambiguous", "fixed_belief")})


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice > 1000 THEN 'price' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' END, CASE WHEN NOT o_orderdate < TIMESTAMP '2000-01-01' THEN 'date' END], lambda x: x IS NOT NULL), ',') AS failed,
  o_totalprice > 1000 AND o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '2000-01-01' AS passes FROM orders""")
def failed_check_names(spark, sf_dir):
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O"), "date": F.col("o_orderdate") < F.to_timestamp(F.lit("2000-01-01"))}
    return integrity.failed_checks(_table(spark, sf_dir, "orders"), rules).select("o_orderkey", F.array_join("failed_checks", ",").alias("failed"), "passes")


@query("""SELECT c_custkey AS custkey, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def key_set_differences(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    return integrity.set_differences(c, o, ["custkey"])


@query(f"""WITH {LOG}, a AS (SELECT item_id, A1 FROM log), b AS (SELECT item_id, A1 FROM log WHERE A1 <> '2' OR item_id NOT LIKE '%7_1') SELECT item_id, A1, count(*) - (SELECT count(*) FROM b WHERE b.item_id = a.item_id AND b.A1 = a.A1) AS surplus FROM a GROUP BY item_id, A1 HAVING surplus <> 0""")
def multiset_differences(spark, sf_dir):
    a = annotation_log(spark, sf_dir).select("item_id", "A1")
    return integrity.multiset_differences(a, a.where("A1 <> '2' OR NOT item_id LIKE '%7_1'"), ["item_id", "A1"])


@query(f"""WITH {RATERS}, h AS (SELECT DISTINCT item_id, md5(item_id) AS h FROM raters WHERE source = 'human' AND item_id NOT LIKE '%9_2'),
j AS (SELECT source, item_id, CASE WHEN item_id LIKE '%5_1' THEN 'x' ELSE md5(item_id) END AS jh FROM raters WHERE source <> 'human' AND axis = 'A1' AND item_id NOT LIKE '%3_1')
SELECT source, count(*) AS rows, count(DISTINCT j.item_id) AS items, (SELECT count(*) FROM h) - count(DISTINCT h.item_id) AS missing_items, count(DISTINCT j.item_id) - count(DISTINCT h.item_id) AS extra_items, count(*) - count(DISTINCT j.item_id) AS repeated_rows, count(*) FILTER (WHERE h.h <> jh) AS hash_mismatches
FROM j LEFT JOIN h USING (item_id) GROUP BY source""")
def join_report(spark, sf_dir):
    r = rater_items(spark, sf_dir)
    md5 = F.md5(F.col("item_id").cast("binary"))
    h = r.where("source = 'human' AND NOT item_id LIKE '%9_2'").withColumn("source_response_hash", md5)
    j = r.where("source <> 'human' AND axis = 'A1' AND NOT item_id LIKE '%3_1'").withColumn("source_response_hash", F.when(F.col("item_id").like("%5_1"), "x").otherwise(md5))
    return integrity.join_report(h, j)


@query("SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def relational_division(spark, sf_dir):
    flags = _table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("item_id"))
    return integrity.covers_all(flags, flags, "l_partkey")


@query(f"""WITH {LOG} SELECT CASE WHEN item_id LIKE '%9_2' THEN 'unmapped_item' WHEN item_id LIKE '%4_3' THEN 'unknown_run' WHEN item_id LIKE '%6_2' THEN 'hash_mismatch' END AS problem, count(*) AS n FROM log GROUP BY 1""")
def blinded_rejoin(spark, sf_dir):
    log = annotation_log(spark, sf_dir).withColumn("source_response_hash", F.md5(F.col("item_id").cast("binary")))
    item = log.select("item_id").distinct()
    m = item.where("NOT item_id LIKE '%9_2'").select("item_id", F.concat(F.lit("r_"), F.split("item_id", "_")[0]).alias("run_id"), F.split("item_id", "_")[1].cast("int").alias("turn_number"))
    runs = m.where("NOT item_id LIKE '%4_3'").select("run_id", "turn_number", F.when(F.col("item_id").like("%6_2"), "other").otherwise(F.md5(F.col("item_id").cast("binary"))).alias("source_response_hash"))
    return integrity.rejoin(log, m, runs).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 10 = 3 THEN 'c_name' END, CASE WHEN c_custkey % 15 = 3 THEN 'c_mktsegment' END], lambda x: x IS NOT NULL), ',') AS changed FROM customer WHERE c_custkey % 10 = 3 OR c_custkey % 15 = 3")
def header_changes(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    now = c.withColumns({"c_name": F.when(F.col("c_custkey") % 10 == 3, "renamed").otherwise(F.col("c_name")), "c_mktsegment": F.when(F.col("c_custkey") % 15 == 3, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))})
    return integrity.changed_fields(c, now, "c_custkey").select("c_custkey", F.array_join("changed", ",").alias("changed"))


@query("SELECT item_id, sha256(text) AS hash, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS portable, substr(sha256(text), 1, 12) AS short FROM benchmark")
def text_hashes(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark")
    return b.select("item_id", hashing.response_hash(F.col("text")).alias("hash"), hashing.portable_hash(F.col("text")).alias("portable"), hashing.short_hash(F.col("text")).alias("short"))


@query()
def canonical_hashes(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", hashing.canonical_json_hash(F.col("props")).alias("hash"))


@query("""WITH e AS (SELECT 'vendor/m' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ':free' END AS id, p_partkey AS k FROM part)
SELECT id, array_to_string(list_sort(list_filter([CASE WHEN k % 3 = 0 THEN 'not_exact_free_slug' END, CASE WHEN k % 5 = 0 THEN 'nonzero_prompt_or_completion_price' END, CASE WHEN k % 7 = 0 THEN 'pricing_unverifiable' END, CASE WHEN k % 11 = 0 THEN 'context_length_below_study_minimum' END,
  CASE WHEN k % 13 = 0 THEN 'seed_not_advertised' END], lambda x: x IS NOT NULL)), ',') AS reasons, NOT (k % 3 = 0 OR k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0) AS eligible FROM e""")
def catalogue_eligibility(spark, sf_dir):
    k = F.col("p_partkey")
    entries = _table(spark, sf_dir, "part").select(
        F.concat(F.lit("vendor/m"), k.cast("string"), F.when(k % 3 == 0, "").otherwise(":free")).alias("id"),
        F.lit(None).cast("string").alias("canonical_slug"),
        F.when(k % 7 == 0, "n/a").when(k % 5 == 0, "0.001").otherwise("0").alias("prompt_price"),
        F.when(k % 5 == 0, "0.5").otherwise("0").alias("completion_price"),
        F.array(F.lit("text")).alias("input_modalities"),
        F.array(F.lit("text")).alias("output_modalities"),
        F.when(k % 13 == 0, F.array(F.lit("max_tokens"))).otherwise(F.array(F.lit("seed"), F.lit("max_tokens"))).alias("parameters"),
        F.when(k % 11 == 0, 1024).otherwise(65536).alias("context_length"),
        F.array(F.lit(8192), F.lit(0)).alias("completion_limits"),
        F.lit("").alias("availability"),
        F.lit("active").alias("status"),
        F.lit(None).cast("string").alias("expires_at"),
    )
    return taxonomy.eligibility(entries, "2026-09-01 00:00:00").select("id", F.array_join("rejection_reasons", ",").alias("reasons"), "eligible")
