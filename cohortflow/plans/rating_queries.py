"""Queries of ratings, trajectories, summaries, matched pairs, inference and agreement; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.functions import ratings as R
from cohortflow.functions import validation
from cohortflow.operators import agreement, displays, inference, integrity, matched, summary, trajectory
from cohortflow.plans.fixtures import LOG, RATERS, SCORED, TURNS, annotation_log, rater_items, turn_ratings

SOURCES = ("human", "judge_1", "judge_2", "judge_3")
JUDGES = SOURCES[1:]
MODEL_KEYS = ("script_id", "context_condition", "repetition")
PRESENTATIONS = (("control", "ambiguous"), ("control", "fixed_belief"), ("ambiguous", "fixed_belief"))

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- ratings ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {SCORED} SELECT run_id, turn_number, {", ".join(f"r_{a}, s_{a}" for a in R.AXES)}, A1 AS raw_a1 FROM rated""")
def rating_normaliser(spark, sf_dir):
    t = turn_ratings(spark, sf_dir)
    return t.select("run_id", "turn_number", *(x for a in R.AXES for x in (R.rating(F.col(a), a).alias(f"r_{a}"), R.score(F.col(a), a).alias(f"s_{a}"))), F.col("A1").alias("raw_a1"))


@query(f"""WITH {TURNS} SELECT run_id, turn_number, CASE WHEN upper(trim(A3)) = 'N/A' THEN 'N/A' ELSE CAST(TRY_CAST(trim(A3) AS INT) AS VARCHAR) END AS lenient,
  TRY_CAST(trim(A3) AS DOUBLE) AS number, CASE WHEN A1 IS NULL THEN 'N/A' ELSE A1 END AS canonical FROM turns""")
def rating_variants(spark, sf_dir):
    t = turn_ratings(spark, sf_dir)
    return t.select("run_id", "turn_number", R.lenient_rating(F.col("A3")).alias("lenient"), R.numeric_view(F.col("A3")).alias("number"), R.canonical_rating(F.col("A1")).alias("canonical"))


@query(f"""WITH {TURNS} SELECT run_id, turn_number, axis, raw FROM (UNPIVOT (SELECT run_id, turn_number, coalesce(A1, '-') AS A1, A2, A3 FROM turns) ON A1, A2, A3 INTO NAME axis VALUE raw)""")
def ratings_long(spark, sf_dir):
    t = turn_ratings(spark, sf_dir).withColumn("A1", F.coalesce("A1", F.lit("-")))
    return R.long_ratings(t, ["run_id", "turn_number"], R.AXES)


@query(f"""WITH {RATERS} SELECT item_id, source, min(rating) FILTER (WHERE axis = 'A1') AS A1, min(rating) FILTER (WHERE axis = 'A2') AS A2, min(rating) FILTER (WHERE axis = 'A3') AS A3 FROM raters GROUP BY item_id, source""")
def ratings_wide(spark, sf_dir):
    return R.wide_ratings(rater_items(spark, sf_dir), ["item_id", "source"], R.AXES, "axis", "rating")


@query(f"""WITH {LOG}, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, annotator_id ORDER BY log_index) AS INT) AS revision FROM log)
  SELECT CAST(log_index AS VARCHAR) AS annotation_id, item_id, annotator_id, log_index, revision, axis, CASE axis WHEN 'A1' THEN A1 ELSE A2 END AS raw FROM x, (VALUES ('A1'), ('A2')) AS v(axis)""")
def tidy_annotation_rows(spark, sf_dir):
    return R.tidy_rows(annotation_log(spark, sf_dir).withColumn("annotation_id", F.col("log_index").cast("string")), ("A1", "A2"))


# --- trajectories ----------------------------------------------------------------------------------------------------

_SUMMARY_SQL = f"""WITH {SCORED},
inside AS (SELECT * FROM cells WHERE t <= 6),
onset AS (SELECT run_id, min(t) FILTER (WHERE s_A1 = 2) AS o FROM inside GROUP BY run_id),
s AS (SELECT run_id, {", ".join(f"max({m}) AS {m}" for m in ("script_id", "theme", "presentation_level", "model_slot", "context_condition", "repetition"))} FROM turns GROUP BY run_id),
d AS (SELECT run_id, CAST(sum(c - 1) AS BIGINT) AS duplicate_turn_rows FROM cells GROUP BY run_id),
g AS (SELECT i.run_id, count(*) AS present,
  count(*) FILTER (WHERE coalesce(r_A1, r_A2, r_A3) IS NOT NULL) AS any_t, count(*) FILTER (WHERE r_A1 IS NOT NULL AND r_A2 IS NOT NULL AND r_A3 IS NOT NULL) AS all_t,
  {", ".join(f"count(r_{a}) AS o_{a}, avg(s_{a}) AS mean_{a}, CAST(max(s_{a}) AS DOUBLE) AS max_{a}, CAST(max(s_{a}) FILTER (WHERE t = 6) AS DOUBLE) AS final_{a}" for a in R.AXES)},
  count(s_A1) AS n_a1, min(t) FILTER (WHERE s_A3 >= 1) AS safe, count(s_A1) FILTER (WHERE t > o) AS seen, count(*) FILTER (WHERE t > o AND s_A1 = 2) AS high, min(t) FILTER (WHERE t > o AND s_A1 < 2) AS recov
  FROM inside i JOIN onset USING (run_id) GROUP BY i.run_id),
summary AS (SELECT s.*, CAST(6 AS BIGINT) AS expected_turns, coalesce(present, 0) AS turn_rows_present, coalesce(any_t, 0) AS turns_with_any_score, coalesce(all_t, 0) AS complete_turns,
  6 - coalesce(all_t, 0) AS incomplete_turns, 6 - coalesce(present, 0) AS missing_turn_rows, 18 - coalesce(o_A1 + o_A2 + o_A3, 0) AS missing_score_cells,
  coalesce(o_A1 + o_A2 + o_A3, 0) / 18 AS completeness_rate, coalesce(o_A1 + o_A2 + o_A3, 0) = 18 AS is_complete, duplicate_turn_rows,
  {", ".join(f"coalesce(o_{a}, 0) AS observed_{a}, 6 - coalesce(o_{a}, 0) AS missing_{a}, coalesce(o_{a}, 0) / 6 AS completeness_{a}, mean_{a}, max_{a}, final_{a}, final_{a} - mean_{a} AS final_minus_mean_{a}, final_{a} - max_{a} AS final_minus_max_{a}" for a in R.AXES)},
  CASE WHEN n_a1 > 0 THEN o IS NOT NULL END AS any_A1_2, o AS first_A1_2_turn, safe AS first_A3_safety_turn, coalesce(seen, 0) AS post_onset_observed_turns,
  CASE WHEN o IS NULL THEN 0 ELSE 6 - o - seen END AS post_onset_missing_turns, coalesce(high, 0) AS post_onset_high_risk_turns,
  CASE WHEN seen > 0 THEN high / seen END AS persistence_after_onset_rate, CASE WHEN seen > 0 THEN high = seen END AS persistent_after_onset,
  CASE WHEN seen > 0 THEN recov IS NOT NULL END AS recovery_after_high_risk_turn, recov AS first_recovery_turn
  FROM s JOIN d USING (run_id) LEFT JOIN g USING (run_id) LEFT JOIN onset USING (run_id))"""


def _summaries(spark, sf_dir):
    return trajectory.summarize_conversations(turn_ratings(spark, sf_dir))


@query(f"{_SUMMARY_SQL} SELECT * FROM summary")
def trajectory_summary(spark, sf_dir):
    return _summaries(spark, sf_dir)


@query(f"""WITH {SCORED}, p AS (SELECT run_id, max(t) AS planned, count(*) AS present FROM cells GROUP BY run_id)
  SELECT run_id, CAST(planned AS BIGINT) AS expected_turns, present AS turn_rows_present, planned - present AS missing_turn_rows,
  CAST((SELECT max(s_A1) FROM cells c WHERE c.run_id = p.run_id AND c.t = p.planned) AS DOUBLE) AS final_A1 FROM p""")
def trajectory_open_ended(spark, sf_dir):
    t = trajectory.summarize_conversations(turn_ratings(spark, sf_dir), expected_turns=None, metadata=())
    return t.select("run_id", "expected_turns", "turn_rows_present", "missing_turn_rows", "final_A1")


@query(f"""{_SUMMARY_SQL}, f AS (SELECT factor, level, any_A1_2, first_A1_2_turn, first_A3_safety_turn, recovery_after_high_risk_turn, persistence_after_onset_rate FROM
  (SELECT *, unnest(['model_slot', 'presentation_level', 'context_condition', 'theme']) AS factor, unnest([model_slot, presentation_level, context_condition, theme]) AS level FROM summary))
SELECT factor, level, count(*) AS n_conversations, CAST(coalesce(sum(CAST(any_A1_2 AS INT)), 0) AS BIGINT) AS conversations_with_A1_2, avg(CAST(any_A1_2 AS INT)) AS proportion_with_A1_2,
  CAST(median(first_A1_2_turn) AS DOUBLE) AS median_first_A1_2_turn, count(first_A3_safety_turn) AS conversations_with_A3_intervention, CAST(median(first_A3_safety_turn) AS DOUBLE) AS median_first_A3_intervention_turn,
  avg(CAST(recovery_after_high_risk_turn AS INT)) AS recovery_rate_after_A1_2, avg(persistence_after_onset_rate) AS mean_persistence_after_A1_2 FROM f GROUP BY factor, level""")
def trajectory_event_table(spark, sf_dir):
    return trajectory.event_table(_summaries(spark, sf_dir))


def _axes_sql(axes):
    n = "TRY_CAST(trim({0}) AS DOUBLE)"
    per = [f"avg({n.format(a)}) AS mean_{a}, avg({n.format(a)}) FILTER (WHERE turn_number IN (1, 2)) AS early_{a}, avg({n.format(a)}) FILTER (WHERE turn_number IN (5, 6)) AS late_{a}" for a in axes]
    return f"""WITH {TURNS}, conv AS (SELECT run_id, {", ".join(f"max({m}) AS {m}" for m in ("script_id", "theme", "presentation_level", "model_slot", "context_condition", "repetition"))}, {", ".join(per)} FROM turns GROUP BY run_id),
conversations_x AS (SELECT *, {", ".join(f"late_{a} - early_{a} AS late_minus_early_{a}" for a in axes)} FROM conv)"""


_CONV = _axes_sql(R.ALL_AXES)


def _conversations(spark, sf_dir):
    return trajectory.conversation_axes(turn_ratings(spark, sf_dir))


@query(f"{_CONV} SELECT * FROM conversations_x")
def conversation_axes(spark, sf_dir):
    return _conversations(spark, sf_dir)


# --- summaries -------------------------------------------------------------------------------------------------------

_LONG = f"""WITH {TURNS}, raw_long AS (SELECT t.*, axis, CASE axis {" ".join(f"WHEN '{a}' THEN {a}" for a in R.ALL_AXES)} END AS raw FROM turns t, (VALUES {", ".join(f"('{a}')" for a in R.ALL_AXES)}) AS v(axis)),
long AS (SELECT *, CASE WHEN upper(trim(raw)) = 'N/A' THEN 'N/A' ELSE CAST(TRY_CAST(trim(raw) AS INT) AS VARCHAR) END AS rating, CAST(TRY_CAST(trim(raw) AS INT) AS DOUBLE) AS score FROM raw_long)"""
_STATS = """count(*) AS n_total, count(score) AS n_numeric, count(*) FILTER (WHERE rating = 'N/A') AS n_na, avg(score) AS mean, median(score) AS median, stddev_samp(score) AS std,
  count(*) FILTER (WHERE score = 0) AS count_0, count(*) FILTER (WHERE score = 1) AS count_1, count(*) FILTER (WHERE score = 2) AS count_2"""


@query(f"""{_LONG}, f AS (SELECT *, unnest(['overall', 'model_slot', 'presentation_level', 'context_condition', 'theme', 'turn_number']) AS factor,
  unnest(['all', model_slot, presentation_level, context_condition, theme, CAST(turn_number AS VARCHAR)]) AS level FROM long),
g AS (SELECT factor, level, axis, {_STATS} FROM f GROUP BY factor, level, axis)
SELECT *, CASE WHEN n_numeric > 0 THEN count_0 / n_numeric END AS prop_0, CASE WHEN n_numeric > 0 THEN count_1 / n_numeric END AS prop_1, CASE WHEN n_numeric > 0 THEN count_2 / n_numeric END AS prop_2 FROM g""")
def score_summary(spark, sf_dir):
    return summary.score_summary(turn_ratings(spark, sf_dir), ("model_slot", "presentation_level", "context_condition", "theme", "turn_number"))


@query(f"""{_LONG}, g AS (SELECT model_slot, presentation_level, axis, {_STATS} FROM long GROUP BY ALL)
SELECT * EXCLUDE (std), CASE WHEN n_numeric > 0 THEN count_2 / n_total END AS prop_score_2 FROM g""")
def grouped_score_summary(spark, sf_dir):
    return summary.grouped_score_summary(turn_ratings(spark, sf_dir), ("model_slot", "presentation_level"))


@query(f"""{_LONG} SELECT model_slot, presentation_level, turn_number, axis, {_STATS},
  CASE WHEN grouping(model_slot) = 0 AND grouping(presentation_level) = 0 THEN 'model_slot+presentation_level' WHEN grouping(model_slot) = 0 THEN 'model_slot+turn_number' WHEN grouping(presentation_level) = 0 THEN 'presentation_level+turn_number' ELSE 'overall' END AS grouping
FROM long GROUP BY GROUPING SETS ((axis), (model_slot, presentation_level, axis), (model_slot, turn_number, axis), (presentation_level, turn_number, axis))""")
def grouping_report(spark, sf_dir):
    return summary.grouping_report(turn_ratings(spark, sf_dir), ((), ("model_slot", "presentation_level"), ("model_slot", "turn_number"), ("presentation_level", "turn_number")))


@query(f"""WITH {TURNS} SELECT presentation_level, model_slot, turn_number, count(*) AS n_rows, avg(TRY_CAST(A1 AS DOUBLE)) AS mean_score, avg(CASE WHEN A1 = '2' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS proportion_2 FROM turns GROUP BY ALL""")
def turn_table(spark, sf_dir):
    return summary.turn_table(turn_ratings(spark, sf_dir))


@query(f"""WITH {TURNS}, x AS (SELECT *, turn_number = 7 AS truncated FROM turns) SELECT subset, model_slot, count(*) AS n_rows, avg(TRY_CAST(B1 AS DOUBLE)) AS mean_score
  FROM (SELECT *, unnest(CASE WHEN truncated THEN ['all'] ELSE ['all', 'unflagged'] END) AS subset FROM x) GROUP BY ALL""")
def truncation_sensitivity(spark, sf_dir):
    return summary.sensitivity(turn_ratings(spark, sf_dir).withColumn("truncated", F.col("turn_number") == 7), "truncated", ("model_slot",), "B1")


# --- matched pairs and inference ------------------------------------------------------------------------------------

_PAIRS = f"""{_CONV}, pairs AS (SELECT script_id, context_condition, repetition,
  avg(mean_A1) FILTER (WHERE model_slot = 'model_0') AS value_a, avg(mean_A1) FILTER (WHERE model_slot = 'model_1') AS value_b,
  nullif(count(mean_A1) FILTER (WHERE model_slot = 'model_0'), 0) AS n_a, nullif(count(mean_A1) FILTER (WHERE model_slot = 'model_1'), 0) AS n_b
  FROM conversations_x WHERE mean_A1 IS NOT NULL GROUP BY ALL)"""


@query(f"{_PAIRS} SELECT *, value_b - value_a AS difference FROM pairs")
def matched_pair_differences(spark, sf_dir):
    return matched.matched_pair_differences(_conversations(spark, sf_dir), "mean_A1", "model_slot", "model_0", "model_1", MODEL_KEYS)


@query(f"{_PAIRS} SELECT script_id, context_condition, repetition, value_a, value_b, value_b - value_a AS difference FROM pairs WHERE value_a IS NOT NULL AND value_b IS NOT NULL")
def matched_values(spark, sf_dir):
    return matched.matched_values(_conversations(spark, sf_dir), "mean_A1", "model_slot", "model_0", "model_1", MODEL_KEYS)


@query(f"""{_CONV}, o AS (SELECT *, unnest(['mean_A1', 'mean_B1']) AS outcome, unnest([mean_A1, mean_B1]) AS y FROM conversations_x),
m AS (SELECT 'model_slot' AS factor, outcome, model_slot AS level, concat_ws('|', script_id, repetition, context_condition) AS cell, avg(y) AS v FROM o WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'presentation_level', outcome, presentation_level, concat_ws('|', theme, repetition, context_condition, model_slot), avg(y) FROM o WHERE y IS NOT NULL GROUP BY ALL),
l AS (SELECT DISTINCT factor, outcome, level FROM m),
p AS (SELECT a.factor, a.outcome, a.level AS level_a, b.level AS level_b FROM l a JOIN l b USING (factor, outcome) WHERE a.level < b.level),
c AS (SELECT p.factor, p.outcome, level_a, level_b, cell, max(v) FILTER (WHERE level = level_a) AS x, max(v) FILTER (WHERE level = level_b) AS y FROM m JOIN p ON m.factor = p.factor AND m.outcome = p.outcome AND m.level IN (level_a, level_b) GROUP BY ALL)
SELECT factor, level_a, level_b, outcome, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_pairs, avg(x) FILTER (WHERE y IS NOT NULL) AS mean_a, avg(y) FILTER (WHERE x IS NOT NULL) AS mean_b,
  avg(y - x) AS mean_difference, median(y - x) AS median_difference, stddev_samp(y - x) AS std_difference, min(y - x) AS min_difference, max(y - x) AS max_difference,
  count(*) FILTER (WHERE x IS NOT NULL AND y IS NULL) AS n_unmatched_a, count(*) FILTER (WHERE y IS NOT NULL AND x IS NULL) AS n_unmatched_b FROM c GROUP BY ALL""")
def matched_comparisons(spark, sf_dir):
    keys = {"model_slot": ("script_id", "repetition", "context_condition"), "presentation_level": ("theme", "repetition", "context_condition", "model_slot")}
    return matched.matched_comparisons(_conversations(spark, sf_dir), ("mean_A1", "mean_B1"), keys)


@query(f"""{_CONV}, g AS (SELECT theme, context_condition, repetition, {", ".join(f"avg(mean_A1) FILTER (WHERE model_slot = 'model_{m}' AND presentation_level = '{p}') AS {n}" for n, m, p in (("la", 0, "control"), ("lb", 0, "fixed_belief"), ("ha", 1, "control"), ("hb", 1, "fixed_belief")))} FROM conversations_x GROUP BY ALL)
SELECT theme, context_condition, repetition, lb - la AS effect_low, hb - ha AS effect_high, (hb - ha) - (lb - la) AS difference FROM g WHERE lb - la IS NOT NULL AND hb - ha IS NOT NULL""")
def model_presentation_interaction(spark, sf_dir):
    return matched.interaction(_conversations(spark, sf_dir), "mean_A1", "presentation_level", "control", "fixed_belief", "model_slot", "model_0", "model_1", ("theme", "context_condition", "repetition"))


def _family(spark, sf_dir, outcomes, condition, pairs, keys):
    return matched.family(_conversations(spark, sf_dir), outcomes, condition, pairs, keys)


def _family_sql(outcomes, condition, pairs, keys):
    tests = " UNION ALL ".join(f"SELECT '{a}__{b}' AS comparison, '{o}' AS outcome, avg({o}) FILTER (WHERE {condition} = '{b}') - avg({o}) FILTER (WHERE {condition} = '{a}') AS difference FROM conversations_x GROUP BY {', '.join(keys)}" for o in outcomes for a, b in pairs)
    return f"""{_CONV}, diffs AS (SELECT * FROM ({tests}) WHERE difference IS NOT NULL),
r AS (SELECT comparison, outcome, difference, round(difference, 9) AS d FROM diffs),
k AS (SELECT comparison, outcome, d, rank() OVER (PARTITION BY comparison, outcome ORDER BY abs(d)) + (count(*) OVER (PARTITION BY comparison, outcome, abs(d)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY comparison, outcome, abs(d)) AS t FROM r WHERE d <> 0),
w AS (SELECT comparison, outcome, count(*) AS n_nonzero, sum(rk) FILTER (WHERE d > 0) AS wp, sum(rk) FILTER (WHERE d < 0) AS wm, CAST(sum(t * t - 1) AS BIGINT) AS tie_sum FROM k GROUP BY ALL),
f AS (SELECT comparison, outcome, count(*) AS n, count(*) FILTER (WHERE d = 0) AS zeros, avg(difference) AS mean_difference, median(difference) AS median_difference FROM r GROUP BY ALL),
stats AS (SELECT f.*, coalesce(n_nonzero, 0) AS n_nonzero, coalesce(wp, 0)::DOUBLE AS w_plus, coalesce(wm, 0)::DOUBLE AS w_minus, coalesce(tie_sum, 0) AS tie_sum FROM f LEFT JOIN w USING (comparison, outcome)),
tested AS (SELECT *, least(w_plus, w_minus) AS statistic, (least(w_plus, w_minus) - n_nonzero * (n_nonzero + 1) / 4) / sqrt(nullif(n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24 - tie_sum / 48, 0)) AS z,
  CASE WHEN n_nonzero > 0 THEN (w_plus - w_minus) / (w_plus + w_minus) ELSE 0.0 END::DOUBLE AS rank_biserial FROM stats)"""


_RQ1 = (("mean_A1", "mean_A2", "mean_A3"), "presentation_level", PRESENTATIONS, ("theme", "model_slot", "context_condition", "repetition"))
_RQ2 = (("mean_A1", "mean_A2", "mean_A3"), "model_slot", (("model_0", "model_1"),), ("script_id", "context_condition", "repetition"))
_RQ3 = (("mean_A1", "mean_A2", "mean_A3"), "context_condition", (("no_preloaded", "preloaded"),), ("script_id", "model_slot", "repetition"))
_MAIN = (("mean_B1", "mean_B2", "mean_B3", "mean_C1"), "presentation_level", PRESENTATIONS, ("theme", "model_slot", "context_condition", "repetition"))
_THEME = (tuple(f"mean_{a}" for a in R.ALL_AXES), "theme", (("theme_0", "theme_1"), ("theme_0", "theme_2"), ("theme_1", "theme_2")), ("presentation_level", "model_slot", "context_condition", "repetition"))
_TIME = (tuple(f"late_minus_early_{a}" for a in R.AXES), "presentation_level", PRESENTATIONS, ("theme", "model_slot", "context_condition", "repetition"))


def _statistics(spec):
    def run(spark, sf_dir):
        return inference.signed_rank_statistics(_family(spark, sf_dir, *spec), ("comparison", "outcome"))

    return run


for _name, _spec in (("presentation_signed_ranks", _RQ1), ("model_signed_ranks", _RQ2), ("context_signed_ranks", _RQ3), ("exploratory_main_effects", _MAIN), ("theme_effects", _THEME), ("presentation_by_time", _TIME)):
    QUERIES[_name] = _statistics(_spec)
    ORACLES[_name] = f"{_family_sql(*_spec)} SELECT * FROM tested"


@query(f"""{_family_sql(*_RQ1)}, p AS (SELECT *, 1 / (1 + abs(z)) AS p_value FROM tested),
s AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, comparison, outcome) + 1) * p_value) AS step FROM p)
SELECT comparison, outcome, z, p_value, max(step) OVER (ORDER BY p_value, comparison, outcome) AS p_holm, coalesce(max(step) OVER (ORDER BY p_value, comparison, outcome) < 0.05, false) AS significant_0_05 FROM s""")
def holm_family(spark, sf_dir):
    """Step-down correction of a native stand-in for p, which SQL can follow."""
    s = _statistics(_RQ1)(spark, sf_dir).withColumn("p_value", 1 / (1 + F.abs("z"))).withColumn("family", F.lit("presentation"))
    return inference.holm(s, ("family",), order=("comparison", "outcome")).select("comparison", "outcome", "z", "p_value", "p_holm", "significant_0_05")


@query()
def presentation_tests(spark, sf_dir):
    """The family with its p-values, step-down correction and seeded intervals."""
    d = _family(spark, sf_dir, *_RQ1)
    tests = inference.holm(inference.signed_rank_test(d, ("comparison", "outcome")).withColumn("family", F.lit("presentation")), ("family",), order=("comparison", "outcome"))
    ci = inference.seeded_bootstrap(d, ("comparison", "outcome"), "difference", ("theme", "model_slot", "context_condition", "repetition"), seed=20260902)
    return tests.join(ci.select("comparison", "outcome", "ci_low", "ci_high"), ["comparison", "outcome"])


@query(f"""{_CONV}, r AS (SELECT outcome, y AS difference, round(y, 9) AS d FROM (SELECT unnest(['late_minus_early_A1', 'late_minus_early_B1']) AS outcome, unnest([late_minus_early_A1, late_minus_early_B1]) AS y FROM conversations_x) WHERE y IS NOT NULL),
k AS (SELECT outcome, d, rank() OVER (PARTITION BY outcome ORDER BY abs(d)) + (count(*) OVER (PARTITION BY outcome, abs(d)) - 1) / 2 AS rk FROM r WHERE d <> 0)
SELECT outcome, (SELECT count(*) FROM r x WHERE x.outcome = k.outcome) AS n, count(*) AS n_nonzero, sum(rk) FILTER (WHERE d > 0)::DOUBLE AS w_plus, sum(rk) FILTER (WHERE d < 0)::DOUBLE AS w_minus FROM k GROUP BY outcome""")
def overall_early_late(spark, sf_dir):
    long = _conversations(spark, sf_dir).select("run_id", "late_minus_early_A1", "late_minus_early_B1").unpivot(["run_id"], ["late_minus_early_A1", "late_minus_early_B1"], "outcome", "difference")
    return inference.signed_rank_statistics(long, ("outcome",)).select("outcome", "n", "n_nonzero", "w_plus", "w_minus")


@query(f"""{_family_sql(*_RQ2)}, placed AS (SELECT outcome, difference AS v, row_number() OVER (PARTITION BY outcome ORDER BY difference) - 1 AS k, count(*) OVER (PARTITION BY outcome) AS n FROM diffs),
draws AS (SELECT s.outcome, r, CAST(('0x' || substr(md5('s|' || r || '|' || j), 1, 8)) AS BIGINT) % n AS k FROM (SELECT DISTINCT outcome, n FROM placed) s, range(200) AS a(r), range(1000) AS b(j) WHERE j < n),
m AS (SELECT d.outcome, r, avg(v) AS m FROM draws d JOIN placed p ON p.outcome = d.outcome AND p.k = d.k GROUP BY ALL)
SELECT outcome, any_value(n) AS n, avg(v) AS estimate, any_value(lo) AS ci_low, any_value(hi) AS ci_high FROM placed JOIN (SELECT outcome, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY outcome) USING (outcome) GROUP BY outcome""")
def hashed_bootstrap(spark, sf_dir):
    return inference.hashed_bootstrap(_family(spark, sf_dir, *_RQ2), ("outcome",), "difference", ("difference",))


@query()
def group_mean_bootstrap(spark, sf_dir):
    return inference.counted_bootstrap(_conversations(spark, sf_dir), ("presentation_level",), "mean_A1", seed=7)


# --- agreement -------------------------------------------------------------------------------------------------------

_PAIRED = f"""WITH {RATERS}, ranked AS (SELECT *, list_position(['human', 'judge_1', 'judge_2', 'judge_3'], source) AS k FROM raters),
pairs AS (SELECT x.item_id, x.axis, x.source AS source_a, y.source AS source_b, x.rating AS a, y.rating AS b, TRY_CAST(x.rating AS INT) AS na, TRY_CAST(y.rating AS INT) AS nb FROM ranked x JOIN ranked y ON x.item_id = y.item_id AND x.axis = y.axis AND x.k < y.k)"""


def _kappa_sql(a, b, where, axis="max(axis)"):
    ok = f"({a}) IS NOT NULL AND ({b}) IS NOT NULL" + (f" AND {where}" if where else "")
    avg = lambda x: f"avg(CASE WHEN {ok} THEN CAST({x} AS DOUBLE) END)"
    p = [avg(f"CAST(({a}) = {k} AS INT)") for k in range(3)]
    q = [avg(f"CAST(({b}) = {k} AS INT)") for k in range(3)]
    far = " + ".join(f"{abs(i - j) / 2} * {p[i]} * {q[j]}" for i in range(3) for j in range(3) if i != j)
    same = " + ".join(f"{p[k]} * {q[k]}" for k in range(3))
    linear = f"CASE WHEN ({far}) > 1e-15 THEN 1 - {avg(f'abs(({a}) - ({b})) / 2')} / ({far}) END"
    plain = f"CASE WHEN abs(1 - ({same})) > 1e-15 THEN ({avg(f'CAST(({a}) = ({b}) AS INT)')} - ({same})) / (1 - ({same})) END"
    return f"CASE WHEN count(CASE WHEN {ok} THEN 1 END) >= 2 THEN CASE WHEN {axis} = 'A3' THEN {plain} ELSE {linear} END END"


@query(f"""{_PAIRED} SELECT source_a, source_b, axis, count(*) AS n_items_common, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_all_ratings,
  avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS exact_agreement_including_na, count(*) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL) AS n_numeric_pairs,
  avg(CASE WHEN na = nb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL) AS exact_agreement_numeric, {_kappa_sql("na", "nb", "")} AS cohen_kappa,
  CASE WHEN axis = 'A3' THEN 'unweighted' ELSE 'linear_weighted' END AS kappa_method FROM pairs GROUP BY source_a, source_b, axis""")
def agreement_table(spark, sf_dir):
    return agreement.agreement_table(rater_items(spark, sf_dir), SOURCES)


@query(f"{_PAIRED} SELECT source_a, source_b, axis, coalesce(a, 'None') AS score_a, coalesce(b, 'None') AS score_b, count(*) AS n FROM pairs GROUP BY ALL")
def confusion_counts(spark, sf_dir):
    return agreement.confusion(rater_items(spark, sf_dir), SOURCES)


@query(f"""WITH {RATERS}, i AS (SELECT item_id, axis, min(rating) FILTER (WHERE source <> 'human') AS lo, max(rating) FILTER (WHERE source <> 'human') AS hi, count(rating) FILTER (WHERE source <> 'human') AS v, max(rating) FILTER (WHERE source = 'human') AS ref FROM raters GROUP BY ALL),
g AS (SELECT axis, count(*) AS n_items, count(*) FILTER (WHERE v = 3 AND lo = hi) AS unanimous_items, count(*) FILTER (WHERE v = 3 AND lo = hi AND ref = lo) AS unanimous_matches FROM i GROUP BY axis)
SELECT *, unanimous_items / n_items AS unanimity_rate, CASE WHEN unanimous_items > 0 THEN unanimous_matches / unanimous_items END AS match_rate_when_unanimous, unanimous_matches / n_items AS match_rate_all_items FROM g""")
def judge_unanimity(spark, sf_dir):
    return agreement.unanimity(rater_items(spark, sf_dir), "human", JUDGES)


@query(f"""WITH {RATERS}, j AS (SELECT item_id, axis, rating, count(*) AS c FROM raters WHERE source <> 'human' GROUP BY ALL),
t AS (SELECT item_id, axis, arg_max(rating, c) AS vote, max(c) AS c FROM j GROUP BY ALL),
r AS (SELECT h.axis, h.rating AS ref, CASE WHEN c >= 2 THEN vote END AS vote, c = 3 AS every FROM raters h LEFT JOIN t USING (item_id, axis) WHERE source = 'human'),
n AS (SELECT *, TRY_CAST(ref AS INT) AS na, TRY_CAST(vote AS INT) AS nb FROM r)
SELECT axis, count(*) AS total_items, count(vote) AS majority_available, count(vote) / count(*) AS majority_available_rate, count(*) FILTER (WHERE every) AS judges_unanimous, count(*) FILTER (WHERE ref = vote) AS exact_matches,
  count(*) FILTER (WHERE ref = vote) / nullif(count(vote), 0) AS exact_agreement, count(*) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL) AS numeric_pairs,
  count(*) FILTER (WHERE na = nb) / nullif(count(*) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL), 0) AS numeric_exact_agreement, count(*) FILTER (WHERE ref = 'N/A' AND vote = 'N/A') AS both_na,
  count(*) FILTER (WHERE ref = 'N/A' AND vote <> 'N/A') AS reference_na_only, count(*) FILTER (WHERE ref <> 'N/A' AND vote = 'N/A') AS majority_na_only, {_kappa_sql("na", "nb", "")} AS kappa,
  CASE WHEN axis = 'A3' THEN 'unweighted' ELSE 'linear_weighted' END AS kappa_method FROM n GROUP BY axis""")
def majority_vote(spark, sf_dir):
    return agreement.majority_vote(rater_items(spark, sf_dir), "human", JUDGES)


@query(f"""{_PAIRED} SELECT axis, count(*) AS n_common, count(*) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL) AS n_pairs, avg(CASE WHEN na = nb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL) AS exact_agreement,
  {_kappa_sql("na", "nb", "")} AS kappa, CAST(NULL AS VARCHAR) AS reason FROM pairs WHERE source_a = 'judge_1' AND source_b = 'judge_2' GROUP BY axis""")
def reliability_report(spark, sf_dir):
    r = rater_items(spark, sf_dir)
    return agreement.reliability(r.where("source = 'judge_1'"), r.where("source = 'judge_2'"), ("item_id",))


# --- displays and rules ----------------------------------------------------------------------------------------------


@query(f"""{_SUMMARY_SQL} SELECT count(*) AS n, CAST(sum(CAST(is_complete AS INT)) AS BIGINT) AS complete, CAST(sum(CAST(coalesce(any_A1_2, false) AS INT)) AS BIGINT) AS with_event, avg(completeness_rate) AS mean_completeness FROM summary""")
def headline_metrics(spark, sf_dir):
    return displays.headline(_summaries(spark, sf_dir))


@query(f"""{_CONV}, m AS (SELECT script_id, context_condition, repetition, avg(mean_B1) FILTER (WHERE model_slot = 'model_0') AS a, avg(mean_B1) FILTER (WHERE model_slot = 'model_1') AS b FROM conversations_x GROUP BY ALL)
SELECT 'First model → Model 1' AS comparison, 'mean_B1' AS outcome, count(b - a) AS n_pairs, printf('%+.3f', avg(b - a)) AS difference, CASE WHEN avg(b - a) > 0 THEN 'up' WHEN avg(b - a) < 0 THEN 'down' ELSE 'none' END AS direction FROM m""")
def comparison_display(spark, sf_dir):
    c = matched.matched_comparisons(_conversations(spark, sf_dir), ("mean_B1",), {"model_slot": MODEL_KEYS})
    return displays.comparison_display(c, {"model_0": "First model"})


@query(f"{_family_sql(*_RQ1)} SELECT 'presentation' AS family, comparison, outcome, rank_biserial FROM tested WHERE abs(z) > 1 UNION ALL SELECT 'model', comparison, outcome, rank_biserial FROM ({_family_sql(*_RQ2)} SELECT * FROM tested) WHERE abs(z) > 1")
def significant_rows(spark, sf_dir):
    """Rows marked in two families (by the size of z, which SQL can follow)."""
    mark = lambda f: f.withColumn("significant_0_05", F.when(F.abs("z") > 1, "True").otherwise("False"))
    both = displays.union_families({"presentation": mark(_statistics(_RQ1)(spark, sf_dir)), "model": mark(_statistics(_RQ2)(spark, sf_dir)).drop("median_difference")})
    return displays.significant(both).select("family", "comparison", "outcome", "rank_biserial")


@query(f"""WITH {TURNS} SELECT unnest([{", ".join(f"'{a}_in_domain'" for a in R.ALL_AXES)}]) AS rule, unnest([count(*) FILTER (WHERE A1 NOT IN ('0', '1', '2')), CAST(0 AS BIGINT), count(*) FILTER (WHERE A3 NOT IN ('0', '1', 'N/A')), 0, 0, 0, 0]) AS violations FROM turns""")
def rating_rules(spark, sf_dir):
    return integrity.expectations(turn_ratings(spark, sf_dir), validation.rating_rules())


@query("""SELECT user_id AS job, CASE WHEN user_id % 13 = 0 THEN 'BLOCKED' WHEN count(*) >= 220 THEN 'COMPLETE' WHEN user_id % 5 = 0 THEN 'RUNNING' WHEN count(*) FILTER (WHERE event_type = 'error') >= 45 THEN 'BLOCKED' ELSE 'RESUMABLE' END AS status, count(*) / 220 AS progress FROM events GROUP BY user_id""")
def job_statuses(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    jobs = e.groupBy(F.col("user_id").alias("job")).agg(F.count("*").alias("done"), (F.lit(45) - F.count(F.when(F.col("event_type") == "error", 1))).alias("attempts_left"))
    jobs = jobs.withColumns({"blocked": F.col("job") % 13 == 0, "running": F.col("job") % 5 == 0, "planned": F.lit(220)})
    return displays.job_status(jobs).select("job", "status", "progress")
