"""Embedded literals, rule files, calibration, reliability from logs, cluster bootstraps, bundles and file digests."""

import ast
import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from cohortflow.functions import hashing, literals
from cohortflow.operators import agreement, baseline, bootstrap, calibration, events, rules, telemetry
from cohortflow.plans import evidence_queries
from cohortflow.sources import event_store
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

leaves = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=20) | st.binary(max_size=8)
values = st.recursive(leaves, lambda x: st.lists(x, max_size=4) | st.tuples(x, x) | st.tuples(x) | st.dictionaries(st.text(max_size=5) | st.integers(), x, max_size=4) | st.sets(st.integers(), min_size=1, max_size=3), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(values)
def test_literals_read_back(value):
    assert literals.parse(repr(value)) == value


@pytest.mark.parametrize(
    "text",
    ["{'a': 1, \"b\": [1, 2,], }", "  {'x': 'it\\'s' \" two\"}", "{'a': r'\\d', 'b': b'\\x41\\101', 'c': '\\u00e9\\U0001F600\\N{BULLET}'}", "{1: (1,), 2: (), 3: (4), 5: {6}, -7: +8}", "{'a': 1_000, 'b': 0xFF, 'c': 0o17, 'd': 0b11, 'e': 1e3, 'f': .5, 'g': 5.}", "'''a\nb'''", "{'a':\n 1, # note\n 'b': 2}", "1, 2", "{}", "[]", "()", "{'a': {'b': [{'c': None}]}}", "'\\\n'", "'\\q'", "0", "00"],
)
def test_literals_of_all_forms(text):
    assert literals.parse(text) == ast.literal_eval(text)


@pytest.mark.parametrize("text", ["", " ", "--1", "{'a': 1", "{'a': }", "{'a'}: 1", "{1: 2, 3}", "[1 2]", "'open", "'a\nb'", "f'x'", "a", "{'a': b}", "f(1)", "[1][0]", "1 + 'a'", "{[]: 1}", "{{}}", "'\\x4'", "b'é'", "01", "1__0", "'a' b'b'", "- 'a'", "(1", "1)", "[1,,2]", "[,]", "{,}", ":", "'\\N{no such name}'", "True1", "1a", "{'a': 1,, 'b': 2}", "(1)(2)", "1.2.3"])
def test_texts_that_are_no_literals(text):
    with pytest.raises((ValueError, KeyError)):
        literals.parse(text)


def test_embedded_errors(spark):
    deep = "{'code': 503, 'x': " + "[" * 100_000 + "]" * 100_000 + "}"
    long = "{'code': '429', 'message': '" + "word  " * 500_000 + "'}"
    texts = ["{'code': 502, 'message': ' too \\n busy '}", "{'code': True}", "{'code': 99, 'message': ''}", "{'error': {'code': 404}}", "{'message': 'm', 'error': {'code': 404}}", "[1]", "no", "", None, deep, long, "{'code': 5.0}", "{'code': ' 500 '}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, error_message string")
    got = [(r["embedded_code"], r["embedded_message"]) for r in literals.embedded_errors(rows, within="error").orderBy("i").collect()]
    assert got == [(502, "too busy"), (None, None), (None, None), (404, None), (None, "m"), (None, None), (None, None), (None, None), (None, None), (503, None), (429, ("word " * 500_000)[:240]), (None, None), (500, None)]
    assert literals.embedded_errors(rows.limit(0)).count() == 0
    assert [r["embedded_code"] for r in literals.embedded_errors(rows.where("i = 3")).collect()] == [None]


# --- calibration -----------------------------------------------------------------------------------------------------


def plain_next(by):
    """The rule in loops over a dictionary of finish reasons."""
    if "native_1024" not in by:
        return "native_1024"
    if "disabled_1024" not in by:
        return "disabled_1024"
    pair = (by["native_1024"], by["disabled_1024"])
    steps = []
    if pair == ("length", "length"):
        steps = [("disabled_2048", True), ("disabled_4096", by.get("disabled_2048") == "length")]
    elif pair == ("length", "stop"):
        agree = (by.get("native_1024_repeat"), by.get("disabled_1024_repeat")) == ("length", "stop")
        if not {"native_1024_repeat", "disabled_1024_repeat"} <= set(by):
            return "native_1024_repeat" if "native_1024_repeat" not in by else "disabled_1024_repeat"
        steps = [("native_2048", agree), ("native_4096", by.get("native_2048") == "length")]
    return next((name for name, due in steps if due and name not in by), None)


def test_calibration_of_every_state(spark):
    """All sets of up to four conditions with all finish reasons, as studies of one table."""
    records, studies = [], {}
    for n in range(5):
        for chosen in itertools.combinations(calibration.CONDITIONS, n):
            for finish in itertools.product(("stop", "length", None), repeat=n):
                study = len(studies)
                studies[study] = dict(zip(chosen, finish, strict=True))
                records += [(study, c, f, 10 * (i + 1) if c != "disabled_1024" else 5, True, True) for i, (c, f) in enumerate(studies[study].items())]
    frame = spark.createDataFrame(records, "study_id int, condition string, finish_reason string, reasoning_tokens int, has_usage boolean, responded boolean")
    found = {r["study_id"]: r for r in calibration.calibration(spark.range(len(studies)).select(F.col("id").cast("int").alias("study_id")), frame).collect()}
    assert {i: found[i]["next_condition"] for i in studies} == {i: plain_next(by) for i, by in studies.items()}
    assert found[0]["verdict"] == "NOT_RUN" and {found[i]["verdict"] for i in studies if i} == {"SUPPORTED", "INCONCLUSIVE"}
    for i, by in studies.items():
        assert (found[i]["verdict"] == "SUPPORTED") == (by.get("native_1024") == "length" and by.get("disabled_1024") == "stop")


def test_calibration_limits(spark):
    kinds = "study_id int, condition string, finish_reason string, reasoning_tokens int, has_usage boolean, responded boolean"
    rows = [(1, "native_1024", "length", 0, True, True), (1, "disabled_1024", "length", 0, True, True), (2, "native_1024", "length", 4, False, True), (2, "disabled_1024", "stop", 1, True, True), (3, "native_1024", None, None, None, False)]
    studies = spark.createDataFrame([(1,), (2,), (3,)], "study_id int")
    found = {r["study_id"]: (r["verdict"], r["next_condition"]) for r in calibration.calibration(studies, spark.createDataFrame(rows, kinds)).collect()}
    assert found == {1: ("NOT_SUPPORTED", "disabled_2048"), 2: ("INCONCLUSIVE", "native_1024_repeat"), 3: ("INCONCLUSIVE", None)}
    for bad in ((1, "native_1024", "stop", 1, True, True), (1, "other", "stop", 1, True, True)):
        with pytest.raises(Exception, match="repeats|no such condition"):
            calibration.calibration(studies, spark.createDataFrame([*rows, bad], kinds)).collect()


# --- rules -----------------------------------------------------------------------------------------------------------


def manifest(spark):
    rows, order = [], 0
    for t, p, m, c, r in itertools.product(range(3), range(3), range(2), range(2), (1, 2)):
        order += 1
        rows.append((f"r{t}{p}{m}{c}{r}", f"t{t}", f"p{p}", f"model_{m}", f"c{c}", r, f"maker/{m}:free", "g4", 100 + r, "v2", order))
    return spark.createDataFrame(rows, "run_id string, theme string, presentation_level string, model_slot string, context_condition string, repetition int, requested_model_id string, generation_config_version string, planned_seed long, study_version string, execution_order int")


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, []),
        ({"model_slot": "if(execution_order = 1, 'model_2', model_slot)"}, ["exactly_two_model_slots", "configured_model_slots", "configured_model_id", "expected_row_count", "all_cells_present"]),
        ({"requested_model_id": "if(execution_order = 1, 'maker/9:free', requested_model_id)"}, ["configured_model_id"]),
        ({"requested_model_id": "if(execution_order = 1, 'maker/Latest', requested_model_id)"}, ["configured_model_id", "fixed_free_model_id"]),
        ({"generation_config_version": "if(execution_order = 1, NULL, 'g4')"}, ["configured_generation_version"]),
        ({"planned_seed": "if(execution_order = 1, 1, planned_seed)"}, ["configured_seed"]),
        ({"study_version": "if(execution_order = 1, 'v1', study_version)"}, ["frozen_study_version"]),
        ({"run_id": "if(execution_order = 1, 'r00002', run_id)"}, ["unique_run_ids"]),
        ({"execution_order": "if(execution_order = 1, 2, execution_order)"}, ["complete_execution_order"]),
        ({"theme": "if(execution_order = 1, 't1', theme)"}, ["balanced_cells", "all_cells_present"]),
    ],
)
def test_manifest_rules_one_by_one(spark, change, broken):
    plan = manifest(spark).selectExpr("*").withColumns({c: F.expr(e) for c, e in change.items()})
    param = evidence_queries.manifest_parameters(["model_0", "model_1"], ["maker/0:free", "maker/1:free"], {1: 101, 2: 102}, "g4", "v2")
    found = rules.violations(plan, rules.bundled("manifest-v2"), param).orderBy("position").collect()
    assert len(found) == 13 and [r["rule"] for r in found if not r["passes"]] == broken


def test_manifest_of_another_size(spark):
    plan = manifest(spark).where("execution_order < 72")
    param = evidence_queries.manifest_parameters(["model_0", "model_1"], ["maker/0:free", "maker/1:free"], {1: 101, 2: 102}, "g4", "v2")
    found = rules.violations(plan, rules.bundled("manifest-v2"), param).where("NOT passes").orderBy("position").collect()
    assert [r["rule"] for r in found] == ["expected_row_count", "all_cells_present", "planned_response_slots"]


def test_amendment_checks_one_by_one(spark):
    rows = evidence_queries.amended_evidence(spark.range(30).select(F.col("id").alias("x")))
    found = rules.broken_rules(rows, rules.bundled("finish-amendment-v1")).orderBy("x").collect()
    assert [tuple(r["failed"]) for r in found] == [names for _, _, names in evidence_queries.FAULTS] + [()]
    every = {r.name for r in rules.bundled("finish-amendment-v1").rules}
    assert len(every) == 29 and every == {n for _, _, names in evidence_queries.FAULTS for n in names}
    good = rules.enforced(rows.where("x = 29"), rules.bundled("finish-amendment-v1"), ["x"])
    assert good.count() == 1
    with pytest.raises(Exception, match="study version"):
        rules.enforced(rows.where("x = 0"), rules.bundled("finish-amendment-v1"), ["x"]).collect()


@pytest.mark.parametrize("document", [{"version": "1"}, {"version": "1", "rules": []}, {"version": "1", "rules": [{"name": "a", "level": "row", "check": "true", "why": "x"}]}, {"version": "1", "rules": [{"name": "a", "level": "file", "check": "true"}]}, {"version": "1", "rules": [{"name": "a", "level": "group", "check": "true"}]}, {"version": "1", "rules": [{"name": "a", "level": "row", "check": "true"}] * 2}])
def test_rule_files_that_are_refused(document):
    with pytest.raises(ValueError):
        rules.rule_set(document)


# --- reliability -----------------------------------------------------------------------------------------------------


def test_reliability_from_the_log(spark):
    log = [("i1", "ann", "initial", 1, 1, "0", "0"), ("i1", "ann", "initial", 2, 2, "2", "1"), ("i1b", "ann", "initial", 2, 3, "1", "1"), ("r1", "ann", "rerating", 1, 4, "1", "1"), ("i2", "ann", "initial", 1, 5, "0", "0"), ("r2", "ann", "rerating", 1, 6, "0", "N/A"), ("i1", "bob", "initial", 9, 7, "1", None), ("i9", "ann", "initial", 1, 8, "2", "1")]
    frame = spark.createDataFrame(log, "item_id string, annotator_id string, rating_round string, saved_at int, log_index int, A1 string, A3 string")
    places = [("i1", "run1", 1, "initial"), ("i1b", "run1", 1, "initial"), ("r1", "run1", 1, "rerating"), ("i2", "run2", 1, "initial"), ("r2", "run2", 1, "rerating")]
    item_map = spark.createDataFrame(places, "item_id string, run_id string, turn_number int, rating_round string")
    latest = events.latest_by_source(frame, item_map, "ann").orderBy("run_id").collect()
    assert [(r["run_id"], r["item_id"], r["A1"]) for r in latest] == [("run1", "i1b", "1"), ("run2", "i2", "0")]
    intra = {r["axis"]: r for r in agreement.intra_rater(frame, item_map, "ann", ("A1", "A3")).collect()}
    assert (intra["A1"]["n_pairs"], intra["A1"]["exact_agreement"], intra["A1"]["cohen_kappa"]) == (2, 1.0, 1.0)
    assert (intra["A3"]["n_pairs"], intra["A3"]["reason"]) == (1, "At least two paired complete scores are required for kappa")
    inter = {r["axis"]: r for r in agreement.inter_rater(frame, item_map, "ann", "bob", ("A1", "A3")).collect()}
    assert (inter["A1"]["matched_items"], inter["A1"]["exact_agreement"], inter["A3"]["reason"]) == (1, 1.0, "No paired complete scores are available for this axis")
    with pytest.raises(ValueError):
        agreement.inter_rater(frame, item_map, "ann", "ann", ("A1",))
    with pytest.raises(Exception, match="holds twice"):
        events.latest_by_source(frame, item_map.unionByName(item_map.where("item_id = 'i2'")), "ann").collect()
    with pytest.raises(Exception, match="rating rounds differ"):
        events.latest_by_source(frame, item_map.withColumn("rating_round", F.lit("rerating")), "ann").collect()
    assert {r["n_pairs"] for r in agreement.inter_rater(frame.limit(0), item_map, "ann", "bob", ("A1",)).collect()} == {0}


# --- bootstrap -------------------------------------------------------------------------------------------------------


def test_cluster_bootstrap_has_the_distribution_of_drawing_rows(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, i % 23, float(x), "g") for i, x in enumerate(rng.gamma(2.0, 3.0, 160))] + [(500, None, 1.0, "g"), (501, 3, None, "g"), (600, 1, 4.0, "one")]
    frame = spark.createDataFrame(rows, "run_id int, script int, x double, grp string")
    x = np.array([r[2] for r in rows[:160]])
    for cluster in (None, "script"):
        got = {r["grp"]: r for r in bootstrap.mean_bootstrap(frame, "x", cluster=cluster, groups=("grp",), resamples=4_000, seed=1).collect()}
        key = np.arange(160) % 23 if cluster else np.arange(160)
        total, count = np.bincount(key, x), np.bincount(key)
        if not cluster:
            total, count = np.append(total, 1.0), np.append(count, 1)
        w = rng.multinomial(len(total), np.full(len(total), 1 / len(total)), size=40_000)
        means = (w @ total) / (w @ count)
        g = got["g"]
        assert (g["n_units"], g["n_resamples"], g["n_successful_resamples"]) == (len(total), 4_000, 4_000)
        assert g["estimate"] == pytest.approx(total.sum() / count.sum())
        assert np.allclose([g["ci_lower"], g["ci_upper"]], np.quantile(means, [0.025, 0.975]), atol=4 * means.std() / np.sqrt(4_000) * 2.7)
        assert (got["one"]["ci_lower"], got["one"]["ci_upper"], got["one"]["n_units"]) == (4.0, 4.0, 1)
    again = [bootstrap.mean_bootstrap(frame.repartition(n), "x", groups=("grp",), resamples=200, seed=5).orderBy("grp").collect() for n in (1, 6)]
    assert np.allclose([list(r)[1:] for r in again[0]], [list(r)[1:] for r in again[1]], rtol=1e-12)


def test_cluster_bootstrap_counts_weights_and_failures(spark):
    frame = spark.createDataFrame([(i, float(i % 2)) for i in range(3)], "run_id int, x double")
    one = lambda **o: bootstrap.cluster_bootstrap(frame, {"n": F.lit(1), "s": F.col("x")}, resamples=3_000, **o).first()
    assert one(statistic=F.col("n"))["ci_lower"] == one(statistic=F.col("n"))["ci_upper"] == 3.0
    failing = one(statistic=F.try_divide(F.col("n"), F.col("s")))
    assert abs(failing["n_successful_resamples"] - 3_000 * (1 - (2 / 3) ** 3)) < 120 and failing["n_resamples"] == 3_000
    assert bootstrap.mean_bootstrap(frame.limit(0), "x").count() == 0
    with pytest.raises(Exception, match="repeats"):
        bootstrap.mean_bootstrap(frame.unionByName(frame), "x").collect()
    with pytest.raises(ValueError):
        bootstrap.mean_bootstrap(frame, "x", resamples=0)


def test_matched_bootstrap(spark):
    rng = random.Random(1)
    rows = [(f"r{s}{k}{c}", s, k, c, rng.random() + (2.0 if c == "b" else 0.0)) for s in range(12) for k in range(3) for c in "ab"] + [("x", 99, 0, "a", 5.0)]
    frame = spark.createDataFrame(rows, "run_id string, script_id int, repetition int, level string, y double")
    for cluster, units in ((None, 36), ("script_id", 12)):
        r = bootstrap.matched_bootstrap(frame, "y", "level", "a", "b", ("script_id", "repetition"), cluster=cluster, resamples=500).first()
        assert (r["n_pairs"], r["n_units"]) == (36, units) and r["ci_lower"] < r["estimate"] < r["ci_upper"] and abs(r["estimate"] - 2) < 0.3


# --- labels, coefficients, hashes ------------------------------------------------------------------------------------


def test_evidence_label(spark):
    cases = {"a": ["Demo", "main_study"], "b": ["pilot", " TECHNICAL_PILOT "], "c": [None], "d": ["pilot", "main_study"], "e": ["pilot", None]}
    frame = spark.createDataFrame([(k, s) for k, v in cases.items() for s in v], "k string, s string")
    got = dict(frame.groupBy("k").agg(baseline.evidence_label(F.col("s"))).collect())
    assert {k: v.split()[0] for k, v in got.items()} == {"a": "DEMO", "b": "TECHNICAL", "c": "EXPLORATORY", "d": "EXPLORATORY", "e": "TECHNICAL"}
    assert frame.limit(0).agg(baseline.evidence_label(F.col("s"))).first()[0].startswith("EXPLORATORY")
    assert frame.agg(baseline.evidence_label(F.lit("x"), demo_only=True)).first()[0].startswith("DEMO")


def test_coefficients_of_two_classes(spark):
    class Fitted:
        class coefficientMatrix:  # noqa: N801
            toArray = staticmethod(lambda: np.array([[0.5, -0.25, 0.0]]))

    class Model:
        stages = [Fitted]

    words = spark.createDataFrame([(0, "up"), (1, "down"), (2, "flat")], "bucket int, term string")
    got = {(r["class"], r["side"], r["rank"]): (r["term"], r["weight"]) for r in baseline.top_coefficients(Model, words, 2).collect()}
    assert got == {(1, "positive", 1): ("up", 0.5), (1, "positive", 2): ("flat", 0.0), (1, "negative", 1): ("down", -0.25), (1, "negative", 2): ("flat", 0.0), (0, "positive", 1): ("down", 0.25), (0, "positive", 2): ("flat", 0.0), (0, "negative", 1): ("up", -0.5), (0, "negative", 2): ("flat", 0.0)}


def test_bundle_hash(spark):
    models = {"version": "1.3", "provider_routing": {"a": 1}, "generation": {"version": "generation-v3", "reasoning_policy": 1, "t": 0.5}, "model_slots": {"b": {"id": "é", "completion_limit_parameter": "x"}}}
    kept = {"version": "1.3", "generation": {"version": "generation-v3", "t": 0.5}, "model_slots": {"b": {"id": "é"}}}
    rows = [("b", "scripts", "s2", '{"z": 1, "a": "\\u00e9"}'), ("b", "scripts", "s1", "{}"), ("b", "histories", "h", '{"h": [2, 1]}'), ("b", "models", "m", json.dumps(models))]
    frame = spark.createDataFrame(rows, "bundle_id string, kind string, document_id string, document string")
    want = hashing.canonical_hash({"scripts": [{}, {"z": 1, "a": "é"}], "histories": [{"h": [2, 1]}], "models": kept})
    assert hashing.bundle_hashes(frame).first()["bundle_sha256"] == want
    later = models | {"version": "2.0", "generation": models["generation"] | {"version": "generation-v4"}}
    assert hashing.versioned_models(later) == later
    for bad in (frame.where("kind <> 'models'"), frame.withColumn("document", F.lit("nope"))):
        with pytest.raises(Exception, match="one models document|not JSON|Expecting value"):
            hashing.bundle_hashes(bad).collect()


def test_tree_digest_and_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_store, "PIECE", 1_000)
    root = tmp_path / "tree"
    files = {"b.txt": b"two", "a/x.txt": b"one", "a/y/x.txt": b"", "a.txt": bytes(range(256)) * 40, "c/big.bin": b"0" * 1_000}
    h = hashlib.sha256()
    for name in sorted(files):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(files[name])
        h.update(name.encode() + b"\0" + files[name] + b"\0")
    assert tuple(event_store.tree_digest(event_store.read_files(spark, str(root))).first()) == (h.hexdigest(), 5)
    digest = {n: hashlib.sha256(c).hexdigest() for n, c in files.items()}
    lines = ["ANALYSIS FREEZE", "", f"{digest['a/x.txt'].upper()}  a/x.txt", f"{digest['b.txt']}  a.txt", f"{digest['b.txt']}  x.txt", f"{digest['b.txt']}  b.txt"]
    found = lambda ls: {r["name"]: r["problem"] for r in event_store.manifest_problems(spark, listed(ls), event_store.file_digests(spark, str(root))).collect()}

    def listed(ls):
        (tmp_path / "m.txt").write_text("\n".join(ls))
        return str(tmp_path / "m.txt")

    assert found(lines) == {"a.txt": "changed", "x.txt": "missing", "a/y/x.txt": "unlisted", "c/big.bin": "unlisted"}
    for bad, said in (([*lines, "abc  b.txt"], "malformed"), (lines[:2], "no entries")):
        with pytest.raises(Exception, match=said):
            found(bad)


def test_finish_audit_of_amendments(spark):
    turns = spark.createDataFrame([("r", i, f) for i, f in enumerate([None, " ", "Stop", "LENGTH ", "tool", "tool"])], "run_id string, turn_number int, finish_reason string")
    given_ = spark.createDataFrame([("r", 0, "a0", []), ("r", 4, "a4", ["provider"]), ("gone", 1, "a9", [])], "run_id string, turn_number int, amendment_id string, failed array<string>")
    assert telemetry.finish_audit(turns, given_).first().asDict() == {"unreported": 2, "reported_stop": 1, "reported_length": 1, "reported_other": 2, "approved_anomaly_count": 1, "unapproved_anomaly_count": 3, "invalid_amendments": 1}
    with pytest.raises(Exception, match="two amendments"):
        telemetry.finish_audit(turns, given_.unionByName(given_)).collect()


def test_budget_of_no_response(spark):
    kinds = ", ".join([f"{c} string" for c in ("pilot_version", *telemetry.BUDGET_KEYS)] + [f"{c} double" for c in telemetry.BUDGET_MEDIANS] + ["http_status int"])
    none = spark.createDataFrame([], kinds)
    assert telemetry.budget_conclusion(telemetry.generation_budget_audit(none)).first().asDict() == {"configurations": 0, "reasoning_contribution": "INCONCLUSIVE"}
    one = spark.createDataFrame([(None,) * 11 + (1.0,) * 10 + (None,)], kinds)
    row = telemetry.generation_budget_audit(one).first()
    assert (row["reasoning_control_requested"], row["http_statuses"], row["median_latency_ms"]) == ("NONE_LEGACY", {}, 1.0)
    assert telemetry.budget_conclusion(telemetry.generation_budget_audit(one)).first()["reasoning_contribution"] == "REQUIRES_REVIEW"


# --- stores ----------------------------------------------------------------------------------------------------------


def test_two_writers_and_a_dead_one(spark, tmp_path):
    path = str(tmp_path / "store")
    with event_store.append_lock(spark, path) as held:
        held()
        with pytest.raises(RuntimeError, match="being written"), event_store.append_lock(spark, path):
            pass
        with pytest.raises(RuntimeError, match="being written"):
            event_store.write_once(spark.range(2), path)
        with event_store.append_lock(spark, path, lease=-1.0) as other:  # the first one counts as dead
            other()
            with pytest.raises(RuntimeError, match="taken over"):
                held()
    assert not (tmp_path / "store.lock").exists()
    event_store.write_once(spark.range(2), path)
    assert spark.read.json(path).count() == 2


def test_error_numbers_fill_gaps(spark):
    kinds = "run_id string, turn_number int, event_id string, occurred_at int"
    incoming = spark.createDataFrame([("r", 1, "a", 1), ("r", 1, "b", 2), ("r", 1, "c", 3), ("r", 2, "d", 1)], kinds)
    stored = spark.createDataFrame([("r", 1, 2), ("r", 1, 3), ("r", 1, 5)], "run_id string, turn_number int, sequence int")
    assert {r["event_id"]: r["sequence"] for r in event_store.numbered_errors(stored, incoming).collect()} == {"a": 1, "b": 4, "c": 6, "d": 1}
    headers = spark.createDataFrame([("r",)], "run_id string")
    assert event_store.with_headers(incoming, headers).count() == 4
    with pytest.raises(Exception, match="no header for run q"):
        event_store.with_headers(incoming.withColumn("run_id", F.lit("q")), headers).collect()
