"""The library's operators on hand-computed rows and on edge cases."""

import hashlib
import hmac
import base64
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions import hashing, ratings, taxonomy, text
from cohortflow.operators import agreement, baseline, design, events, inference, integrity, matched, telemetry, trajectory
from cohortflow.sources import event_store
from cohortflow.streaming import event_log


def one(frame):
    return frame.collect()[0]


def turns(spark, rows, schema="run_id string, turn_number string, A1 string, A2 string, A3 string"):
    return spark.createDataFrame(rows, schema)


def test_complete_run(spark):
    a1, a2, a3 = [0, 1, 2, 2, 1, 0], [0, 0, 1, 2, 1, 0], [0, 0, 0, 1, 1, 1]
    r = one(trajectory.summarize_conversations(turns(spark, [("r", str(t + 1), str(a1[t]), str(a2[t]), str(a3[t])) for t in range(6)])))
    assert (r["first_A1_2_turn"], r["first_A3_safety_turn"], r["first_recovery_turn"]) == (3, 4, 5)
    assert r["persistence_after_onset_rate"] == pytest.approx(1 / 3) and r["recovery_after_high_risk_turn"] and r["persistent_after_onset"] is False
    assert r["is_complete"] and r["completeness_rate"] == 1.0 and (r["mean_A1"], r["max_A1"], r["final_A1"]) == (1.0, 2.0, 0.0)


def test_partial_and_invalid(spark):
    f = spark.createDataFrame([("r", "1", None, None), ("r", "2", "2", "1"), ("r", "3", "99", "0"), ("r", "4", "1", None), ("r", "x", "1", "1"), (None, "1", "2", "2")], "run_id string, turn_number string, A1 string, A3 string")
    r = one(trajectory.summarize_conversations(f))
    assert (r["observed_A1"], r["observed_A2"], r["observed_A3"], r["missing_score_cells"]) == (2, 0, 2, 14)
    assert r["completeness_rate"] == pytest.approx(4 / 18) and r["post_onset_missing_turns"] == 3 and r["final_A1"] is None


def test_na_conflicts_and_onset_at_the_end(spark):
    na = one(trajectory.summarize_conversations(turns(spark, [("r", str(t), "0", "N/A" if t == 1 else "0", " n/a " if t == 2 else "1") for t in range(1, 7)])))
    assert na["is_complete"] and na["observed_A2"] == 6 and na["mean_A3"] == 1.0
    c = one(trajectory.summarize_conversations(turns(spark, [("r", "1", "0", "1", "0"), ("r", "1", "2", "1", "0")])))
    assert (c["duplicate_turn_rows"], c["observed_A1"], c["observed_A2"]) == (1, 0, 1) and c["any_A1_2"] is None
    e = one(trajectory.summarize_conversations(turns(spark, [("r", "6", "2", "0", "0")])))
    assert e["any_A1_2"] and e["persistence_after_onset_rate"] is None and e["recovery_after_high_risk_turn"] is None and e["post_onset_observed_turns"] == 0
    mixed = one(trajectory.summarize_conversations(turns(spark, [("r", "1", "0", "N/A", "0"), ("r", "1", "0", "1", "0")])))
    assert mixed["mean_A2"] == 1.0 and mixed["observed_A2"] == 0


def test_empty_inputs_keep_their_schema(spark):
    t = turns(spark, [("r", "1", "0", "0", "0")])
    assert trajectory.summarize_conversations(t.limit(0)).columns == trajectory.summarize_conversations(t).columns
    assert trajectory.summarize_conversations(t.limit(0)).count() == 0
    with pytest.raises(ValueError):
        trajectory.summarize_conversations(t, safety_threshold=2)


def test_matched_pairs(spark):
    rows = [(f"s{i // 2}", i % 2, c, float(v)) for i, (x, y) in enumerate([(0, 1), (0, 2), (1, 2), (0, 2)]) for c, v in (("a", x), ("b", y))] + [("s9", 0, "a", 5.0), ("s9", 1, "b", None)]
    f = spark.createDataFrame(rows, "script_id string, repetition int, context_condition string, mean_A1 double")
    p = matched.matched_pair_differences(f, "mean_A1", "context_condition", "a", "b")
    assert p.count() == 5 and p.where("difference IS NOT NULL").agg(F.avg("difference")).first()[0] == 1.5
    c = one(matched.matched_comparisons(f, ("mean_A1",), {"context_condition": ("script_id", "repetition")}))
    assert (c["n_pairs"], c["mean_difference"], c["n_unmatched_a"], c["n_unmatched_b"]) == (4, 1.5, 1, 0)


def brute_signed_rank(d):
    nz = sorted(abs(x) for x in d if x)
    rank = {a: (2 * nz.index(a) + 1 + nz.count(a)) / 2 for a in nz}
    return sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0), sum(nz.count(a) ** 3 - nz.count(a) for a in set(nz))


def test_signed_ranks(spark):
    samples = {"ties": [1, -1, 2, 2, 0, 3, -0.5], "zero": [0, 0], "exact": [1, 2, 3, -4, 5], "pos": [0.1 + 0.2, 0.3, -0.3]}
    f = spark.createDataFrame([(k, float(x)) for k, v in samples.items() for x in v], "k string, difference double")
    got = {r["k"]: r for r in inference.signed_rank_test(f, ("k",)).collect()}
    for k, v in samples.items():
        w = brute_signed_rank([round(x, 9) for x in v])
        assert (got[k]["w_plus"], got[k]["w_minus"], got[k]["tie_sum"]) == w
    assert got["zero"]["p_value"] == 1.0 and got["zero"]["rank_biserial"] == 0.0
    assert got["exact"]["method"] == "exact" and got["exact"]["p_value"] == pytest.approx(14 / 32)


@pytest.mark.parametrize(("n", "w", "ties", "multiplier", "want"), [(20, 29.5, 366, 8, 0.036808), (16, 15.5, 90, 6, 0.038987), (14, 2.0, 30, 9, 0.013526), (11, 2.0, 120, 7, 0.037599), (17, 11.0, 1056, 6, 0.0088358)])
def test_published_p_values(n, w, ties, multiplier, want):
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert multiplier * math.erfc(abs(z) / math.sqrt(2)) == pytest.approx(want, rel=2e-4)


def test_holm_ignores_missing(spark):
    f = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", None), ("f", "e", float("nan"))], "family string, t string, p_value double")
    got = {r["t"]: (r["p_holm"], r["significant_0_05"]) for r in inference.holm(f, ("family",), order=("t",)).collect()}
    assert got["a"] == (pytest.approx(0.03), True) and got["c"][0] == pytest.approx(0.06) and got["b"][0] == pytest.approx(0.06) and got["d"] == got["e"] == (None, False)


def test_bootstraps(spark):
    f = spark.createDataFrame([(i, f"s{i // 2}", float(v)) for i, v in enumerate([0, 1, 3, 4])], "run_id int, script_id string, mean_A1 double")
    stat = lambda pdf: pdf["mean_A1"].mean()
    a = one(inference.unit_bootstrap(f, stat, resamples=200, seed=3))
    b = one(inference.unit_bootstrap(f, stat, resamples=200, seed=3))
    c = one(inference.unit_bootstrap(f, stat, cluster="script_id", resamples=200, seed=3))
    assert a == b and a["estimate"] == 2.0 and a["ci_low"] <= 2 <= a["ci_high"] and c["n_units"] == 2
    with pytest.raises(ValueError):
        inference.unit_bootstrap(f.unionByName(f), stat)
    s = one(inference.seeded_bootstrap(f.withColumn("g", F.lit(1)), ("g",), "mean_A1", ("run_id",), resamples=500, seed=9))
    import numpy as np

    x = np.array([0.0, 1, 3, 4])
    q = np.quantile(np.random.default_rng(9).choice(x, (500, 4), replace=True).mean(axis=1), [0.025, 0.975])
    assert (s["ci_low"], s["ci_high"]) == (pytest.approx(q[0]), pytest.approx(q[1]))


def test_kappa(spark):
    def table(pairs, axis="A1"):
        rows = [(str(i), s, axis, v) for i, p in enumerate(pairs) for s, v in zip(("x", "y"), p, strict=True)]
        return one(agreement.agreement_table(spark.createDataFrame(rows, "item_id string, source string, axis string, rating string"), ("x", "y")))

    r = table([("0", "0"), ("1", "2"), ("2", "2"), ("1", "1"), ("N/A", "1"), (None, "1")])
    p, q, far = [1 / 4, 2 / 4, 1 / 4], [1 / 4, 1 / 4, 2 / 4], 1 / 8
    e = sum(abs(i - j) / 2 * p[i] * q[j] for i in range(3) for j in range(3))
    assert r["cohen_kappa"] == pytest.approx(1 - far / e) and (r["n_numeric_pairs"], r["n_all_ratings"]) == (4, 5)
    assert table([("1", "1"), ("1", "1")])["cohen_kappa"] is None and table([("1", "1")])["cohen_kappa"] is None
    assert table([("0", "0"), ("1", "1"), ("0", "1"), ("1", "1")], "A3")["cohen_kappa"] == pytest.approx(0.5)


def test_ratings(spark):
    f = spark.createDataFrame([("2.0",), (" n/a ",), ("99",), (None,), ("x",), ("1",)], "r string")
    got = [tuple(r) for r in f.select(ratings.rating(F.col("r"), "A2"), ratings.score(F.col("r"), "A2"), ratings.rating(F.col("r"), "A1"), ratings.lenient_rating(F.col("r")), ratings.canonical_rating(F.col("r"))).collect()]
    assert got == [("2", 2, "2", None, "2"), ("N/A", None, None, "N/A", "N/A"), (None, None, None, "99", "99"), (None, None, None, None, "N/A"), (None, None, None, None, "x"), ("1", 1, "1", "1", "1")]


def test_lexical_features(spark):
    t = "I definitely think it must be true. You should ask! Avoid it? Maybe I'm wrong…\nI’m done"
    r = one(text.lexical_features(spark.createDataFrame([(t,), (None,)], "t string").where("t IS NOT NULL"), "t"))
    assert (r["certainty_count"], r["action_advice_count"], r["discouragement_refusal_count"], r["sentence_count"], r["question_count"]) == (2, 3, 1, 5, 1)
    assert (r["first_person_count"], r["second_person_count"]) == (2, 1)
    e = one(text.lexical_features(spark.createDataFrame([(None,)], "t string"), "t"))
    assert e["word_count"] == 0 and e["certainty_density"] == 0.0 and e["lexical_diversity"] == 0.0


def test_similarity(spark):
    f = spark.createDataFrame([("c", 1, "same words", "same words"), ("c", 2, "", "other text"), ("d", 1, "a b", "same words")], "conversation_id string, turn_number int, user_message string, response_text string")
    got = {(r[0], r[1]): r for r in text.similarity_features(f).collect()}
    assert got["c", 1]["response_user_similarity"] == pytest.approx(1.0) and got["c", 2]["response_user_similarity"] == 0.0
    assert got["c", 1]["response_drift"] is None and got["c", 2]["response_drift"] == 1.0 and got["d", 1]["turn_similarity"] is None


def test_tokens_are_hmacs(spark):
    f = spark.createDataFrame([("run_1", 3, "h"), ("ü", 1, "")], "a string, b int, c string")
    for key in (b"k", b"x" * 80):
        for r in f.select("a", "b", "c", hashing.opaque_token(key, "p", [F.col("a"), F.col("b"), F.col("c")]).alias("t")).collect():
            want = base64.b32encode(hmac.new(key, "\x1f".join(("p", r["a"], str(r["b"]), r["c"])).encode(), hashlib.sha256).digest()).decode().lower()[:20]
            assert r["t"] == want


def test_error_taxonomy(spark):
    rows = [("http_429", None), ("http_404", None), ("upstream_http_402", None), ("provider_body_error", "503"), ("provider_body_error", "x"), ("ReadTimeout", None), ("duplicate_success", None), (None, None)]
    got = [tuple(r) for r in taxonomy.classify_errors(spark.createDataFrame(rows, "error_type string, up string"), upstream="up").select("category", "retryable", "reason_code").collect()]
    assert got == [("outer_http_transient", True, "http_429"), ("permanent", False, "http_404"), ("operator_recoverable", False, "upstream_http_402"), ("upstream_transient", True, "upstream_http_503"), ("permanent", False, "provider_body_error"), ("transport_transient", True, "ReadTimeout"), ("scientific_hard_stop", False, "duplicate_success"), ("permanent", False, "unknown_error")]


def test_event_store(spark, tmp_path):
    root = tmp_path / "raw"
    for run, n in (("run_a", 2), ("run_b", 0)):
        (root / run).mkdir(parents=True)
        (root / run / "run.json").write_text(json.dumps({"run_id": run, "script_id": "s", "created_at": "2026-09-01T00:00:00Z"}))
        for t in range(1, n + 1):
            (root / run / f"turn-{t:02d}-success.json").write_text(json.dumps({"event_id": f"{run}{t}", "run_id": run, "turn_number": t, "user_message": "u", "result": {"text": "x" * t, "truncated": False}}))
    heads, ts = event_store.read_headers(spark, str(root)), event_store.read_turns(spark, str(root))
    assert heads.count() == 2 and ts.count() == 2 and events.gaps(ts).count() == 0
    full = event_store.assemble(heads, ts)
    assert {r["run_id"]: len(r["turns"] or []) for r in full.collect()} == {"run_a": 2, "run_b": 0}
    assert event_store.flatten_turns(full.where("turns IS NOT NULL")).count() == 2
    (root / "run_b" / "turn-01-success.json").write_text("{broken")
    loose = event_store.read_json_files(spark, f"{root}/*/turn-*-success.json", event_store.TURN, strict=False).cache()
    assert loose.where("_broken IS NOT NULL").count() == 1 and loose.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        event_store.read_turns(spark, str(root)).collect()


def test_logs_and_sinks(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"annotation_id": "1", "item_id": "i", "annotator_id": "a", "saved_at": "2026-09-01T00:00:00Z"}\n\n{"annotation_id": "2", "item_id": "i", "annotator_id": "a", "saved_at": "2026-09-01T00:00:00Z"}\n')
    rows = event_store.read_log(spark, str(log))
    assert [r["log_index"] for r in rows.orderBy("log_index").collect()] == [1, 2]
    assert one(events.latest_revisions(rows))["annotation_id"] == "2"
    log.write_text('{"annotation_id": "1"}\nnot json\n')
    with pytest.raises(Exception, match="malformed line 2"):
        event_store.read_log(spark, str(log)).collect()
    out = str(tmp_path / "out")
    event_store.write_once(spark.range(3), out)
    with pytest.raises(Exception):  # noqa: B017
        event_store.write_once(spark.range(3), out)
    ev = spark.createDataFrame([("e1", "r"), ("e2", "r"), ("e2", "r")], "event_id string, run_id string")
    store = str(tmp_path / "events")
    assert event_store.append_events(ev, store) == 2 and event_store.append_events(ev, store) == 0
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "f.txt").write_bytes(b"a\r\nb")
    d = one(event_store.file_digests(spark, str(tmp_path / "texts"), portable=True))
    assert d["sha256"] == hashlib.sha256(b"a\nb").hexdigest()
    assert one(spark.range(1).select(event_store.safe_name(F.lit("../a b/ü.txt")).alias("n")))["n"] == "a-b-.txt"


def test_blinding_and_sampling(spark):
    t = spark.createDataFrame([("r1", i, f"text {i}", False, "length" if i == 4 else "stop") for i in range(1, 7)], "run_id string, turn_number int, response_text string, truncated boolean, finish_reason string")
    s = events.scorability(t)
    assert [r["reason"][:5] for r in s.orderBy("turn_number").collect()] == ["compl"] * 3 + ["trunc", "downs", "downs"]
    items, item_map = events.blinded_items(s, b"key")
    assert set(items.columns).isdisjoint({"run_id"}) and items.count() == item_map.count() == 3
    again, again_map = events.rerating_sample(items, item_map, b"key", "seed", 0.5)
    assert again.count() == 2 and again.join(items, "item_id").count() == 0 and again_map.join(again, "item_id").count() == 2


def test_designs(spark):
    p = design.factorial(spark, {"a": ["x", "y"], "r": [1, 2]})
    p = design.execution_order(p.withColumn("run_id", design.run_key("v", ["a", "r"])), "run_id", 1)
    assert {r["violations"] for r in design.balance(p, ["a", "r"], {"a": 2, "r": 2}).collect()} == {0}
    broken = {r["rule"]: r["violations"] for r in design.balance(p.where("execution_order > 1").unionByName(p.where("execution_order = 4")), ["a", "r"], {"a": 2, "r": 2}).collect()}
    assert broken["missing_cells"] == 1 and broken["repeated_cells"] == 1 and broken["repeated_keys"] == 1 and broken["order_gaps"] > 0
    h = design.message_history(spark.createDataFrame([("r", 1, "u1", "a1"), ("r", 2, "u2", "a2")], "run_id string, turn_number int, user_message string, response_text string"))
    assert [m["content"] for m in h.where("turn_number = 2").first()["request_messages"]] == ["u1", "a1", "u2"]
    assert design.turn_grid(spark.range(1), F.lit(0)).count() == 0


def test_verdicts(spark):
    v = lambda *s: one(telemetry.criteria_verdict(spark.createDataFrame([(str(i), x) for i, x in enumerate(s)], "name string, status string")))["verdict"]
    assert [v("PASS", "PASS"), v("PASS", "FAIL"), v("PASS", "NOT_RUN"), v("NOT_RUN", "NOT_RUN")] == ["PASS", "FAIL", "INCOMPLETE", "NOT_RUN"]
    c = spark.createDataFrame([(2, "b", False), (1, "a", None), (3, "b", False), (4, "c", True)], "position int, name string, met boolean")
    assert one(integrity.blockers(c))["blockers"] == ["a", "b"]


def test_baseline_guards(spark):
    rows = spark.createDataFrame([(f"c{t}{i}", f"t{t}", i % 2, f"word{i % 2} common {t}") for t in range(3) for i in range(4) for _ in range(2)], "conversation_id string, theme string, label int, text string")
    m = baseline.evaluate(rows, features=64, max_iter=5)[0]
    assert m.count() == 3 and m.agg(F.min("balanced_accuracy")).first()[0] == 1.0
    with pytest.raises(ValueError):
        baseline.evaluate(rows.where("label = 1"))
    folds = baseline.group_folds(rows)
    for k in ("0", "1", "2"):
        assert baseline.leaking(folds.where(F.col("fold") != k), folds.where(F.col("fold") == k)).count() == 0


def test_baseline_has_every_term_and_summary(spark):
    texts = [f"w{i} " * (1 + i % 3) + f"same word{i % 2}" for i in range(24)]
    rows = spark.createDataFrame([(f"c{i}", f"t{i // 8}", i % 2, t) for i, t in enumerate(texts)] + [("c0", "t0", 0, texts[0])], "conversation_id string, theme string, label int, text string")
    m, models, words = baseline.evaluate(rows)
    grams = lambda t: t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:])]
    train = [texts[0], *texts[:16]]
    df = {g: sum(g in grams(t) for t in train) for t in train for g in grams(t)}
    place = {r["term"]: (r["bucket"], r["idf"]) for r in words["t2"].collect()}
    assert {t: v[1] for t, v in place.items()} == pytest.approx({g: math.log((1 + 17) / (1 + n)) + 1 for g, n in df.items()})
    assert sorted(v[0] for v in place.values()) == list(range(len(df))) and models["t2"].stages[-1].numFeatures == len(df)
    data = spark.createDataFrame([("r", "t0", 1, texts[2] + " unknown")], "row string, fold string, copies long, text string")
    x = {e["bucket"]: e["w"] for e in one(baseline.vectors(baseline.term_counts(data), words["t2"]))["x"]}
    raw = {place[g][0]: (1 + math.log(grams(texts[2]).count(g))) * place[g][1] for g in grams(texts[2])}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert x == pytest.approx({b: v / norm for b, v in raw.items()})
    got = m.collect()
    assert {r["fold"]: r["n"] for r in got} == {"t0": 9, "t1": 8, "t2": 8}
    s, f1 = one(baseline.fold_summary(m)), [r["macro_f1"] for r in got]
    assert s["macro_f1_mean"] == pytest.approx(sum(f1) / 3) and s["macro_f1_std"] == pytest.approx(math.sqrt(sum((v - sum(f1) / 3) ** 2 for v in f1) / 3))


def test_counted_bootstrap(spark):
    f = spark.createDataFrame([("a", float(i % 3)) for i in range(300)] + [("b", 1.0)] * 5 + [("b", None)], "g string, v double")
    got = {r["g"]: r for r in inference.counted_bootstrap(f, ("g",), "v", seed=7).collect()}
    again = {r["g"]: r for r in inference.counted_bootstrap(f.repartition(3), ("g",), "v", seed=7).collect()}
    rows = {r["g"]: r for r in inference.seeded_bootstrap(f, ("g",), "v", ("v",), seed=1).collect()}
    assert got == again and all(r["resamples"] == 10_000 for r in got.values())
    assert (got["a"]["n"], got["b"]["n"], got["b"]["ci_low"], got["b"]["ci_high"]) == (300, 5, 1.0, 1.0)
    assert all(got["a"][c] == pytest.approx(rows["a"][c], abs=0.01) for c in ("estimate", "ci_low", "ci_high"))


def test_numbers_in_order(spark):
    ids = spark.createDataFrame([(f"r{i:04d}",) for i in range(1000)], "run_id string").repartition(7)
    got = telemetry.in_order(ids, "run_id", "n")
    assert all(r["n"] == int(r["run_id"][1:]) + 1 for r in got.collect())


def test_projection_of_all_terms(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(60)) for _ in range(40)]
    got = {r["k"]: (abs(r["component_1"]), abs(r["component_2"])) for r in text.projection(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()}
    grams = [t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:])] for t in texts]
    words = sorted({g for d in grams for g in d})
    tf = np.array([[d.count(g) for g in words] for d in grams], float)
    x = tf * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))) + 1)
    u, s, _ = np.linalg.svd(x / np.linalg.norm(x, axis=1, keepdims=True), full_matrices=False)
    assert len(words) > 1024 and len(got) == 40
    assert np.allclose([got[k] for k in range(40)], np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_stream_deduplicates(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "2026-01-01 00:00:00", "u", "error"), (1, "2026-01-01 00:00:00", "u", "error"), (2, "2026-01-01 00:10:00", "u", "view")], "event_id long, ts string, user_id string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = event_log.deduplicated(event_log.read_events(spark, src, "event_id long, ts timestamp, user_id string, event_type string"))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def test_lexicon_file(spark, tmp_path):
    path = tmp_path / "lexicon.json"
    path.write_text(json.dumps({"version": "2", "categories": {" advice ": [" Try ", "try", "You Should"]}}))
    assert event_store.read_lexicon(spark, str(path)) == {"advice": ("try", "you should")}
    row = text.lexical_features(spark.createDataFrame([("you should try",)], "t string"), "t", event_store.read_lexicon(spark, str(path))).first()
    assert row["advice_count"] == 2
    for bad in ({"version": "2"}, {"version": "2", "categories": {"a": ["?!"]}}, {"version": "2", "categories": {"a": []}}, {"version": "2", "categories": {" ": ["a"]}}, ["a"]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            event_store.read_lexicon(spark, str(path))


def test_yaml_lexicon(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "lexicon.yaml"
    path.write_text("version: '1'\ncategories:\n  advice:\n    - Try\n    - try\n")
    assert event_store.read_lexicon(spark, str(path)) == {"advice": ("try",)}


def test_append_takes_one_writer_and_no_repeated_ids(spark, tmp_path):
    path = str(tmp_path / "store")
    e = spark.createDataFrame([(1, "r"), (2, "r")], "event_id long, run_id string")
    with event_store.append_lock(spark, path), pytest.raises(RuntimeError):
        event_store.append_events(e, path)
    assert event_store.append_events(e, path, reject=True) == 2
    with pytest.raises(ValueError):
        event_store.append_events(e, path, reject=True)
    assert event_store.append_events(e, path) == 0 and spark.read.parquet(path).count() == 2


def test_folds_balance_classes(spark):
    rows = spark.createDataFrame([(f"c{c}", str(c % 2), t) for c in range(40) for t in range(1 + c % 7)], "conversation_id string, label string, t int")
    for label in "01":
        n = sorted(r["count"] for r in baseline.group_folds(rows).where(f"label = '{label}'").groupBy("fold").count().collect())
        assert len(n) == 3 and n[-1] - n[0] <= 7
