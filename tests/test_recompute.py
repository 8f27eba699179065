"""Recomputed catalogues, selections, bundles and artifacts: broken one by one, and the edge cases."""

import hashlib
import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortflow.operators import recompute
from cohortflow.plans import recompute_queries
from oracle import compare

SF = "/root/testdata/sf0.001"
AT = "2026-09-01 00:00:00"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(recompute_queries.QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(spark, recompute_queries.QUERIES[name], recompute_queries.ORACLES[name], SF) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["catalogue_recomputation", "selection_recomputation"])
def test_catalogues_that_lose_every_entry(spark, tmp_path, name):
    for t in set(os.listdir(SF)) - {"orders.parquet"}:
        os.symlink(f"{SF}/{t}", tmp_path / t)
    # Customers 1 and 2 have no entry today, 17 neither (cut off), 19 neither (lost), 3 none when it was frozen, 4 never any.
    rows = [(29, 1), (58, 2), (87, 2), (116, 17), (145, 19), (31, 3), (899, 4), (174, 5), (1, 5), (2, 17 * 2), (3, 19 * 2)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    os.rename(tmp_path / "orders.parquet", tmp_path / "written")
    os.symlink(next((tmp_path / "written").glob("*.parquet")), tmp_path / "orders.parquet")
    assert compare(spark, recompute_queries.QUERIES[name], recompute_queries.ORACLES[name], str(tmp_path)) is None


def entry(name, **changed):
    base = {"id": f"maker/{name}:free", "name": name, "context_length": 65536, "pricing": {"prompt": "0", "completion": 0}, "architecture": {"input_modalities": ["text", "image"], "output_modalities": ["text"]}, "supported_parameters": ["seed", "max_tokens"], "top_provider": {"max_completion_tokens": 8192}, "status": None, "unknown": {"field": [1]}}
    return base | changed


def snapshots(spark, **bodies):
    rows = [(k, AT, b if isinstance(b, str) or b is None else json.dumps(b)) for k, b in bodies.items()]
    return spark.createDataFrame(rows, "snapshot_id string, at string, body string").select("snapshot_id", F.to_timestamp("at").alias("retrieved_at"), "body", F.lit(1).alias("position"))


def stale(spark, old, new):
    frozen = recompute.evaluated(snapshots(spark, **old), ("nurse",))
    found = recompute.stale_catalogue(frozen, snapshots(spark, **new), ("nurse",)).collect()
    return sorted((r["snapshot_id"], r["id"] and r["id"].split("/")[1].split(":")[0], r["problem"], ",".join(r["fields"])) for r in found)


def test_candidates_are_ordered_by_warning_and_name(spark):
    found = recompute.evaluated(snapshots(spark, a=[entry("B"), entry("a", description="A NURSE helps"), entry("c"), entry("d", pricing={"prompt": "0.1", "completion": "0"}), entry("Nursery")]), ("nurse",))
    assert [r["id"] for r in found.where("position > 0").orderBy("position").collect()] == ["maker/B:free", "maker/c:free", "maker/Nursery:free", "maker/a:free"]
    assert found.where("id LIKE '%/d:%'").first()["rejection_reasons"] == ["nonzero_prompt_or_completion_price"]


def test_each_fault_of_a_catalogue_shows(spark):
    three = [entry("a"), entry("b"), entry("c")]
    assert stale(spark, {"s": three}, {"s": three[::-1]}) == []  # the order of a raw catalogue says nothing
    assert stale(spark, {"s": three}, {"s": [entry("a"), entry("b"), entry("c", pricing={"prompt": "0.1", "completion": "0"})]}) == [("s", "c", "changed", "prompt_price,rejection_reasons,eligible,position")]
    assert stale(spark, {"s": three}, {"s": [entry("a"), entry("b", description="nurse"), entry("c")]}) == [("s", "b", "changed", "warned,position"), ("s", "c", "changed", "position")]
    assert stale(spark, {"s": three}, {"s": three[1:]}) == [("s", "a", "unexpected", ""), ("s", "b", "changed", "position"), ("s", "c", "changed", "position")]
    assert stale(spark, {"s": three[:2]}, {"s": three}) == [("s", "c", "missing", "")]
    assert stale(spark, {"s": three}, {"s": [*three[:2], entry("c", top_provider=None)]}) == [("s", "c", "changed", "completion_limits,rejection_reasons,eligible,maximum_completion_capability,position")]


def test_lost_and_broken_evidence(spark):
    one = [entry("a")]
    assert stale(spark, {"s": one, "t": one, "u": one}, {"s": one, "t": "[{"}) == [("t", None, "evidence_malformed", ""), ("u", None, "evidence_missing", "")]
    assert stale(spark, {"s": []}, {"s": []}) == []
    assert stale(spark, {"s": []}, {"s": None}) == [("s", None, "evidence_malformed", "")]
    assert stale(spark, {}, {}) == []


def test_repeated_rows_count(spark):
    f = lambda *rows: spark.createDataFrame(rows, "k int, x int, y string")
    diff = lambda a, b: sorted(tuple(r) for r in recompute.changes(a, b, ["k"], ["x", "y"]).collect())
    assert diff(f((1, 1, "a"), (1, 1, "a")), f((1, 1, "a"))) == [(1, 1, 0, "unexpected", [])]
    assert diff(f((1, None, None)), f((1, None, None))) == []
    assert diff(f((1, None, "a")), f((1, 2, "a"))) == [(1, 1, 1, "changed", ["x"])]
    crossed = f((1, 1, "a"), (1, 2, "b")), f((1, 1, "b"), (1, 2, "a"))
    assert diff(*crossed) == [(1, 2, 2, "changed", ["combination"])]


@pytest.mark.parametrize("seed", range(3))
def test_decisions_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, verdicts, want = [], [], {}
    for s in range(30):
        names = [f"m{i}" for i in range(rng.randrange(0, 6))]
        rows += [(s, n, i + 1, "max_tokens") for i, n in enumerate(names)] + [(s, "out", None, None)]
        status, blocker, model = ("EXHAUSTED" if names else "NO_CANDIDATE"), None, None
        open_ = True
        for n in names:
            v = rng.choice(["PASS", "FAIL", "FAIL", "INCOMPLETE", None])
            if v:
                verdicts.append((s, n, v))
            if open_ and v != "FAIL":
                open_ = False
                status, blocker, model = ("SELECTABLE", None, n) if v == "PASS" else ("BLOCKED", f"earlier_candidate_{(v or 'NOT_RUN').lower()}", None)
        verdicts.append((s, "out", "PASS"))
        want[s] = (status, blocker, model, names, hashlib.sha256(json.dumps(names, separators=(",", ":")).encode()).hexdigest())
    candidates = spark.createDataFrame(rows, "snapshot_id int, id string, position int, completion_limit_parameter string")
    found = recompute.decisions(candidates, spark.createDataFrame(verdicts, "snapshot_id int, id string, verdict string"))
    assert {r["snapshot_id"]: (r["status"], r["blocker"], r["selected_model_id"], r["candidate_ordering"], r["candidate_ordering_hash"]) for r in found.collect()} == want


def test_selection_problems(spark):
    candidates = spark.createDataFrame([(1, "a", 1, "max_tokens"), (1, "b", 2, "max_tokens"), (2, "a", 1, "max_tokens")], "snapshot_id int, id string, position int, completion_limit_parameter string")
    decided = recompute.decisions(candidates, spark.createDataFrame([(1, "a", "PASS"), (2, "a", "FAIL")], "snapshot_id int, id string, verdict string"))
    good = decided.where("snapshot_id = 1").first()["candidate_ordering_hash"]
    records = spark.createDataFrame([(1, 1, "a", "max_tokens", good), (2, 1, "b", "max_tokens", "old"), (3, 2, "a", "max_tokens", None), (4, 9, "a", None, None), (5, None, None, None, None)], "n int, snapshot_id int, selected_model_id string, completion_limit_parameter string, candidate_ordering_hash string")
    assert {r["n"]: r["problems"] for r in recompute.selection_problems(records, decided).collect()} == {1: [], 2: ["selected_model_id", "candidate_ordering_hash"], 3: ["not_selectable", "selected_model_id", "completion_limit_parameter", "candidate_ordering_hash"], 4: ["evidence_missing"], 5: ["evidence_missing"]}


def test_bundles(spark):
    items = [("b", "f1", "repo", "x", "1"), ("b", "f2", "repo", "gone", "1"), ("b", "f3", "repo", "y", "1"), ("b", "f4", "elsewhere", "x", "1"), ("b", "f5", "repo", "x", "1"), ("b", "f5", "repo", "x", "1"), ("b", "f6", "repo", "x", None), ("c", "f1", "repo", "x", "1"), ("b", "f7", None, None, "1")]
    members = [("b", f, "1") for f in ("f1", "f2", "f3", "f4", "f5", "f6", "f7", "g")] + [("c", "f1", "2")]
    sources = [("repo", "x", "1"), ("repo", "y", "2")]
    found = lambda i, m, s: sorted(tuple(r) for r in recompute.bundle_problems(spark.createDataFrame(i, "bundle_id string, bundle_path string, source_scope string, source_path string, sha256 string"), spark.createDataFrame(m, "bundle_id string, bundle_path string, sha256 string"), spark.createDataFrame(s, "source_scope string, source_path string, sha256 string"), ("repo",)).collect())
    assert found(items, members, sources) == [("b", "f2", "source_missing"), ("b", "f3", "source_mismatch"), ("b", "f4", "unknown_scope"), ("b", "f5", "listed_twice"), ("b", "f6", "bundle_mismatch"), ("b", "f6", "source_mismatch"), ("b", "f7", "unknown_scope"), ("b", "g", "unlisted"), ("c", "f1", "bundle_mismatch")]
    assert found(items[:1], [], []) == [("b", "f1", "not_in_bundle"), ("b", "f1", "source_missing")]
    assert found([], [], []) == []


def test_stale_artifacts_equal_a_loop(spark):
    rng = random.Random(4)
    names = [f"a{i}" for i in range(60)]
    uses = [(n, rng.choice(names), "now" if rng.random() < 0.95 else "old") for n in names for _ in range(rng.randrange(3))] + [("a0", "lost", "now"), ("c1", "c2", "now"), ("c2", "c1", "now")]
    artifacts = [(n, "now") for n in [*names, "c1", "c2"]]
    far = {a: 0 for a, s, h in uses if h != "now" or s == "lost"}
    while True:
        more = {a: min(far[s] + 1, far.get(a, 1 << 20)) for a, s, _ in sorted(uses, key=lambda u: -far.get(u[1], 0)) if s in far}
        better = {a: d for a, d in more.items() if d < far.get(a, 1 << 20)}
        if not better:
            break
        far |= better
    schema = "artifact_id string, source_id string, source_sha256 string"
    found = recompute.stale_artifacts(spark.createDataFrame(artifacts, "artifact_id string, sha256 string"), spark.createDataFrame(uses, schema))
    assert {r["artifact_id"]: r["distance"] for r in found.collect()} == far
    assert recompute.stale_artifacts(spark.createDataFrame(artifacts, "artifact_id string, sha256 string"), spark.createDataFrame([], schema)).count() == 0


def test_status_guards_fail_closed(spark):
    rows = [("v", "FROZEN", "QUALIFIED", True), ("v", "OPEN", "OPEN", True), ("v", None, None, None), ("v", None, "QUALIFIED", False)]
    frame = spark.createDataFrame(rows, "version string, replacement_endpoint_status string, final_pair_status string, replacement_required boolean")
    whole = frame.select("*", *(F.lit("x").alias(c) for c in recompute.STATUS_FIELDS if c not in frame.columns))
    assert [(r["replacement_not_frozen"], r["pair_not_qualified"]) for r in recompute.status_guards(whole, "v").collect()] == [(False, False), (True, True), (True, True), (False, False)]
    with pytest.raises(ValueError, match="extra"):
        recompute.status_guards(whole.withColumn("extra", F.lit(1)), "v")
    with pytest.raises(PySparkException, match="expected w, got v"):
        recompute.status_guards(whole, "w").collect()
