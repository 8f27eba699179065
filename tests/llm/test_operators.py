"""Every operator over tables of edge cases: against SQL where there is some, else against a brute-force version."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from cohortflow.llm import ann, byte_bpe, chat_format, decontamination, entry, language_id, line_dedup, lm_scoring, near_dedup, toxicity
from cohortflow.llm._text import shared_folder
from oracle import rows
from pyspark.sql import functions as F


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = entry.QUERIES[name](spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.ORACLES[name])
    assert got == rows([d[0] for d in res.description], res.fetchall())
    return got


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_against_sql(spark, tiny, name):
    assert same_as_sql(spark, name, tiny)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert entry.QUERIES[name](spark, empty).count() == (1 if name == "op10_chat_format" else 0)


def texts(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_decontamination_in_blocks(spark, tiny):
    docs, bench = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    one = decontamination.decontaminate(docs, bench)
    many = decontamination.decontaminate(docs, bench, block_windows=2)
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(one) == key(many.select(*one.columns))


def test_line_dedup_hot_line_over_partitions(spark):
    docs = spark.createDataFrame([(i, "the very common line of all documents\nown line number %d of this one\n" % i) for i in range(400)], "doc_id long, text string")
    got = {r["doc_id"]: line_dedup.unpack(r["bitmap"], r["n_lines"]).tolist() for r in line_dedup.keep_bitmaps(docs).collect()}
    assert len(got) == 399 and 399 not in got and all(v == [False, True, True] for v in got.values())


def test_near_dedup_without_an_original(spark):
    """A chain whose ends aren't similar and a dense group of copies that all differ from each other."""
    w = [f"w{i}" for i in range(120)]
    chain = [" ".join(["c%d" % (i + 6 * s) for i in range(100)]) for s in range(12)]
    dense = [" ".join("q%d_%d" % (k, i) if i % 40 == k else x for i, x in enumerate(w)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(chain + dense)), "doc_id long, text string")

    def shingles(t):
        x = t.split()
        return {tuple(x[i : i + 2]) for i in range(len(x) - 1)}

    sets = [shingles(t) for t in chain + dense]
    root = list(range(len(sets)))
    for _ in sets:
        for i in range(len(sets)):
            for j in range(len(sets)):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert [got[i] for i in range(len(sets))] == root


def test_near_dedup_stage_keeps_one_of_each_group(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = near_dedup.stage(spark, docs, tiny)
    assert out.columns == docs.columns
    left = Counter(r["doc_id"] for r in out.collect())
    assert left[200] == 1 and not any(left[k] for k in (201, 205, 210, 211, 212)) and left[220] == left[221] == left[222] == 1 and left[None] == 1


@pytest.mark.parametrize("module", (toxicity, line_dedup, near_dedup, decontamination))
def test_stages_return_every_column(spark, tiny, module):
    """Columns named like the operators' own come out as they were."""
    taken = "ranges item_ids n_words n_hit bitmap row_hash row _id _row _tk tk _k _key _score score predicted spans held_out kept cls component none".split()
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in taken))
    out = module.stage(spark, docs, tiny)
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for r in found for n in taken)


def test_toxicity_held_out(spark):
    """Labels of held-out documents, a tenth of all labels being wrong."""
    import random

    from conftest import BAD, text

    rng = random.Random(8)
    rows = []
    for i in range(400):
        toxic = rng.random() < 0.3
        words = text(rng, rng.choice([5, 40, 150])).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic), int(toxic != (rng.random() < 0.1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int, toxic int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = toxicity.learn(docs.select("doc_id", "text"), docs.where(~held).select("doc_id", "toxic"))
    right = [r["truth"] == r["predicted"] for r in toxicity.score(docs.where(held), model).collect()]
    assert len(right) > 50 and sum(right) / len(right) >= 0.97


def test_byte_bpe_equals_tiktoken(spark, tiny):
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts(spark, tiny):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in byte_bpe.op5_byte_bpe(spark, tiny).collect())
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "ids")
    back = byte_bpe.decode(byte_bpe.encode(docs, byte_bpe.default_path()), byte_bpe.default_path())
    assert back.where("decoded <> coalesce(text, '')").count() == 0 and back.count() == docs.count()


@pytest.mark.parametrize("shared", [1, 10**9])
def test_rank_queues_agree(shared, monkeypatch):
    import random

    import public_tokenizers as p
    import tiktoken

    monkeypatch.setattr(byte_bpe, "SHARED_QUEUE", shared)
    v = byte_bpe.vocabulary(byte_bpe.default_path())
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=v.rank, special_tokens={})
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"aabetion th") for _ in range(rng.randint(1, 40))) for _ in range(400)] + [b"a" * 4000, b" " * 999]
    for piece, ids in zip(pieces, v.encode_pieces(pieces), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == enc._encode_single_piece(piece.decode())


def brute_katz(docs):
    tokens = []
    for i, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        tokens.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 != 0, re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]))
    uni, bi, n_docs = Counter(), Counter(), 0
    for _, train, w in tokens:
        if train:
            n_docs += 1
            uni.update(w)
            bi.update(zip(["<s>"] + w[:-1], w, strict=True))
    total = sum(uni.values())
    stars = [lm_scoring.discounts([0.0] + [float(Counter(c.values())[r]) for r in range(1, lm_scoring.K + 2)]) for c in (uni, bi)]
    star = lambda c, s: s[c] if c <= lm_scoring.K else c - lm_scoring.BIG
    rest = total - sum(star(c, stars[0]) for c in uni.values())
    p = lambda w: (star(uni[w], stars[0]) if uni[w] else rest) / total
    of = lambda v: n_docs if v == "<s>" else uni[v]
    seen = defaultdict(dict)
    for (v, w), c in bi.items():
        seen[v][w] = c
    alpha = {v: sum(c - star(c, stars[1]) for c in d.values()) / of(v) / (1 - sum(map(p, d))) for v, d in seen.items()}
    for v, d in seen.items():  # each context sums to one over known words and the unknown
        mass = sum(star(c, stars[1]) / of(v) for c in d.values()) + alpha[v] * (sum(p(w) for w in uni if w not in d) + rest / total)
        assert abs(mass - 1) < 1e-9
    for i, _, w in tokens:
        s = 0.0
        for v, x in zip(["<s>"] + w[:-1], w, strict=True):
            c = seen.get(v, {}).get(x, 0)
            s += math.log10(star(c, stars[1]) / of(v)) if c else math.log10(alpha.get(v, 1.0) * p(x))
        base = sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (len(uni) + 1))) for x in w)
        yield (i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(uni[x] > 0 for x in w), total, round(base, 6), round(s, 6))


@pytest.mark.parametrize("setting", [{}, {"hot": 5, "pairs": 3, "buckets": 1, "slices": 1}, {"hot": 40, "pairs": 60, "buckets": 3, "slices": 4, "block_bytes": 4000}, {"hot": 1, "pairs": 1, "buckets": 2, "slices": 7, "block_bytes": 1}])
def test_lm_scoring_equals_brute_force(spark, tiny, setting):
    """Several blocks, buckets and slices; few and many hot words and bigrams."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    if setting:
        train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) != 0
        scored = lm_scoring.score(docs.withColumn("train", train).repartition(3), **setting)
        scored = scored.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False)))
    else:
        scored = lm_scoring.op4_lm_scoring(spark, tiny)
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in scored.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_katz(texts(spark, tiny))))


def test_toxicity_finds_spans(spark, tiny):
    out = toxicity.op6_toxicity(spark, tiny)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(texts(spark, tiny))
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    scored = toxicity.score(docs.select("doc_id", "text", "score"), toxicity.learn(docs, labels))
    bad = re.compile("idiot|scum|moron|trash")
    for r in scored.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None and r["doc_id"] < 200:
            assert r["predicted"] == int(bool(bad.search(r["text"]))), r
            spans = [r["text"][s["start"] : s["end"]] for s in r["spans"]]
            assert set(spans) <= set(bad.findall(r["text"])) and bool(spans) == bool(r["predicted"])


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    counts = np.array([3, 0, 1, 5, toxicity.BLOCK + 3])
    e, move = rng.normal(size=int(counts.sum())), rng.normal(size=(2, 2))
    p, moves = toxicity.Chains(counts).marginals(e, move, True)
    at = 0
    for n in counts[:4].tolist():
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            weight[path] = math.exp(sum(move[a, b] + b * e[at + i] for i, (a, b) in enumerate(zip((0, *path), path, strict=False))))
        for i in range(n):
            want = sum(x for path, x in weight.items() if path[i]) / sum(weight.values())
            assert abs(p[at + i] - want) < 1e-9
        at += n
    assert abs(moves.sum() - counts.sum()) < 1e-6


def parsed(clean, sample):
    """Phrases of the greedy parse, by looking for every piece in the sample."""
    phrases, at = 0, 0
    while at < len(clean):
        size = 1
        while at + size < len(clean) and clean[at : at + size + 1] in sample:
            size += 1
        at, phrases = at + size, phrases + 1
    return phrases


def test_cross_parsing_equals_brute_force():
    """Short texts, texts over many lanes that never meet the lane's own parse, and large alphabets."""
    import random

    rng = random.Random(4)
    han = [chr(0x4E00 + i) for i in range(3000)]
    samples = {"a": "abracadabra abra", "b": "banana bandana", "long": "ab" * 4000 + " ba", "han": "".join(rng.choice(han[:1500]) for _ in range(3000)), "kan": "".join(rng.choice(han[1500:]) for _ in range(3000)), "prose": " ".join(rng.choice(["the", "river", "stone", "of", "light"]) for _ in range(800))}
    parser = language_id.CrossParser(samples)
    texts = ["abrabanana cab", "zzz", "b", "Dana! bra", "ab" * 3000, "ab" * 1500 + "x" + "ba" * 900, "".join(rng.choice(han) for _ in range(700)), samples["prose"][37:] + " " + samples["prose"][:900], "", "a" * language_id.LANE, "river" * 400, samples["han"][5:2500]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    cost, letters, symbols = parser.costs(data, np.cumsum([0] + [len(t.encode()) for t in texts]))
    for i, t in enumerate(texts):
        clean = re.sub(r"[\W\d_]+", " ", t.lower())
        assert symbols[i] == len(clean)
        for k, lang in enumerate(parser.langs):
            assert abs(cost[i, k] - parsed(clean, samples[lang]) * math.log2(len(samples[lang])) / max(len(clean), 1)) < 1e-9
    assert parser.costs(data[:0], np.zeros(1, np.int64))[0].shape == (0, 6)


def test_language_id_equals_brute_force(spark, tiny):
    """The whole query: sample, parse and choice."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    samples = language_id.learn(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1))
    own = {lang: {re.sub(r"[\W\d_]+", " ", r["text"].lower()) for r in docs.collect() if r["doc_id"] is not None and r["text"] and r["lang"] == lang and fold(r["doc_id"]) != 1} for lang in ("en", "fr")}
    for lang, sample in samples.items():  # whole texts of that language's learning fold
        assert sum(len(t) for t in own[lang] if t in sample) >= len(sample) - 2 * language_id.SAMPLE_DOCS
    for r in language_id.op7_language_id(spark, tiny).collect():
        text = next(d["text"] for d in docs.where(F.col("doc_id").eqNullSafe(r["doc_id"])).collect()) if r["doc_id"] in (None, 5, 13, 23, 225, 230, 231) else None
        if text is None:
            continue
        clean = re.sub(r"[\W\d_]+", " ", text.lower())
        costs = {lang: parsed(clean, s) * math.log2(len(s)) for lang, s in sorted(samples.items())}
        assert r["doc_id"] is None or r["lang_pred"] == min(costs, key=costs.get)


def test_language_id(spark, tiny):
    got = {(r["doc_id"], r["held_out"]): (r["lang_pred"], r["score"]) for r in language_id.op7_language_id(spark, tiny).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[220] == by_id[221] == by_id[222] == by_id[224] == ("und", 0.0)
    assert all(by_id[i][0] == ("fr" if i % 10 == 3 else "en") for i in range(120)) and all(0 <= v[1] <= 1 for v in got.values())


def test_ann_ties_and_recall(spark, tiny):
    good = {}
    for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect():
        x = r["embedding"]
        if r["vec_id"] is not None and x and None not in x and all(map(math.isfinite, x)) and any(x):
            good[r["vec_id"]] = np.array(x, float)
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    found = defaultdict(list)
    for r in sorted(ann.op9_ann(spark, tiny).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert abs(r["score"] - good[r["query_id"]] @ good[r["vec_id"]]) < 1e-9
        found[r["query_id"]].append((r["rank"], r["vec_id"]))
    hits = 0
    assert sorted(found) == [i for i in ids if i % 20 == 0]
    for q, list_ in found.items():
        s = x @ good[q]
        order = [i for i in ids[np.lexsort((ids, -np.round(s, 9)))].tolist() if i != q][:20]
        assert [r for r, _ in list_] == list(range(1, 21)) and q not in [v for _, v in list_]
        hits += len(set(order) & {v for _, v in list_})
    assert hits / (20 * len(found)) >= 0.9
    equal = [v for _, v in found[1000] if v >= 1000]  # equal vectors follow each other by id, without the query itself
    assert equal == list(range(1001, 1001 + len(equal))) and len(equal) > 10


@pytest.mark.parametrize("ratio", (1, 10_000))
def test_ann_one_much_longer_vector(spark, tmp_path, ratio):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= ratio
    x = x.astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = defaultdict(set)
    for r in ann.op9_ann(spark, str(tmp_path)).collect():
        found[r["query_id"]].add(r["vec_id"])
    exact = x.astype(np.float64) @ x[::20].astype(np.float64).T
    hits = 0
    for i in range(100):
        best = [v for v in np.argsort(-exact[:, i]).tolist() if v != 20 * i][:20]
        hits += len(set(best) & found[20 * i])
    assert hits / 2000 >= 0.95


@pytest.mark.parametrize("ratio", (1, 10_000))
def test_ann_several_shards_and_dimensions(spark, ratio):
    """Clustered vectors over several shards, blocks and lanes; another number of components; a shard of a single row."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(40, 64))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 64))).astype(np.float32)
    x[11] *= ratio
    other = rng.normal(size=(60, 3)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, v.tolist()) for i, v in enumerate(other)], "vec_id long, embedding array<float>")
    index = ann.build_index(frame, shard_rows=400)
    assert index.where("dim = 64").count() >= 5
    found = defaultdict(set)
    for r in ann.search(index, frame.where("vec_id % 20 = 0"), block=40).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for base, rows_ in ((0, x), (10_000, other)):
        y = rows_.astype(np.float64)
        for q in range(0, len(y), 20):
            best = [base + v for v in np.argsort(-(y @ y[q])).tolist() if v != q][:20]
            assert len(found[base + q]) == 20
            hits += len(set(best) & found[base + q])
    assert hits / (20 * len(found)) >= 0.95 and len(found) == 153


def test_ann_prunes_close_points_by_their_distances():
    """Points closer than float32 tells apart get the edges of the rule by exact distances."""
    rng = np.random.default_rng(6)
    x = np.concatenate([1 + 1e-5 * rng.normal(size=(200, 8)), np.ones((1, 8))])
    points = ann._evened(x, float(np.linalg.norm(x, axis=1).max()))
    edges = ann.robust_prune(points, np.array([200]), np.arange(200)[None], 201)
    open_, rule, far = list(range(200)), [], lambda i, j: math.dist(points[i], points[j])
    while open_ and len(rule) < ann.DEGREE:
        rule.append(min(open_, key=lambda i: far(i, 200)))
        open_ = [i for i in open_ if ann.ALPHA * far(i, rule[-1]) > far(i, 200)]
    assert [e for e in edges[0].tolist() if e < 201] == rule and len(rule) > 1


def test_chat_parts(spark):
    part = lambda kind, t=None, ref=None, w=None, h=None, s=None, p=None: (kind, t, ref, w, h, s, p)
    parts = [part("text", "see <|image|> "), part("image", ref="a.png", w=57, h=28), part("audio", ref="b.wav", s=1.5), part("document", ref="c.pdf", p=2), part("image", ref="d.png")]
    turns = spark.createDataFrame([(1, 0, "assistant", "ignored", parts), (1, 1, "user", "plain", None)], f"conv_id long, turn long, role string, text string, parts array<{chat_format.PART}>")
    a, b = sorted(chat_format.format_turns(turns).collect(), key=lambda r: r["turn"])
    assert a["piece"] == "<|im_start|>assistant\nsee <\\|image|> <|image|><|audio|><|document|><|image|><|im_end|>\n"
    assert [(x["place"], x["kind"], x["ref"], x["tokens"]) for x in a["attachments"]] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 2048), (4, "image", "d.png", 1)]
    assert a["expanded"] == 3 + 38 + 2048 + 1 and b["piece"] == "<|im_start|>user\nplain<|im_end|>\n" and b["loss_from"] == b["loss_to"]


def test_near_dedup_moves_no_texts_that_have_no_copy(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.bytes(4).hex() for _ in range(12000)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "one two three", "one two three"])], "doc_id long, text string").repartition(4)
    docs.write.mode("overwrite").parquet(path := f"{shared_folder(spark)}/texts-that-stay")
    bus, driver = spark.sparkContext._jsc.sc().listenerBus(), lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    bus.waitUntilEmpty()
    before = driver()
    kept_ids = sorted(r["doc_id"] for r in near_dedup.stage(spark, spark.read.parquet(path), "").select("doc_id").collect())
    bus.waitUntilEmpty()
    assert kept_ids == list(range(41))
    assert driver() - before < sum(map(len, texts)) / 4


def test_a_full_filter_changes_nothing(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    ids = lambda: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in near_dedup.stage(spark, docs, tiny).select("doc_id", "text").collect())
    want = ids()
    monkeypatch.setattr(near_dedup, "FILTER_BITS", 64)
    assert ids() == want
