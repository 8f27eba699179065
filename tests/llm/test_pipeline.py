"""The pipeline against a version of loops and sets over the same small tables."""

import hashlib
import re
import sys
from collections import defaultdict

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_pipeline(spark, tiny):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    got = corpus_pipeline.run(spark, tiny).collect()
    # The classifier is held against labels elsewhere; what it keeps is where the loops begin.
    all_docs = spark.read.parquet(f"{tiny}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[0][1](spark, all_docs, tiny).collect()]
    assert len(docs) < all_docs.count() and all(len([i for i, _ in docs if i == k]) for k in (0, 220, 221))
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                holders[key(x)].add(i)
    docs = [(i, "\n".join(x for x in (t or "").split("\n") if i is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i)) for i, t in docs]
    sets = [(lambda w: {tuple(w[j : j + 2]) for j in range(max(1, len(w) - 1))} if w else set())(words(t)) for _, t in docs]
    root = list(range(len(docs)))
    for _ in range(6):
        for a in range(len(docs)):
            for b in range(len(docs)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    groups = defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(docs[k])
    docs = [min(g, key=lambda d: (d[0] is None, d[0])) for g in groups.values()]
    item_words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in item_words if w for i in range(max(1, len(w) - 9))}

    def clean(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        return not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    want = sorted((repr(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs if clean(t))
    assert sorted((repr(r["doc_id"]), r["decoded_sha256"]) for r in got) == want


def test_pipeline_on_empty_tables(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
