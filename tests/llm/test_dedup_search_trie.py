"""Exact dedup, lexical search and the prefix trie at their limits: full tables, hot groups, many shards and partitions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cohortflow.llm import exact_dedup, lexical_search, prefix_trie

WORDS = "the of and to in river stone light green paper window garden summer letter bridge silver mountain corner market village".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def expected_groups(docs):
    by = defaultdict(list)
    for i, (d, t) in enumerate(docs):
        by[re.sub(r"[ \t-\r]+", " ", t or "")].append((d is None, d or 0, i))
    out = []
    for t, members in by.items():
        low = min(members)
        keep = None if low[0] else low[1]
        for null, d, _ in members:
            out.append((None if null else d, keep, len(members), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget", [4_000, 64 << 20])
def test_exact_dedup_levels(spark, budget):
    """Tables with room for a few contents and for all give the same groups."""
    rng = random.Random(5)
    docs = [(i, rng.choice(["hot  text", "hot\ttext", "hot\n\x0b text"]) if i % 3 == 0 else f"text {rng.randrange(40)} \r\n {'x' * rng.randrange(3)}") for i in range(400)]
    docs += [(7, "text 1  "), (7, "text 1  "), (None, "hot text"), (None, None), (None, ""), (900, " "), (901, "y" * 50_000), (902, "y" * 50_000), (903, "a b"), (904, "a b")]
    found = exact_dedup.exact_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), budget)
    rows = found.collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=repr) == expected_groups(docs)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in rows}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_content_decides():
    """Contents that share a hash are different entries; a full table still finds what it holds."""
    table = exact_dedup.ContentTable(10_000)
    assert [table.find(5, b"%d" % i) for i in range(30)] == list(range(30))
    assert [table.find(5, b"%d" % i) for i in range(30)] == list(range(30))
    assert table.find(5, b"z" * 20_000) == -1 and table.find(5, b"3") == 3


def test_exact_dedup_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert left.count() == len({re.sub(r"[ \t-\r]+", " ", r["text"] or "") for r in docs.collect()})


def test_packed_numbers():
    x = np.array([0, 1, 127, 128, 16_383, 16_384, 2**40, 2**62])
    assert lexical_search.unpack(lexical_search.pack(x)).tolist() == x.tolist()
    assert lexical_search.unpack(lexical_search.pack(x[:0])).tolist() == []


def ranked(docs, items, k):
    terms = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, terms(t)) for d, t in docs]
    own = [(d, t) for d, t in own if t]
    n, total = len(own), sum(len(t) for _, t in own)
    df = defaultdict(int)
    for _, t in own:
        for x in set(t):
            df[x] += 1
    out = []
    for item, text_ in items:
        scored = []
        for d, t in own:
            score = sum(int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[x] + 1)))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * (10 + 90 * len(t) * n // total))) for x in set(terms(text_)) & set(t))
            if score > 0:
                scored.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard_docs", "block", "at_once"), [(7, 2, 3), (8192, 3, 1024), (64, 1024, 1)])
def test_search_over_shards_and_blocks(spark, monkeypatch, shard_docs, block, at_once):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "QUERIES_AT_ONCE", at_once)
    rng = random.Random(8)
    docs = [(1000 - i, text(rng, rng.choice([1, 5, 40])) + (" Écoles" if i % 50 == 0 else "")) for i in range(300)] + [(2000 + i, "river stone light") for i in range(20)]
    items = [(i, text(rng, 6)) for i in range(9)] + [(20, "écoles river"), (21, "nowhere"), (22, "THE the")]
    rng.shuffle(docs)
    index = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_docs)
    got = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == ranked(docs, items, 5)


def expected_trie(turns):
    own = defaultdict(list)
    for c, t, role, body in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", body or ""))
    own = {c: [(r, b) for _, _, r, b in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1].encode().split()) if node else 0)
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_of_long_and_repeated_conversations(spark, monkeypatch):
    """One conversation holds a third of all rows and spans partitions; many are equal; some lose all turns."""
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    rng = random.Random(4)
    turns = [(40, t, "user", f"deep {t}") for t in range(150)] + [(59, t, "user", f"deep {t}") for t in range(60)]
    turns += [(100 + c, t, ("user", "assistant")[t % 2], f"same {t} of all") for c in range(60) for t in range(3)]
    turns += [(c, t, "user", f"t{rng.randrange(3)} \x0b w") for c in range(200, 260) for t in range(rng.randrange(1, 6))]
    turns += [(300 + c, 1, None, None) for c in range(25)] + [(300, None, "user", "first"), (300, 1, None, None), (None, 1, "user", "lost")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).select(*columns).collect()), key=repr)
    assert got == expected_trie(turns)
