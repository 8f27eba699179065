import random
import re

import numpy as np
from cohortflow.llm import token_counts as T


def greedy(word: bytes, pieces: set[bytes]) -> int:
    n, at = 0, 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 1, -1) if word[at : at + k] in pieces), 1)
        at, n = at + size, n + 1
    return n


def test_automaton_equals_greedy():
    rng = random.Random(5)
    for _ in range(40):
        pieces = {bytes(rng.choice(b"abc_") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))}
        m = T.LongestMatch(sorted(pieces), b"_")
        texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40))) for _ in range(60)]
        data = np.frombuffer(b" ".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = ends - [len(t) for t in texts]
        assert m.count(data, starts, ends).tolist() == [greedy(b"_" + t, pieces) for t in texts]


def test_query_against_brute_force(spark):
    rows = [(1, "The cat, the  Hütte\n\tüber"), (2, None), (3, ""), (4, " \n "), (5, "x" * 3000 + " 日本語 \U0001f600"), (5, "The cat"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_tokens", "'k' AS lang")
    got = T.count_tokens(docs, T.default_path())
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_tokens"]
    pieces = set(T.piece_file(T.default_path()))
    for r in got.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert (r["n_words"], r["n_tokens"]) == (len(w), sum(greedy(T.MARKER + x.encode(), pieces) for x in w))
    assert T.count_tokens(docs.limit(0), T.default_path()).count() == 0
