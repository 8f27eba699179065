"""Texts longer than a chunk, and texts that a polynomial hash modulo 2^64 can't tell apart."""

import hashlib
import re

import numpy as np
import pytest
from cohortflow.llm import _text, entry, token_counts
from test_operators import same_as_sql

MB = 1_000_000


def thue_morse(bits: int) -> tuple[str, str]:
    """A string of 2^bits letters a and b, and its complement."""
    x = "a"
    for _ in range(bits):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [10, 11, 12])
@pytest.mark.parametrize("which", [0, 1])
def test_hash_without_the_known_pattern(bits, which):
    one, two = thue_morse(bits)
    data = np.frombuffer((one + two + "," + one).encode(), np.uint8)
    n = len(one)
    h = _text.span_hashes(data, np.array([0, n, 2 * n + 1]), np.array([n, 2 * n, 3 * n + 1]), which)
    assert h[0] != h[1] and h[0] == h[2]


def test_bytes_decide_where_hashes_are_equal():
    data = np.frombuffer(b"aa b aa ccc b ccc d", np.uint8)
    spans = [(m.start(), m.end()) for m in re.finditer(rb"\w+", b"aa b aa ccc b ccc d")]
    s, e = (np.array(x) for x in zip(*spans, strict=True))
    ids, first = _text.exact_ids(data, s, e, np.zeros(len(s), np.uint64))
    assert [bytes(data[s[first[i]] : e[first[i]]]) for i in ids] == [b"aa", b"b", b"aa", b"ccc", b"b", b"ccc", b"d"]
    assert len(first) == 4


@pytest.mark.parametrize("size", [4.5, 5, 6.5, 9])
@pytest.mark.parametrize("unit", ["ab cde ", "x", " ", "w" * 3_000_000 + " "])
def test_words_of_long_texts(size, unit):
    long = (unit * (int(size * MB) // len(unit) + 1))[: int(size * MB)]
    texts = ["Before it", long, "", "After"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, s, e, counts = _text.words(data, offsets, _text.SPACE)
    want = [t.split() for t in raw]
    assert counts.tolist() == [len(w) for w in want]
    assert [bytes(data[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)] == [w for ws in want for w in ws]
    assert len(set(h.tolist())) == len({w.lower() for ws in want for w in ws})


@pytest.fixture(scope="module")
def hard(spark, tiny, tmp_path_factory):
    """Long texts, and complements of Thue-Morse strings as words, lines, pre-tokens and shingles."""
    folder = str(tmp_path_factory.mktemp("hard"))
    one, two = thue_morse(10)
    docs = [(1, "many short words " * 300_000), (2, "y" * 5 * MB), (3, " \t" * 2_300_000), (4, ("Line of it all number one\n" + "z" * 999 + " ") * 4_400)]
    docs += [(10, f"{one} first"), (11, f"{two} first"), (12, f"{one}\nown line"), (13, f"{one}\nother line"), (14, f"{two}\nthird line"), (15, f"{one} {two} x"), (16, f"{two} {one} x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    items = [(1, "short words many short words many short words many short"), (2, one), (3, "number one " + "z" * 999)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for t in ("labels", "conversations", "embeddings"):
        spark.read.parquet(f"{tiny}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return folder


def test_hard_texts_decontaminated(spark, hard):
    """The query against loops; its SQL would need more memory than there is on such texts."""
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    docs, items = (spark.read.parquet(f"{hard}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    windows = {}
    for r in items:
        w = cut(r["text"])
        for i in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(r["item_id"]))
    want = []
    for r in docs:
        w = cut(r["text"])
        hit, found = np.zeros(len(w), bool), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit[i : i + n] = True
                    found |= own
        want.append((r["doc_id"], len(w), int(hit.sum()), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    got = entry.QUERIES["op1_decontamination"](spark, hard).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["op2_near_dedup", "op8_line_dedup", "op11_exact_dedup", "op12_lexical_search"])
def test_hard_texts_against_sql(spark, hard, name):
    assert name in entry.ORACLES and same_as_sql(spark, name, hard)


def test_hard_texts_in_other_operators(spark, hard):
    """Ids of byte-level BPE decode to the text, token counts follow the plain automaton, others give a row for each."""
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}

    for r in entry.QUERIES["op5_byte_bpe"](spark, hard).collect():
        assert r["decoded_sha256"] == hashlib.sha256(plain[r["doc_id"]].encode()).hexdigest()
    m = token_counts.automaton(token_counts.default_path())
    counts = {r["doc_id"]: r["n_tokens"] for r in entry.QUERIES["op3_token_counts"](spark, hard).collect()}
    for i in (10, 11, 15, 16):
        w = [x.encode() for x in plain[i].split()]
        data = np.frombuffer(b"".join(w), np.uint8)
        ends = np.cumsum([len(x) for x in w])
        assert counts[i] == int(m.count(data, ends - [len(x) for x in w], ends).sum())
    for name in ("op4_lm_scoring", "op6_toxicity"):
        assert entry.QUERIES[name](spark, hard).count() == len(plain)
