r"""Ranked lexical search: document-at-a-time over compressed postings, shard by shard.

Terms are the runs of bytes outside [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F], A-Z lower-cased. `build_index` cuts the
documents, as the tasks read them, into shards of bounded size and writes for each shard and term its postings in order of
doc_id: blocks of gaps and frequencies as variable-length bytes. Nothing is shuffled for that. Statistics (documents,
terms, documents holding a term) are sums over the index.

`search` joins the index with the terms of the queries, each with its weight and the queries that hold it, and deals what
matches by (shard, block of queries). There every query is a k-way merge: cursors over its terms' postings decode a block at
a time and stand in a heap, keyed by the last document that the block reaches. The smallest of these keys is as far as all
cursors are known, so all postings up to it are merged and their documents scored to the end, in order of doc_id; then the
cursors that are used up are refilled. Results stand in a bounded heap keyed by score, then doc_id; a later document with
the score of the heap's last one can't enter. The best of all shards are merged by a limited window.

Scores are exact integers, see `weights` and `_Shard.scores`.

Defined results: a null or wordless text has no terms and is no document of the statistics; a null or wordless query has no
results; rows that repeat an item_id are one query with the terms of all of them, and rows with a null item_id are one
query too; rows that repeat a doc_id are documents of their own; a null doc_id can be found and comes after all others of
its score; equal scores go by ascending doc_id; a text of any length is indexed whole; empty tables give an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortflow.llm._text import FOLD, NON_ALNUM, exact_ids, give_back, kept, stored, text_chunks, words

TOP = 10
#: Documents and terms (with repeats) of a shard at most, but for one document; postings of a block; queries of a block.
SHARD_DOCS, SHARD_TERMS, BLOCK, QUERIES_AT_ONCE = 8192, 1 << 22, 1024, 1024

_NO_ID = np.iinfo(np.int64).max
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("n_terms", pa.int64()), ("lasts", pa.list_(pa.int32())), ("blocks", pa.list_(pa.binary()))])
_INDEX_SQL = "shard long, term string, df long, n_terms long, lasts array<int>, blocks array<binary>"


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of seven bits, the last of each number below 128; and each number's bytes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[at[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, size


def pack(values: np.ndarray) -> bytes:
    return varints(values)[0].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


class _Builder:
    """The postings of one shard, gathered chunk by chunk."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.size = 0

    def add(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        h, starts, ends, counts = words(data, offsets, NON_ALNUM)
        folded = FOLD[data]
        own, first = exact_ids(folded, starts, ends, h)
        raw = folded.tobytes()
        known = np.fromiter((self.terms.setdefault(raw[s:e], len(self.terms)) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)), np.int64, len(first))
        doc = np.repeat(np.arange(len(counts)), counts)
        key, tf = np.unique(doc * max(len(first), 1) + own, return_counts=True)
        self.postings.append(tuple(x.astype(np.int32) for x in (known[key % max(len(first), 1)], key // max(len(first), 1) + self.docs, tf)))
        self.ids.append(ids)
        self.lengths.append(counts.astype(np.int64))
        self.docs += len(counts)
        self.size += len(h)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's documents (a row without a term) and the postings of its terms, in order of the term."""
        term, doc, tf = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        self.postings = []
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int32)
        place[by_id] = np.arange(len(ids))
        ids, lengths = ids[by_id], lengths[by_id]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([None], pa.string()), pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([[]], pa.list_(pa.int32())), pa.array([[ids.tobytes(), pack(lengths)]], pa.list_(pa.binary()))], schema=_INDEX)
        if not len(term):
            return
        names = sorted(self.terms)
        rank = np.empty(len(names), np.int32)
        rank[np.fromiter((self.terms[n] for n in names), np.int64, len(names))] = np.arange(len(names))
        term, doc = rank[term], place[doc]
        self.terms = {}
        order = np.argsort(term.astype(np.int64) * len(ids) + doc)
        term, doc, tf = term[order], doc[order], tf[order]
        del order
        first = np.flatnonzero(np.diff(term, prepend=-1))
        size = np.diff(np.append(first, len(term)))
        within = np.arange(len(term)) - np.repeat(first, size)
        gap = np.diff(doc, prepend=0)
        gap[within == 0] = doc[within == 0]
        # A block's bytes: gaps, then frequencies. All blocks are packed in one go and cut where they end.
        cut = np.flatnonzero(within % BLOCK == 0)
        ends = np.append(cut[1:], len(term))
        step = np.arange(len(term)) + np.repeat(cut, ends - cut)
        numbers = np.empty(2 * len(term), np.int64)
        numbers[step], numbers[step + np.repeat(ends - cut, ends - cut)] = gap, tf
        packed, width = varints(numbers)
        del numbers, step, gap, tf, within
        at = np.append(np.cumsum(width) - width, len(packed))[np.append(2 * cut, 2 * len(term))]
        lasts = doc[ends - 1].astype(np.int32)
        edge = np.searchsorted(cut, np.append(first, len(term))).astype(np.int32)
        for a in range(0, len(names), 20_000):
            b = min(len(names), a + 20_000)
            own, lo, hi = edge[a : b + 1], int(edge[a]), int(edge[b])
            inner = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at[lo : hi + 1] - at[lo]).astype(np.int32)), pa.py_buffer(packed[at[lo] : at[hi]])])
            arrays = [pa.array(np.full(b - a, shard)), pa.array(names[a:b], pa.binary()).cast(pa.string()), pa.array(size[a:b]), pa.array(np.zeros(b - a, np.int64))]
            arrays += [pa.ListArray.from_arrays(pa.array(own - lo), x) for x in (pa.array(lasts[lo:hi]), inner)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_INDEX)


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index as a stored table: a row per shard and term (df documents, blocks of postings, the last document of
    each), and one without a term per shard (df documents with terms, n_terms in all, their ids and lengths)."""

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        shard, now = base, _Builder()
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_chunks(batch.column("text")):
                while first < last:
                    to = min(last, first + shard_docs - now.docs)
                    part = offsets[len(offsets) - 1 - (last - first) :][: to - first + 1]
                    now.add(ids[first:to], data[part[0] : part[-1]], part - part[0])
                    first = to
                    if now.docs >= shard_docs or now.size >= SHARD_TERMS:
                        yield from now.rows(shard)
                        shard, now = shard + 1, _Builder()
                        give_back()
        if now.docs:
            yield from now.rows(shard)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, _INDEX_SQL))


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each term of an item once."""
    plain = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(plain, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def weights(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, w) of those terms that documents hold: floor(1000 ln((2N + 2) / (2df + 1)))."""
    held = index.where("term IS NOT NULL").select("term", "df").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    n = F.lit(index.where("term IS NULL").agg(F.sum("df")).first()[0] or 0)
    return held.select("term", F.floor(1000 * F.log((2 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))


class _Cursor:
    """A term's postings in a shard, decoded a block at a time."""

    def __init__(self, w: int, lasts: np.ndarray, blocks: list[bytes], shard: _Shard):
        self.w, self.lasts, self.blocks, self.shard = w, lasts, blocks, shard
        self.next, self.before = 0, 0
        self.refill()

    def refill(self) -> None:
        both = unpack(self.blocks[self.next])
        n = len(both) >> 1
        self.docs = np.cumsum(both[:n]) + self.before
        self.gains = self.w * ((1_000_000_000 * both[n:]) // (1000 * both[n:] + 8 * self.shard.m[self.docs]))
        self.before = int(self.docs[-1])
        self.next += 1
        # As far as the cursor is known: to its block's last document, or to the end of the shard.
        self.known = self.before if self.next < len(self.blocks) else _NO_ID

    def take(self, to: int) -> tuple[np.ndarray, np.ndarray]:
        at = len(self.docs) if to >= self.before else int(np.searchsorted(self.docs, to, "right"))
        found = self.docs[:at], self.gains[:at]
        self.docs, self.gains = self.docs[at:], self.gains[at:]
        return found


class _Shard:
    """Document lengths and queried postings of one shard."""

    def __init__(self, ids: bytes, lengths: bytes, n: int, total: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.m = 10 + (90 * unpack(lengths) * n) // max(total, 1)
        self.lists: dict[str, tuple[int, list[int], list[bytes]]] = {}

    def best(self, terms: list[str], k: int) -> list[tuple[int, int]]:
        """The k highest (score, place of the document), in no order."""
        cursors = [_Cursor(*self.lists[t], self) for t in terms]
        heap = [(c.known, i) for i, c in enumerate(cursors)]
        heapq.heapify(heap)
        top: list[tuple[int, int]] = []  # (score, -place): places go up with doc_id
        while heap:
            to = heap[0][0]
            for score, place in self.scores([cursors[i].take(to) for _, i in heap], top[0][0] if len(top) == k else 0, k):
                if len(top) < k:
                    heapq.heappush(top, (score, -place))
                elif score > top[0][0]:
                    heapq.heapreplace(top, (score, -place))
            while heap and heap[0][0] <= to:
                _, i = heapq.heappop(heap)
                if cursors[i].next < len(cursors[i].blocks):
                    cursors[i].refill()
                    heapq.heappush(heap, (cursors[i].known, i))
        return [(score, -place) for score, place in top]

    @staticmethod
    def scores(lists: list[tuple[np.ndarray, np.ndarray]], above: int, k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best merged documents with a score over `above`, in order of place."""
        docs = np.concatenate([d for d, _ in lists])
        if not len(docs):
            return []
        gains = np.concatenate([g for _, g in lists])
        order = np.argsort(docs.astype(np.int32), kind="stable")
        docs, gains = docs[order], gains[order]
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        score, docs = np.add.reduceat(gains, first), docs[first]
        good = np.flatnonzero(score > above)
        if len(good) > k:
            good = np.sort(good[np.lexsort((docs[good], -score[good]))[:k]])
        return list(zip(score[good].tolist(), docs[good].tolist(), strict=True))


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0."""
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    pairs = kept(spark, query_terms(items))
    count = pairs.select("item_id").distinct().count()
    blocks = max(1, -(-count // QUERIES_AT_ONCE))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    # An item travels as its place in its block's list, so that any type of id will do.
    numbered = pairs.select("item_id", block.alias("block")).distinct().withColumn("item", F.row_number().over(Window.partitionBy("block").orderBy(F.col("item_id").asc_nulls_first())))
    numbered = kept(spark, numbered)
    of_term = pairs.alias("p").join(numbered.alias("q"), F.col("p.item_id").eqNullSafe(F.col("q.item_id"))).groupBy("p.term", "q.block").agg(F.collect_list("q.item").alias("items"))
    asked = kept(spark, of_term.join(weights(index, pairs), "term"))

    total = index.where("term IS NULL").agg(F.sum("df").alias("n"), F.sum("n_terms").alias("l")).first()
    n, length = total["n"] or 0, total["l"] or 0
    found = index.where("term IS NOT NULL").select("shard", "term", "lasts", "blocks").join(asked, "term").select("shard", "block", "term", "w", "items", "lasts", "blocks")
    none = lambda kind: F.lit(None).cast(kind)
    # A shard's documents go to each of its blocks of queries: as many small rows as units of work.
    heads = index.where("term IS NULL").select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), none("string").alias("term"), none("long").alias("w"), none("array<int>").alias("items"), none("array<int>").alias("lasts"), "blocks")

    def answer(batches):
        at, shard, queries = None, None, {}

        def results():
            out = [(at[1], item, score, place) for item, terms in queries.items() for score, place in shard.best(terms, k)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            ids = shard.ids[np.array(cols[3], np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(cols[2], pa.int64())], ["block", "item", "doc_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["block"]) != at:
                    if queries:
                        yield results()
                    at, queries = (row["shard"], row["block"]), {}
                if row["term"] is None:
                    shard = _Shard(*row["blocks"], n, length)
                    continue
                shard.lists[row["term"]] = (row["w"], row["lasts"], row["blocks"])
                for item in row["items"]:
                    queries.setdefault(item, []).append(row["term"])
        if queries:
            yield results()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.unionByName(found).repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", F.col("term").asc_nulls_first())
    near = dealt.mapInArrow(answer, "block int, item int, doc_id long, score long").where("score > 0")
    order = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = best.join(numbered, ["block", "item"])
    return named.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
d AS (SELECT rid, doc_id, l, len(l)::BIGINT AS n FROM w WHERE len(l) > 0),
total AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM d),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(l) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM total) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
s AS (SELECT item_id, rid, d.doc_id, CAST(sum(wt.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * d.n * total.n) // total.l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN d USING (rid), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM
  (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLES = {"op12_lexical_search": ORACLE}
