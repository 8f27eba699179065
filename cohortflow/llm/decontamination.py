r"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are runs of `window` consecutive words (a shorter, but not empty, item is one window). As a set, a
window holds its word shingles; containment must be whole, so one shingle is a sufficient prefix: the one found in the
fewest documents. A document is probed only with these prefix shingles. Each hit fixes where the window would start;
the length and positional bounds drop candidates that would leave the document, and the words at that place are
compared byte for byte with the window, so hashes only propose and never decide.

Words are the runs of bytes outside [\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; the windows
of an item with a null id mark words but are not listed as an item; repeated benchmark rows count once, repeated
documents give a row each; shingles that are as rare as each other are taken in order of their hashes, which changes no
result; a text of any length is probed whole; an empty benchmark hits nothing; extra columns of documents are kept and
those whose names clash with the results are replaced, but the stage returns all of them as they were.

The benchmark is measured first. Up to `block_windows` windows of BLOCK_BYTES at most travel to the tasks as one variable;
more are dealt in blocks of that size, each joined with all documents, and the hits of the blocks are united.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cohortflow.llm._text import FOLD, NON_ALNUM, U, columns_of, framed, kept, shingle_hashes, signed, text_chunks, unframed, words

#: Windows, and bytes of their words, that one broadcast may hold: about 100 MB of Python objects at most.
BLOCK_WINDOWS, BLOCK_BYTES = 100_000, 16 << 20
SHINGLE_WORDS = 5

_RESULT = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("item_ids", ArrayType(StringType()))]
_RANGES = StructField("ranges", ArrayType(StructType().add("first", IntegerType()).add("n", IntegerType())))


def _word_bytes(text: str | None) -> list[bytes]:
    if not text:
        return []
    data = np.frombuffer(text.encode(), np.uint8)
    folded = FOLD[data].tobytes()
    _, starts, ends, _ = words(data, np.array([0, len(data)]), NON_ALNUM)
    return [folded[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows of the items: (words, as one string; n words; the items' ids as strings)."""

    def cut(batches):
        for batch in batches:
            out = {"words": [], "n": [], "item_id": []}
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = _word_bytes(text)
                size = min(window, len(w))
                for i in range(len(w) - size + 1 if w else 0):
                    out["words"].append(b" ".join(w[i : i + size]))
                    out["n"].append(size)
                    out["item_id"].append(item)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("words", pa.binary()), ("n", pa.int32()), ("item_id", pa.string())]))

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    cuts = rows.mapInArrow(cut, "words binary, n int, item_id string")
    return cuts.groupBy("words", "n").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


class _Prober:
    """One block of windows, by the prefix shingle that finds them."""

    def __init__(self, windows: list[tuple[bytes, list[str]]], k: int, frequency: dict[int, int]):
        self.k, self.rows = k, [(w, w.count(b" ") + 1, items) for w, items in windows]
        self.lengths: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for at, (text, n, _) in enumerate(self.rows):
            size = min(k, n)
            data = np.frombuffer(text, np.uint8)
            h, *_ = words(data, np.array([0, len(data)]), NON_ALNUM)
            own = shingle_hashes(h, size)
            rarest = min(range(len(own)), key=lambda i: (frequency.get(int(own[i]), 0), int(own[i])))
            self.lengths.setdefault(size, {}).setdefault(int(own[rarest]), []).append((at, rarest))
        self.tables = {size: np.sort(np.fromiter(d, np.uint64, len(d))) for size, d in self.lengths.items()}
        self.maps = {size: _bitmap(t) for size, t in self.tables.items()}

    def hits(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: np.ndarray, counts: np.ndarray):
        """(text, first word, words, window) of each verified occurrence in a chunk of texts."""
        edges = np.concatenate([[0], np.cumsum(counts)])
        for size, by_hash in self.lengths.items():
            own = shingle_hashes(hashes, size)
            for at in _members(own, self.tables[size], self.maps[size]).tolist():
                text = int(np.searchsorted(edges, at, "right")) - 1
                if at + size > edges[text + 1]:
                    continue
                for window, offset in by_hash[int(own[at])]:
                    text_of, n, _ = self.rows[window]
                    first = at - offset
                    if first < edges[text] or first + n > edges[text + 1]:
                        continue
                    if b" ".join(folded[starts[i] : ends[i]].tobytes() for i in range(first, first + n)) == text_of:
                        yield text, first - int(edges[text]), n, window


def _bitmap(table: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(table & U((1 << 20) - 1)).astype(np.int64)] = True
    return bits


def _members(h: np.ndarray, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes that the sorted table holds; a bitmap of 2^20 bits sorts most others out first."""
    if not len(table) or not len(h):
        return np.zeros(0, np.int64)
    maybe = np.flatnonzero(bits[(h & U((1 << 20) - 1)).astype(np.int64)])
    found = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
    return maybe[table[found] == h[maybe]]


def _document_frequency(docs: DataFrame, shingles: dict[int, np.ndarray]) -> DataFrame:
    """In how many documents each shingle of a block of the benchmark occurs."""
    maps = {size: _bitmap(t) for size, t in shingles.items()}

    def count(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                h, _, _, counts = words(data, offsets, NON_ALNUM)
                edges = np.concatenate([[0], np.cumsum(counts)])
                for size, table in shingles.items():
                    own = shingle_hashes(h, size)
                    at = _members(own, table, maps[size])
                    text = np.searchsorted(edges, at, "right") - 1
                    inside = at + size <= edges[text + 1]
                    pairs = np.unique(np.stack([text[inside].astype(np.uint64), own[at[inside]]]), axis=1)
                    values, n = np.unique(pairs[1], return_counts=True)
                    for v, c in zip(values.tolist(), n.tolist(), strict=True):
                        seen[v] = seen.get(v, 0) + c
        keys = np.fromiter(seen, np.uint64, len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(list(seen.values()), pa.int64())], ["shingle", "docs"])

    return docs.select("text").mapInArrow(count, "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))


def _probe(docs: DataFrame, prober, with_ranges: bool) -> DataFrame:
    """Adds the results of one block to every row of `docs`; with_ranges also the hit runs, to be united with others."""
    schema = StructType([*docs.schema.fields, *_RESULT, *([_RANGES] if with_ranges else [])])

    def probe(batches):
        p = prober.value
        for batch in batches:
            n_words, n_hit, items, ranges = [], [], [], []
            for _, _, data, offsets in text_chunks(batch.column("text")):
                h, starts, ends, counts = words(data, offsets, NON_ALNUM)
                found: dict[int, list[tuple[int, int, int]]] = {}
                for text, first, n, window in p.hits(h, starts, ends, FOLD[data], counts):
                    found.setdefault(text, []).append((first, n, window))
                for text, n in enumerate(counts.tolist()):
                    n_words.append(n)
                    own = found.get(text, ())
                    n_hit.append(_covered([(f, m) for f, m, _ in own]))
                    items.append(sorted({i for *_, w in own for i in p.rows[w][2]}))
                    ranges.append([{"first": f, "n": m} for f, m in sorted({(f, m) for f, m, _ in own})])
            columns = [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
            names = [*batch.schema.names, "n_words", "n_hit", "item_ids"]
            if with_ranges:
                columns.append(pa.array(ranges, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))))
                names.append("ranges")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(probe, schema)


def _covered(runs: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for first, n in sorted(runs):
        total += max(0, first + n - max(end, first))
        end = max(end, first + n)
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle_words: int = SHINGLE_WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """`docs` with n_words, n_hit and item_ids (sorted strings) of the windows of `benchmark` that occur in each text."""
    spark: SparkSession = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "item_ids")
    windows = kept(spark, benchmark_windows(benchmark, window))
    total, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    blocks = max(1, -(-total // block_windows), -(-size // BLOCK_BYTES))

    def block(i: int) -> list[tuple[bytes, list[str]]]:
        mine = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i)
        return sorted((bytes(r["words"]), list(r["items"])) for r in mine.select("words", "items").toLocalIterator())

    def prober(i: int):
        rows = block(i)
        shingles: dict[int, set[int]] = {}
        for text, _ in rows:
            size = min(shingle_words, text.count(b" ") + 1)
            data = np.frombuffer(text, np.uint8)
            shingles.setdefault(size, set()).update(shingle_hashes(words(data, np.array([0, len(data)]), NON_ALNUM)[0], size).tolist())
        tables = {size: np.sort(np.fromiter(s, np.uint64, len(s))) for size, s in shingles.items()}
        frequency = {r["shingle"] % (1 << 64): r["docs"] for r in _document_frequency(docs, tables).toLocalIterator()} if rows else {}
        return spark.sparkContext.broadcast(_Prober(rows, shingle_words, frequency))

    if blocks == 1:
        return _probe(docs, prober(0), False)
    # More windows than a broadcast may hold: the hits of all blocks, by the text they are found in, then united.
    sides = None
    for i in range(blocks):
        own = _probe(docs.select("text").where(F.col("text").isNotNull()), prober(i), True)
        hit = own.where(F.size("ranges") > 0).select(F.sha2("text", 256).alias("_key"), "item_ids", "ranges").distinct()
        hit = kept(spark, hit)
        sides = hit if sides is None else sides.unionByName(hit)
    united = sides.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("_items"), F.flatten(F.collect_list("ranges")).alias("_ranges"))
    plain = _probe(framed(docs), spark.sparkContext.broadcast(_Prober([], shingle_words, {})), False).drop("n_hit", "item_ids")
    joined = plain.withColumn("_key", F.sha2("text", 256)).join(united, "_key", "left")
    # Runs in order; each adds what lies beyond the furthest end so far.
    state = F.aggregate(
        F.array_sort("_ranges"),
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end")),
        lambda s, r: F.struct(
            (s["total"] + F.greatest(F.lit(0).cast("long"), r["first"] + r["n"] - F.greatest(s["end"], r["first"]))).alias("total"),
            F.greatest(s["end"], (r["first"] + r["n"]).cast("long")).alias("end"),
        ),
    )
    return joined.select(*columns_of(docs), "n_words", F.coalesce(state["total"], F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("item_ids"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a window of the benchmark go; the others keep every column, whatever its name."""
    return unframed(decontaminate(framed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0"), docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
dw AS (SELECT rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wi AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wi),
hit AS (SELECT g.rid, g.i, g.n, wi.item_id FROM
  (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) g
  JOIN wi ON wi.n = g.n AND wi.win = g.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d JOIN dw USING (rid) LEFT JOIN pos USING (rid) LEFT JOIN ids USING (rid)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": ORACLE}
