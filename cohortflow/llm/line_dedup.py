r"""Line dedup: range-partitioned line hashes, streamed in order, answered with keep bitmaps.

A line's key is the line without surrounding [\x20\x09-\x0D] and with A-Z lower-cased; keys of at least `min_chars`
code points count. Each such line becomes a small row (128-bit hash, doc_id, position); text stays behind. The rows are
range-partitioned by (hash, doc_id), so a line that a third of all documents hold is spread over many partitions, and
sorted within them by (hash, doc_id, position). A task streams its partition and knows for every hash that lies wholly
inside how many documents hold it and which is the last. Only the first and last hash of a partition can go on in
another one; their counts, two rows a partition whatever the input, are added up on the driver and sent back.

A key held by at least `min_docs` documents stays in the largest doc_id holding it; elsewhere its lines are dropped.
The answer is one row per document that loses lines: (doc_id, row_hash, n_lines, bitmap), the bitmap a zlib-packed bit
per line, 1 = keep.

Defined results: a null or empty text is one empty line; documents with a null doc_id neither count as holders nor lose
lines; rows that repeat a doc_id count as one document, and each keeps its own bitmap (a row is known by its doc_id and the
64-bit hash of its text, row_hash); equal lines of one document share its fate; a text of any length is cut whole; an empty
table gives no rows. Extra columns are kept whatever their names, but for `bitmap`, which `with_bitmaps` replaces and
`stage` keeps.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm._text import FOLD, SPACE, framed, kept, signed, span_hashes, text_chunks, unframed

MIN_CHARS = 20
MIN_DOCS = 3

_LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_hash", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])
_LINE_SQL = "h1 long, h2 long, doc_id long, row_hash long, pos int, n_lines int"


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of every line of every text; number of lines of each text)."""
    newline = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(newline, offsets)) + 1
    starts = np.sort(np.concatenate([offsets[:-1], newline + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], newline]), kind="stable")
    return starts, ends, per_text


def _stripped(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = np.flatnonzero(~SPACE[folded])
    if not len(solid):
        return ends, ends
    s = solid[np.minimum(np.searchsorted(solid, starts), len(solid) - 1)]
    e = solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)] + 1
    empty = (s >= ends) | (s < starts) | (e <= starts)
    return np.where(empty, ends, s), np.where(empty, ends, e)


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for every line whose key has at least min_chars code points."""

    def cut(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rows = batch.column("row_hash").to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_chunks(batch.column("text")):
                folded = FOLD[data]
                starts, ends, per_text = _lines(data, offsets)
                s, e = _stripped(folded, starts, ends)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                pick = np.flatnonzero(points[e] - points[s] >= min_chars)
                s, e = s[pick], e[pick]
                text = np.repeat(np.arange(last - first), per_text)[pick]
                begin = np.cumsum(per_text) - per_text
                arrays = [
                    signed(span_hashes(folded, s, e)),
                    signed(span_hashes(folded, s, e, 1)),
                    ids[first:last][text].astype(np.int64),
                    rows[first:last][text].astype(np.int64),
                    (pick - begin[text]).astype(np.int32),
                    per_text[text].astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=_LINE)

    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    return source.mapInArrow(cut, _LINE_SQL)


class _Groups:
    """The hash groups of some sorted rows: where each starts, its documents, its largest doc_id."""

    def __init__(self, batch: pa.RecordBatch):
        self.h1, self.h2, self.doc = (batch.column(i).to_numpy() for i in range(3))
        n = len(self.h1)
        new = np.ones(n, bool)
        new[1:] = (self.h1[1:] != self.h1[:-1]) | (self.h2[1:] != self.h2[:-1])
        new_doc = new.copy()
        new_doc[1:] |= self.doc[1:] != self.doc[:-1]
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, n))
        self.docs = np.add.reduceat(new_doc.astype(np.int64), self.first) if n else np.zeros(0, np.int64)
        self.last_doc = self.doc[self.first + self.size - 1]


def _whole_groups(batches):
    """Batches of sorted rows, dealt anew so that no hash goes on from one to the next."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = _Groups(batch)
        cut = int(g.first[-1])
        if left and cut == 0:
            h = left[-1]
            same = h.column(0)[h.num_rows - 1] == batch.column(0)[0] and h.column(1)[h.num_rows - 1] == batch.column(1)[0]
            if same:
                left.append(batch)
                continue
        if cut or left:
            ready = [*left, batch.slice(0, cut)]
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0] if sum(b.num_rows for b in ready) else batch.slice(0, 0)
        left = [batch.slice(cut)]
    if left:
        yield pa.Table.from_batches(left).combine_chunks().to_batches()[0]


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row_hash, pos, n_lines) of the lines to drop."""
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(parts, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    # A checkpoint keeps partitions and order: both passes below see the same rows in the same places.
    ordered = kept(spark, ordered)

    def edges(batches):
        found: dict[tuple[int, int], list] = {}
        ends: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = _Groups(batch)
            for i in sorted({0, len(g.first) - 1}):
                key = (int(g.h1[g.first[i]]), int(g.h2[g.first[i]]))
                docs, last = int(g.docs[i]), int(g.last_doc[i])
                if key in found:
                    before = found[key]
                    before[0] += docs - (before[1] == int(g.doc[g.first[i]]))
                    before[1] = last
                else:
                    found[key] = [docs, last]
                if not ends:
                    ends = [key, key]
                ends[1] = key
            for key in [k for k in found if k not in ends]:
                del found[key]
        rows = [(*k, *found[k]) for k in dict.fromkeys(ends)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["h1", "h2", "docs", "last_doc"])

    spanning: dict[tuple[int, int], list[int]] = {}
    for r in ordered.mapInArrow(edges, "h1 long, h2 long, docs long, last_doc long").toLocalIterator():
        seen = spanning.setdefault((r["h1"], r["h2"]), [0, r["last_doc"]])
        seen[0] += r["docs"]
        seen[1] = max(seen[1], r["last_doc"])
    shared = spark.sparkContext.broadcast(spanning)

    def drop(batches):
        known = shared.value
        for batch in _whole_groups(batches):
            g = _Groups(batch)
            if not len(g.first):
                continue
            docs, last = g.docs.copy(), g.last_doc.copy()
            for i in sorted({0, len(g.first) - 1}):
                key = (int(g.h1[g.first[i]]), int(g.h2[g.first[i]]))
                if key in known:
                    docs[i], last[i] = known[key]
            gone = np.repeat(docs >= min_docs, g.size) & (g.doc != np.repeat(last, g.size))
            yield batch.filter(pa.array(gone)).select(["doc_id", "row_hash", "pos", "n_lines"])

    return ordered.mapInArrow(drop, "doc_id long, row_hash long, pos int, n_lines int")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row_hash, n_lines, bitmap) of the documents that lose lines; row_hash is xxhash64 of the text."""

    @F.pandas_udf("binary")
    def pack(pos, n_lines):
        import pandas as pd

        def one(places, n):
            keep = np.ones(n, bool)
            keep[places] = False
            return zlib.compress(np.packbits(keep).tobytes(), 1)

        return pd.Series([one(np.asarray(p), n) for p, n in zip(pos, n_lines, strict=True)], dtype=object)

    gone = dropped_lines(line_rows(docs, min_chars), min_docs)
    # Repeated rows give the same positions twice: collect_set counts them once. A group is one document's lines.
    by_doc = gone.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("pos"), F.max("n_lines").alias("n_lines"))
    return by_doc.select("doc_id", "row_hash", "n_lines", pack("pos", "n_lines").alias("bitmap"))


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Every row of docs with its bitmap, null where it keeps all lines."""
    own, side = docs.drop("bitmap").alias("d"), bitmaps.hint("shuffle_hash").alias("b")
    met = (F.col("d.doc_id") == F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.row_hash"))
    return own.join(side, met, "left").select("d.*", "b.bitmap")


def _kept_text(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), 0, text or ""
    keep = unpack(bitmap, len(lines))
    return len(lines), int((~keep).sum()), "\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(batches):
        for batch in batches:
            out = [_kept_text(t.as_py(), b.as_py()) for t, b in zip(batch.column("text"), batch.column("bitmap"), strict=True)]
            arrays = [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(docs, keep_bitmaps(docs)).mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the dropped lines; n_chars follows the text where the table has it, and every other
    column, whatever its name, comes out as it was."""

    @F.pandas_udf("string")
    def cut(text, bitmap):
        import pandas as pd

        return pd.Series([t if b is None else _kept_text(t, b)[2] for t, b in zip(text, bitmap, strict=True)], dtype=object)

    own = framed(docs)
    joined = with_bitmaps(own, keep_bitmaps(own)).withColumn("text", cut("text", "bitmap"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("bitmap").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("row", F.col("row").withField("n_chars", n))
    return unframed(joined, docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
hot AS (SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 AND doc_id IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
flagged AS (SELECT lines.rid, lines.doc_id, i, line, coalesce(hot.top <> lines.doc_id, false) AS gone FROM lines LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY rid, doc_id
"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {"op8_line_dedup": ORACLE}
