"""Vectorised helpers shared by the operators: chunks of Arrow text, word and span hashes, checkpoints.

A text column arrives in tasks as Arrow batches. The helpers look at its UTF-8 bytes directly: the word and
space classes of all contracts are decided by single bytes, so numpy can split whole chunks at once. A null text
counts as an empty one everywhere.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass looks at; longer texts are cut at separators and put together again.
CHUNK_BYTES = 1 << 21

U = np.uint64
_R = 0x9E3779B97F4A7C15
_SEEDS = (20260901, 77001)

#: A-Z to a-z; all other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: The white space of the contracts: blank and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F] after folding.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x61:0x7B] = False
NON_ALNUM[0x80:] = False

_PLAIN = ("doc_id", "text")

_tables: dict[str, np.ndarray] = {}


#: Span hashes also hold two polynomials modulo this prime, at these points.
_PRIME = (1 << 31) - 1
_POINTS = ((1_340_017_229, 702_184_663), (1_998_733_051, 415_926_539))


def _entries(n: int) -> int:
    """How many entries a table gets for n that are asked for: few for short texts, as the driver keeps its tables as long as it lives."""
    return max(n, min(CHUNK_BYTES + 65536, max(1 << 16, 1 << (n - 1).bit_length())))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n; kept between calls up to the size of a chunk."""
    have = _tables.get("p")
    if have is None or len(have) < n:
        size = _entries(n)
        p = np.full(size, U(_R))
        q = np.full(size, U(pow(_R, -1, 1 << 64)))
        p[0] = q[0] = 1
        p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
        if size > 4 * CHUNK_BYTES:
            return p, q
        _tables["p"], _tables["q"] = p, q
    return _tables["p"], _tables["q"]


def _values(which: int) -> np.ndarray:
    key = f"v{which}"
    if key not in _tables:
        _tables[key] = np.random.default_rng(_SEEDS[which]).integers(1, 1 << 63, 256, dtype=np.uint64)
    return _tables[key]


def _residues(n: int, point: int) -> tuple[np.ndarray, np.ndarray]:
    """point^i and point^-i modulo the prime for i < n, kept like the powers above."""
    have = _tables.get(f"m{point}")
    if have is not None and len(have[0]) >= n:
        return have
    size = _entries(n)
    found = []
    for base in (point, pow(point, -1, _PRIME)):
        p = np.ones(size, np.uint64)
        done = 1
        while done < size:
            more = min(done, size - done)
            p[done : done + more] = p[:more] * U(pow(base, done, _PRIME)) % U(_PRIME)
            done += more
        found.append(p)
    if size <= 4 * CHUNK_BYTES:
        _tables[f"m{point}"] = tuple(found)
    return tuple(found)


def _modular(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, point: int) -> np.ndarray:
    p, q = _residues(len(folded), point)
    terms = (values & U(_PRIME - 1))[folded]
    terms *= p[: len(folded)]
    high = terms >> U(31)
    terms &= U(_PRIME)
    terms += high
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return (sums[ends] - sums[starts]) % U(_PRIME) * q[starts] % U(_PRIME)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (the finaliser of a well-known 64-bit hash)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def span_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of folded[start:end] for each span; equal bytes give equal hashes wherever they stand.

    A polynomial modulo 2^64 alone would give equal hashes to texts of a known pattern; polynomials at two points modulo
    a prime, which have no such pattern, are mixed in.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _powers(len(folded))
    sums = np.empty(len(folded) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_values(which)[folded] * p[: len(folded)], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * q[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    one, two = (_modular(folded, starts, ends, _values(which), point) for point in _POINTS[which])
    return mix(h ^ ((one << U(31)) + two + U(1)) * U(0x9FB21C651E98DF25))


def same_spans(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span numbered `other`, compared byte by byte."""
    sizes = ends - starts
    same = sizes == sizes[other]
    own = np.flatnonzero(same & (sizes > 0) & (other != np.arange(len(other))))
    for at in range(0, len(own), 1 << 16):  # spans by the piece, so that long ones don't add up
        some = own[at : at + (1 << 16)]
        n = sizes[some]
        ends_at = np.cumsum(n)
        step = np.arange(int(ends_at[-1])) - np.repeat(ends_at - n, n)
        equal = folded[np.repeat(starts[some], n) + step] == folded[np.repeat(starts[other[some]], n) + step]
        same[some] = np.logical_and.reduceat(equal, ends_at - n)
    return same


def exact_ids(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's group of equal bytes, the first span of each group). Hashes propose, bytes decide."""
    def numbered(h):
        codes, uniques = pd.factorize(signed(h))
        at = np.empty(len(uniques), np.int64)
        at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        return codes.astype(np.int64), at

    ids, first = numbered(hashes)
    open_ = np.flatnonzero(~same_spans(folded, starts, ends, first[ids]))
    while len(open_):  # spans that share a hash with other bytes: numbered among themselves
        own, again = numbered(hashes[open_])
        ids[open_] = len(first) + own
        first = np.concatenate([first, open_[again]])
        open_ = open_[~same_spans(folded, starts[open_], ends[open_], again[own])]
    return ids, first


def text_chunks(column, limit: int = CHUNK_BYTES):
    """Yields (first row, row after the last, bytes, offsets from 0) for runs of whole texts of about `limit` bytes.

    One text longer than that is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, n)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, as workers live on between stages; only where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of each word; number of words of each text), after folding A-Z.

    Texts over the chunk size are hashed piece by piece, cut at separators, so memory beside the words stays bounded.
    """
    starts, ends, hashes = [], [], []
    at, n = 0, len(data)
    bounds = np.zeros(n + 1, bool) if n else None
    if n:
        bounds[offsets] = True
    while at < n:
        to = min(n, at + 2 * CHUNK_BYTES)
        while to < n and not (separators[FOLD[data[to - 1]]] or bounds[to]):
            gap = np.flatnonzero(separators[FOLD[data[to : to + CHUNK_BYTES]]] | bounds[to : min(n, to + CHUNK_BYTES)])
            to = to + int(gap[0]) + 1 if len(gap) else min(n, to + CHUNK_BYTES)
            if len(gap) and bounds[to - 1]:
                to -= 1
                break
        folded = FOLD[data[at:to]]
        inside = ~separators[folded]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | bounds[at + 1 : to]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | bounds[at + 1 : to]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(span_hashes(folded, s, e))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    starts, ends, hashes = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
    edges = np.searchsorted(starts, offsets)
    return hashes, starts, ends, np.diff(edges)


def shingle_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; shorter inputs give none."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = word[:n].copy()
    for i in range(1, k):
        h *= U(0x9FB21C651E98DF25)
        h += word[i : n + i]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark longs."""
    return h.view(np.int64)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between steps: the session's spark.checkpoint.dir.

    A local session without one (tests) gets a folder of its own; a cluster without one is refused, as its machines
    can't read each other's disks.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def kept(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder, so that lost executors cost no lineage."""
    shared_folder(spark)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a compressed table in the shared folder."""
    path = f"{shared_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    # Small row groups: writers hold one of each task, and rows of packed arrays are large.
    frame.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def framed(docs: DataFrame) -> DataFrame:
    """doc_id, text and row: all other columns go into one struct, where no name of theirs can clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in _PLAIN]
    return docs.select(*(c for c in _PLAIN if c in docs.columns), F.struct(*rest or [F.lit(0).alias("none")]).alias("row"))


def unframed(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again, in their order."""
    return frame.select(*columns_of(docs))


def columns_of(docs: DataFrame) -> list:
    """Those columns, as they are read from a frame made by `framed`."""
    return [F.col(c) if c in _PLAIN else F.col("row").getField(c).alias(c) for c in docs.columns]
