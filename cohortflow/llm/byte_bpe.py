r"""Byte-level BPE with a hierarchical-bitmap rank queue.

Pre-tokens: every match of the GPT-style pattern ('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|
\s+(?!\S)|\s+). Their borders follow from the class of each character and its neighbours alone, so numpy finds them for
a chunk of texts at once. Equal pre-tokens of a chunk are encoded once; a bounded cache carries them on to the next.

One pre-token is a doubly linked list of parts. Each mergeable neighbouring pair lies in the bucket of its merge rank;
a two-level bitmap marks the ranks with a bucket, and find-first-set on both levels gives the lowest rank in constant
time, whatever the length. Within a bucket the leftmost position goes first; entries whose pair has since changed are
stale and skipped. A pre-token of n bytes takes O(n log n) at worst, so very long ones are safe.

The vocabulary file (base64 token and rank on each line) is a parameter; every worker opens it by that path.

Defined results: a null text encodes like an empty one, to no ids; repeated rows give a row each; an empty table gives
an empty table; an extra column named like a result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortflow.llm._text import exact_ids, span_hashes, text_chunks

#: Pre-tokens that a worker remembers: about 50 MB.
CACHE_ENTRIES = 200_000
#: Bytes of text whose different pre-tokens share a queue.
PART_BYTES = 6 << 20
#: From so many pre-tokens on, one queue serves all of them.
SHARED_QUEUE = 64
_GROUP = 9  # ranks of one word of the lower bitmap: 2^9

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


def _classes() -> np.ndarray:
    """The class of every code point, from the regex module's own tables."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[ord(text[m.start()]) : ord(text[m.end() - 1]) + 1] = kind
    table[0xD800:0xE000] = 0
    return table


def pretoken_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of every pre-token of some texts, number of pre-tokens of each text)."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(point)
    edges = np.searchsorted(at, offsets)
    if not n:
        return at, np.zeros(len(offsets) - 1, np.int64)
    kind = classes[point]
    opens = np.zeros(n + 1, bool)
    opens[edges] = True  # where a text starts; n stands for the end
    space = kind == _SPACE
    before_space = np.zeros(n, bool)
    before_space[1:] = space[:-1] & ~opens[1:n]
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | opens[1:n]
    # White space: a run is one token but for its last character, which stands alone or leads the next token.
    leads = np.zeros(n, bool)
    leads[:-1] = space[:-1] & ~space[1:] & ~opens[1:n]
    blank = np.zeros(n, bool)
    blank[1:] = (point[:-1] == 32) & ~opens[1:n]
    start = (space & change) | leads | (~space & change & ~blank)
    # 's 't 'm 'd 're 've 'll end a token of their own where the apostrophe starts one.
    quote = np.flatnonzero((point == 39) & start & change)
    if len(quote):
        end = np.searchsorted(edges, quote, "right")
        room = edges[np.minimum(end, len(edges) - 1)] - quote
        p1 = point[np.minimum(quote + 1, n - 1)]
        p2 = point[np.minimum(quote + 2, n - 1)]
        one = (room > 1) & np.isin(p1, [115, 116, 109, 100])
        two = (room > 2) & (((p1 == 114) & (p2 == 101)) | ((p1 == 118) & (p2 == 101)) | ((p1 == 108) & (p2 == 108)))
        start[quote[one | two] + 1] = False
        for after in (quote[one] + 2, quote[two] + 3):
            start[after[(after < n)]] = True
    first = np.flatnonzero(start)
    return at[first], np.diff(np.searchsorted(first, edges))


class Vocabulary:
    """Ranks, mergeable pairs and token bytes of one file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.rank.values()) + 1
        rank, size = self.rank, self.size
        self.pairs = {rank[t[:i]] * size + rank[t[i:]]: r for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
        self.byte = [rank[bytes([b])] for b in range(256)]
        by_id = [b""] * size
        for t, r in rank.items():
            by_id[r] = t
        self.length = np.fromiter(map(len, by_id), np.int64, size)
        self.offset = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.pair_keys = np.sort(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self.pair_ranks = np.fromiter((self.pairs[k] for k in self.pair_keys.tolist()), np.int64, len(self.pairs))
        self.byte_ids = np.array(self.byte, np.int64)
        self.cache: dict[bytes, bytes] = {}
        self.classes = _classes()

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: lowest merge rank first, leftmost of equals."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        pairs, size, n, byte = self.pairs, self.size, len(piece), self.byte
        part = [byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        top, low, bucket = 0, {}, {}
        for i in range(n - 1):
            r = pairs.get(part[i] * size + part[i + 1])
            if r is not None:
                q = bucket.get(r)
                if q is None:
                    bucket[r] = [i]
                    g = r >> _GROUP
                    top |= 1 << g
                    low[g] = low.get(g, 0) | 1 << (r & 511)
                else:
                    q.append(i)
        while top:
            g = (top & -top).bit_length() - 1
            word = low[g]
            r = (g << _GROUP) + (word & -word).bit_length() - 1
            q = bucket[r]
            if len(q) > 1:
                i = heappop(q)
            else:
                i = q[0]
                del bucket[r]
                word &= word - 1
                if word:
                    low[g] = word
                else:
                    del low[g]
                    top &= top - 1
            j = after[i]
            if part[i] < 0 or j >= n or pairs.get(part[i] * size + part[j]) != r:
                continue  # stale
            k = after[j]
            part[i], part[j], after[i] = r, -1, k
            fresh = []
            if k < n:
                before[k] = i
                fresh.append((pairs.get(r * size + part[k]), i))
            p = before[i]
            if p >= 0:
                fresh.append((pairs.get(part[p] * size + r), p))
            for s, at in fresh:
                if s is None:
                    continue
                q = bucket.get(s)
                if q is None:
                    bucket[s] = [at]
                    g = s >> _GROUP
                    top |= 1 << g
                    low[g] = low.get(g, 0) | 1 << (s & 511)
                else:
                    heappush(q, at)
        return [x for x in part if x >= 0]

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, -1 where it has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (as bytes of unsigned 32-bit integers) of many pre-tokens, with one rank queue for all of them.

        The pieces share a linked list with gaps between them; a bucket holds the positions of all pieces, and a step
        merges a whole bucket. Steps go up in rank, as within each piece. Should a merge make a pair of no higher rank
        than its own, steps would no longer be each piece's own order; such a piece is encoded again by itself.
        """
        if len(pieces) < SHARED_QUEUE:
            return [np.array(self.encode_piece(p), np.uint32).tobytes() for p in pieces]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(size) - size
        n = int(size.sum())
        part = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[begin + size - 1] = -1
        before[begin] = -1
        rank = np.full(n, -1)
        rank[:-1] = self.rank_of_pairs(part[:-1], part[1:])
        rank[begin + size - 1] = -1
        whole = np.fromiter((self.rank.get(p, -1) for p in pieces), np.int64, len(pieces))
        known = np.flatnonzero(whole >= 0)
        rank[np.repeat(begin[known], size[known]) + np.arange(int(size[known].sum())) - np.repeat(np.cumsum(size[known]) - size[known], size[known])] = -1
        bucket: dict[int, list[np.ndarray]] = {}
        top, low = 0, {}

        def push(at: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal top
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            edges = [0, *cuts.tolist(), len(at)]
            for r, a, b in zip(ranks[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
                q = bucket.get(r)
                if q is None:
                    bucket[r] = [at[a:b]]
                    g = r >> _GROUP
                    top |= 1 << g
                    low[g] = low.get(g, 0) | 1 << (r & 511)
                else:
                    q.append(at[a:b])

        live = np.flatnonzero(rank >= 0)
        if len(live):
            push(live, rank[live])
        odd: list[np.ndarray] = []
        while top:
            g = (top & -top).bit_length() - 1
            word = low[g]
            r = (g << _GROUP) + (word & -word).bit_length() - 1
            word &= word - 1
            if word:
                low[g] = word
            else:
                del low[g]
                top &= top - 1
            q = bucket.pop(r)
            at = q[0] if len(q) == 1 else np.unique(np.concatenate(q))
            at = at[rank[at] == r]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                # Pairs that overlap, as in aaa: every second of a run, from the left.
                chained = np.zeros(len(at), bool)
                chained[1:] = after[at[:-1]] == at[1:]
                if chained.any():
                    index = np.arange(len(at))
                    at = at[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            has = follow >= 0
            mine, next_ = at[has], follow[has]
            then = self.rank_of_pairs(np.full(len(mine), r), part[next_])
            lower = (then >= 0) & (then <= r)
            if lower.any():
                odd.append(mine[lower])
            part[at] = r
            rank[gone] = -1
            rank[at] = -1
            after[at] = follow
            before[next_] = mine
            rank[mine] = self.rank_of_pairs(np.full(len(mine), r), part[next_])
            prior = before[at]
            has = prior >= 0
            prior = prior[has]
            rank[prior] = self.rank_of_pairs(part[prior], np.full(len(prior), r))
            fresh = np.concatenate([mine, prior])
            ranks = rank[fresh]
            keep = ranks >= 0
            fresh, ranks = fresh[keep], ranks[keep]
            if len(fresh):
                lower = ranks <= r
                if lower.any():
                    odd.append(fresh[lower])
                push(fresh, ranks)
        dead = np.zeros(n, bool)
        linked = after[after >= 0]
        dead[:] = True
        dead[begin] = False
        dead[linked] = False
        # A merged part leaves its own link behind; only what the list still reaches counts.
        reach = ~dead
        reach &= (before == -1) | (after[np.maximum(before, 0)] == np.arange(n))
        reach[begin] = True
        own = np.add.reduceat(reach.astype(np.int64), begin)
        ids = part[reach].astype(np.uint32)
        ends = np.cumsum(own)
        raw = ids.tobytes()
        out = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), own.tolist(), strict=True)]
        for i in known.tolist():
            out[i] = np.uint32(whole[i]).tobytes()
        if odd:
            for i in np.unique(np.searchsorted(begin, np.concatenate(odd), "right") - 1).tolist():
                out[i] = np.array(self.encode_piece(pieces[i]), np.uint32).tobytes()
        return out

    def encode(self, column):
        """Yields (first text, text after the last, their ids in a row, number of ids of each) over a text column."""
        part, size = [], 0
        for chunk in text_chunks(column):
            part.append(chunk)
            size += len(chunk[2])
            if size >= PART_BYTES:
                yield from self._encode(part)
                part, size = [], 0
        if part:
            yield from self._encode(part)

    def _encode(self, part):
        chunks, wanted = [], {}
        for first, last, data, offsets in part:
            starts, counts = pretoken_starts(data, offsets, self.classes)
            ends = np.append(starts[1:], len(data))
            codes, where = exact_ids(data, starts, ends, span_hashes(data, starts, ends))
            raw = data.tobytes()
            uniques = [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            wanted.update(dict.fromkeys(p for p in uniques if p not in self.cache))
            chunks.append((first, last, counts, codes.astype(np.int32), uniques))
        fresh = dict(zip(wanted, self.encode_pieces(list(wanted)), strict=True)) if wanted else {}
        del wanted
        for first, last, counts, codes, uniques in chunks:
            found = [fresh[h] if h in fresh else self.cache[h] for h in uniques]
            flat = np.frombuffer(b"".join(found), np.uint32)
            length = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            begin = np.cumsum(length) - length
            own = length[codes]
            total = np.concatenate([[0], np.cumsum(own)])
            ids = flat[np.repeat(begin[codes] - total[:-1], own) + np.arange(int(total[-1]))]
            yield first, last, ids, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])
        if len(self.cache) + len(fresh) > CACHE_ENTRIES:
            self.cache = {}
        self.cache.update((h, x) for (h, x), _ in zip(fresh.items(), range(CACHE_ENTRIES), strict=False) if len(x) < 400)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        if not len(ids):
            return b""
        length = self.length[ids]
        total = np.cumsum(length)
        return self.flat[np.repeat(self.offset[ids] - (total - length), length) + np.arange(int(total[-1]))].tobytes()


_open: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, opened once by each worker."""
    if path not in _open:
        _open[path] = Vocabulary(path)
    return _open[path]


def _encoded(batches, path: str, names: list[str]):
    """Batches with ids, a batch for each chunk of texts."""
    v = vocabulary(path)
    for batch in batches:
        for first, last, ids, counts in v.encode(batch.column("text")):
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.view(np.int32)))
            rows = batch.select(names).slice(first, last - first)
            yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*names, "ids"])


def _decoded(batches, path: str):
    """For each batch with ids: the batch and the bytes that each row's ids stand for, one after the other."""
    v = vocabulary(path)
    for batch in batches:
        yield batch, ((values, v.decode(values.astype(np.int64))) for values in _lists(batch.column("ids")))


def _lists(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield values[a:b]


def encode(docs: DataFrame, path: str, drop_text: bool = False) -> DataFrame:
    """`docs` with ids (array<int>) of each text; without the text itself if drop_text."""
    docs = docs.drop("ids")
    out = docs.drop("text") if drop_text else docs
    names = out.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return docs.mapInArrow(lambda batches: _encoded(batches, path, names), f"{schema}, ids array<int>" if names else "ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with decoded, the bytes that its ids stand for, as text."""
    encoded = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches):
        for batch, rows in _decoded(batches, path):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode("utf-8", "replace") for _, t in rows], pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{schema}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to.

    The same steps as encode and decode, chained within a task, so that the ids need no way through the JVM.
    """

    def run(batches):
        for batch, rows in _decoded(_encoded(batches, path, ["doc_id"]), path):
            n, ids_hash, text_hash = [], [], []
            for values, text in rows:
                n.append(len(values))
                ids_hash.append(hashlib.sha256(values.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, default_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the kept documents as ids, checked by decoding them again."""
    return digests(docs, default_path())


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
