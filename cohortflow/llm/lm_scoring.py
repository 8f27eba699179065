r"""Language-model scoring with a Katz backoff bigram model.

Tokens are words ([^\x20\x09-\x0D]+, A-Z lower-cased) and one end for each text; before its first word stands a start.
The model: counts up to K are discounted as Good and Turing have it, larger ones by BIG, and what the discounts free
goes to the lower order. P(w | v) = c*(v w) / c(v) for seen bigrams, else alpha(v) P(w); alpha(v) is
(what v's bigrams were discounted by / c(v)) / (1 - sum of P(w) over v's seen w), so each context sums to one exactly.
P(w) = c*(w) / N, and the freed rest belongs to unknown words.

Scoring follows the recursion token by token: the bigram table answers for seen bigrams, the others go on to the
table of contexts for alpha(v) and to the word's own probability. Nothing of the corpus is held in one place:

1. Word counts: a table by word. Hot words, those that are at least 1/HOT of the training tokens (so HOT at most), are
   known to all tasks. So are hot bigrams, those that a share of 1/PAIRS of the tokens is seen for in blocks where they
   are as frequent (so PAIRS at most; every bigram of twice that share is among them).
2. Texts go in blocks; a block deals its distinct bigrams with their counts to buckets by the second word (a hot word's
   by both words, as its count is known anywhere), and apart from them the texts that hold each. Only a hot bigram's
   texts stay with the block. A bucket is walked in slices of its keys: a slice's bigrams are sorted and counted, its part
   of the bigram table goes out and two small numbers for each of the blocks' bigrams stay. Then the blocks' lists of
   texts pass by, one at a time, and are answered: for each text how many of its bigrams were seen how often, and which
   weren't.
3. The discounts follow from the counts of counts. Slices' shares of each context are added up by first word into the
   table of contexts; unseen bigrams meet it there, hot contexts by a broadcast of HOT weights at most.
4. The answers of all buckets are added up for each block of texts, hot bigrams' by a broadcast of their counts.

Rows between steps 2 and 4 are packed arrays, one for each block and bucket that have something in common, so never more
than tokens; contexts and unseen bigrams are plain rows. Word codes are three bytes for hot words and 64-bit hashes for
the others (two different words share one with probability n^2 / 2^65). Each step's output is written to the shared
checkpoint folder. The number of buckets follows the number of tokens. A task holds one block, or one bucket's packed
counts and one slice; a text that alone exceeds a block is a block.

Defined results: a null text is empty and has one token; a null doc_id is scored, but neither learned from nor held
out; repeated rows count and are scored each; without training text every score is that of unknown words at
probability 1, 0.0, and so is base_score; an empty table gives an empty table; texts of any length are scored whole;
ties can't change a result; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm._text import SPACE, U, mix, signed, stored, text_chunks, words

K = 5
BIG = 0.01
#: Bounds on the words and bigrams known to all tasks.
HOT, PAIRS = 1_000_000, 4_000
#: Tokens of a bucket and of a slice of it; text bytes and texts of a block.
BUCKET_TOKENS, SLICE_TOKENS = 4_000_000, 400_000
BLOCK_BYTES, BLOCK_TEXTS = 4 << 20, 60_000
END, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
_NOT_HOT = 0xFFFFFF


def _pieces(batches):
    """(ids, training flags, word hashes, words of each text, bytes) of runs of texts, at most BLOCK_TEXTS each."""
    for batch in batches:
        ids, train = batch.column("doc_id"), batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for a, b, data, offsets in text_chunks(batch.column("text")):
            h, _, _, counts = words(data, offsets, SPACE)
            edges = np.concatenate([[0], np.cumsum(counts)])
            for i in range(a, b, BLOCK_TEXTS):
                j = min(b, i + BLOCK_TEXTS)
                yield ids.slice(i, j - i), train[i:j], h[edges[i - a] : edges[j - a]], counts[i - a : j - a], int(offsets[j - a] - offsets[i - a])


def _block(pieces: list):
    """(ids, training flags, token hashes, previous tokens, text of each token) of a block's pieces."""
    counts = np.concatenate([p[3] for p in pieces])
    h = np.concatenate([p[2] for p in pieces])
    n = len(h) + len(counts)
    ends = np.cumsum(counts + 1) - 1
    own, before = np.empty(n, np.uint64), np.empty(n, np.uint64)
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    own[is_end], own[~is_end] = END, h
    before[1:] = own[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = START
    text = np.repeat(np.arange(len(counts), dtype=np.uint16), counts + 1)
    return pa.concat_arrays([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), own, before, text


def _blocks(batches, block_bytes: int):
    """The blocks of a task's texts, whatever batches they come in."""
    have, size, texts = [], 0, 0
    for piece in _pieces(batches):
        if have and (size + piece[4] > block_bytes or texts + len(piece[3]) > BLOCK_TEXTS):
            yield _block(have)
            have, size, texts = [], 0, 0
        have.append(piece)
        size += piece[4]
        texts += len(piece[3])
    if have:
        yield _block(have)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U(0x9FB21C651E98DF25) + second)


def token_counts(texts: DataFrame, pairs: int = PAIRS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(kind, w, c): kind 0, every training token's hash and count; kind 1, bigrams' counts in blocks where they are frequent."""
    names, kinds = ["kind", "w", "c"], "kind int, w long, c long"

    def rows(kind, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(signed(keys)), pa.array(counts.astype(np.int64))], names)

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0)
        for _, train, w, before, text in _blocks(batches, block_bytes):
            own = train[text]
            u, c = np.unique(w[own], return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, u]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, c]), minlength=len(keys))
            p, c = np.unique(pair_hash(before[own], w[own]), return_counts=True)
            often = c * pairs >= own.sum()
            yield rows(1, p[often], c[often])
            if len(keys) > 1_000_000:
                yield rows(0, keys, counts)
                keys, counts = np.zeros(0, np.uint64), np.zeros(0)
        yield rows(0, keys, counts)

    return texts.mapInArrow(run, kinds).groupBy("kind", "w").agg(F.sum("c").alias("c"))


def discounts(n: list[float]) -> list[float]:
    """c* for c = 0..K (0 for 0) from the counts of counts n[1..K+1]; half a count off where they don't decrease."""
    if n[1] > 0 and all(x > 0 for x in n[1:]):
        common = (K + 1) * n[K + 1] / n[1]
        star = [(r + 1) * n[r + 1] / n[r] for r in range(1, K + 1)]
        if common < 1:
            out = [(s - r * common) / (1 - common) for r, s in enumerate(star, 1)]
            if all(0 < s < r for r, s in enumerate(out, 1)) and all(a < b for a, b in zip(out, out[1:], strict=False)):
                return [0.0, *out]
    return [0.0, *(r - 0.5 for r in range(1, K + 1))]


def _star(c: np.ndarray, by_count: np.ndarray) -> np.ndarray:
    return np.where(c <= K, by_count[np.minimum(c, K).astype(np.int64)], c - BIG)


class _Words:
    """What every task knows of words: the hot ones' codes and counts, hot bigrams, and how counts become probabilities."""

    def __init__(self, hot: np.ndarray, hot_counts: np.ndarray, pairs: list[int], total: int, distinct: int, star: list[float], rest: float):
        at = np.argsort(hot.view(np.uint64))
        self.hash, self.count = hot.view(np.uint64)[at], hot_counts[at].astype(np.float64)
        self.pairs = np.sort(np.array([x % (1 << 64) for x in pairs], np.uint64))
        self.total, self.distinct, self.star, self.rest = float(total), distinct, np.array(star), rest

    def code(self, w: np.ndarray) -> np.ndarray:
        """Each word's place among the hot ones, -1 for others."""
        if not len(self.hash):
            return np.full(len(w), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, w), len(self.hash) - 1)
        return np.where(self.hash[at] == w, at, -1)

    def packed(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the words in bytes: three for each, then eight for each that isn't hot; which those are)."""
        code = self.code(w)
        rare = code < 0
        code[rare] = _NOT_HOT
        return _bytes((code & 0xFFFF).astype(np.uint16), (code >> 16).astype(np.uint8), w[rare]), rare

    def unpacked(self, data: bytes, n: int, at: int = 0, to: int | None = None, rare_at: int = 0) -> np.ndarray:
        """Words `at` to `to` of n packed ones, `rare_at` not hot ones standing before them."""
        size = (n if to is None else to) - at
        code = np.frombuffer(data, np.uint16, size, 2 * at) | (np.frombuffer(data, np.uint8, size, 2 * n + at).astype(np.int32) << 16)
        hot = code != _NOT_HOT
        out = np.empty(size, np.uint64)
        out[hot] = self.hash[code[hot]]
        rare = size - int(hot.sum())
        out[~hot] = np.frombuffer(data[3 * n + 8 * rare_at : 3 * n + 8 * (rare_at + rare)], np.uint64)
        return out

    def pair(self, key: np.ndarray) -> np.ndarray:
        """The place of each hot bigram in their order, -1 for others."""
        if not len(self.pairs):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _star(c, self.star), self.rest) / self.total

    def shares(self, count: np.ndarray, c2: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(base score, score as far as discounts of small counts don't matter) of one token of a bigram.

        A token's own count is the divisor of the bigram after it, so it is taken off here.
        """
        if not self.total:
            return np.zeros(len(c2)), np.zeros(len(c2))
        base = np.log10((c2 + 0.1) / (self.total + 0.1 * (self.distinct + 1)))
        seen = np.where(count > K, np.log10(np.maximum(count - BIG, BIG)), 0.0)
        return base, seen + np.where(count == 0, np.log10(self.probability(c2)), 0.0) - np.where(~ends & (c2 > 0), np.log10(np.maximum(c2, 1)), 0.0)


_PACKED = "part int, kind int, block long, a binary, b binary, c binary, d binary, e binary"
_FORMAT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in "abcde")])
#: Kinds of rows, in the order a bucket reads them: known words, a block's bigrams, their texts, a block's texts; then what
#: it gives: the bigram table, hot bigrams' counts, texts' sums, unseen bigrams.
_KNOWN, _BIGRAMS, _HOLDERS, _TEXTS, _TABLE, _PAIRS, _SUMS, _UNSEEN = range(8)


def _row(part: int, kind: int, block: int, *arrays: np.ndarray) -> pa.RecordBatch:
    binary = [a.tobytes() for a in arrays] + [b""] * (5 - len(arrays))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in binary)], schema=_FORMAT)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(j)[i].as_py() for j in range(8))


def _grouped(frame: DataFrame, parts: int, column: str, reduce, schema: str) -> DataFrame:
    """Rows dealt by a column; reduce(its value, rows as they come, ordered by kind and block or part) for each value."""
    place = _FORMAT.get_field_index(column)

    def run(batches):
        for value, rows in itertools.groupby(_rows(batches), key=lambda r: r[place]):
            yield from reduce(value, rows)

    # Buckets are numbered, so each gets a partition of its own.
    dealt = F.col(column) if column == "part" else F.xxhash64(column)
    return frame.repartitionById(parts, F.pmod(dealt, F.lit(parts)).cast("int")).sortWithinPartitions(column, "kind", "block", "part").mapInArrow(run, schema)


def _slices(keys: np.ndarray, parts: int) -> list[int]:
    return np.searchsorted(keys, np.arange(parts + 1)).tolist()


def _bytes(*arrays: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(a).view(np.uint8) for a in arrays])


def _small(numbers: np.ndarray) -> np.ndarray:
    """The numbers in as few bytes as their largest one needs."""
    top = int(numbers.max()) if len(numbers) else 0
    return numbers.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n])


def _deal_bigrams(texts: DataFrame, shared, parts: int, slices: int, block_bytes: int) -> DataFrame:
    """Each block's bigrams by bucket and slice: second words and runs, first words, training counts; and who holds them."""

    def run(batches):
        words_ = shared.value
        base = TaskContext.get().partitionId() << 32
        for number, (ids, train, w, before, text) in enumerate(_blocks(batches, block_bytes)):
            block = base + number
            length = np.bincount(text, minlength=len(train)).astype(np.int64)
            valid = np.array(ids.is_valid().to_numpy(zero_copy_only=False), bool)
            code, uniques = pd.factorize(np.concatenate([w, before]).view(np.int64))
            uniques = uniques.view(np.uint64)
            n = len(w)
            second, first = code[:n], code[n:]
            hot = words_.code(uniques) >= 0
            two, one = mix(uniques), mix(uniques ^ START)
            spread = ((np.where(hot[second], two[second] + one[first], two[second])) % U(parts * slices)).astype(np.int64)
            order = np.lexsort((first, second, spread)) if int(parts * slices).bit_length() + 2 * int(len(uniques)).bit_length() > 63 else np.argsort(((spread * len(uniques)) + second) * len(uniques) + first)
            spread, second, first, text = spread[order], second[order], first[order], text[order]
            new = np.ones(n, bool)
            new[1:] = (second[1:] != second[:-1]) | (first[1:] != first[:-1])
            at = np.flatnonzero(new)
            spread, second, first = spread[at], second[at], first[at]
            runs = np.diff(np.append(at, n)).astype(np.uint32)
            own = np.add.reduceat(train[text].astype(np.int64), at).astype(np.uint32)
            pair = words_.pair(pair_hash(uniques[first], uniques[second]))
            # The texts of hot bigrams stay with the block.
            stay = np.repeat(pair >= 0, runs)
            held = np.flatnonzero(pair >= 0)
            yield _row(int(mix(np.array([block], np.uint64))[0] % U(parts)), _TEXTS, block, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), length, valid, _bytes(pair[held].astype(np.uint32), runs[held]), text[stay])
            text = text[~stay]
            sent = np.where(pair >= 0, 0, runs).astype(np.uint32)
            begin = np.concatenate([[0], np.cumsum(sent, dtype=np.int64)])
            cuts = _slices(spread, parts * slices)
            for part in range(parts):
                edges = cuts[part * slices : (part + 1) * slices + 1]
                a, b = edges[0], edges[-1]
                if a == b:
                    continue
                change = np.flatnonzero(np.concatenate([[True], (second[a + 1 : b] != second[a : b - 1]) | (spread[a + 1 : b] != spread[a : b - 1])]))
                packed2, rare2 = words_.packed(uniques[second[a:b][change]])
                packed1, rare1 = words_.packed(uniques[first[a:b]])
                # Where each slice begins: in second words, rare ones of them, first words, rare ones of them.
                cut1 = np.array(edges, np.int64) - a
                cut2 = np.searchsorted(change, cut1)
                before = lambda rare, cut: np.concatenate([[0], np.cumsum(rare)])[cut]
                head = np.stack([cut2, before(rare2, cut2), cut1, before(rare1, cut1)]).astype(np.uint32)
                yield _row(part, _BIGRAMS, block, head.ravel(), packed2, _small(np.diff(np.append(change, b - a))), packed1, _small(own[a:b]))
                if begin[b] > begin[a]:
                    yield _row(part, _HOLDERS, block, np.array([len(train)], np.uint32), _small(sent[a:b]), text[begin[a] : begin[b]])

    return texts.mapInArrow(run, _PACKED)


def _count_bucket(shared, slices: int, part: int, rows):
    """A bucket's part of the bigram table, and for the texts of each block sums, counts and unseen bigrams."""
    words_ = shared.value
    known_w, known_c, blocks, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], {}, None
    for row in rows:
        _, kind, block, a, b, c, d, e = row
        if kind == _KNOWN:
            known_w.append(np.frombuffer(a, np.uint64))
            known_c.append(np.frombuffer(b, np.int64))
        elif kind == _BIGRAMS:
            head = np.frombuffer(a, np.uint32).reshape(4, slices + 1).astype(np.int64)
            blocks[block] = (head, b, _numbers(c, head[0, -1]), d, _numbers(e, head[2, -1]))
        elif kind == _TEXTS:
            yield _row(part, _TEXTS, block, *(np.frombuffer(x, np.uint8) for x in (a, b, c, d, e)))
        else:
            if counts is None:
                counts = yield from _count_slices(words_, slices, part, blocks, np.concatenate(known_w), np.concatenate(known_c))
            yield from _answers(words_, part, block, blocks[block], *counts[block], int(np.frombuffer(a, np.uint32)[0]), _numbers(b, blocks[block][0][2, -1]), np.frombuffer(c, np.uint16))
            del blocks[block], counts[block]
    if counts is None and blocks:
        yield from _count_slices(words_, slices, part, blocks, np.concatenate(known_w), np.concatenate(known_c))


def _count_slices(words_: _Words, slices: int, part: int, blocks: dict, known_w: np.ndarray, known_c: np.ndarray):
    """Counts the bigrams slice by slice; returns for each block its bigrams' counts and those of their second words."""
    order = np.argsort(known_w)
    known_w, known_c = known_w[order], known_c[order]
    number = np.uint32 if words_.total < 1 << 32 else np.int64
    out = {block: (np.zeros(len(x[4]), number), np.zeros(len(x[4]), number)) for block, x in blocks.items()}
    for s in range(slices):
        twos, ones, owns, where = [], [], [], []
        for block, (head, second, runs, first, own) in blocks.items():
            (c2, r2, c1, r1), (to2, _, to1, _) = head[:, s].tolist(), head[:, s + 1].tolist()
            if c1 == to1:
                continue
            twos.append(np.repeat(words_.unpacked(second, int(head[0, -1]), c2, to2, r2), runs[c2:to2]))
            ones.append(words_.unpacked(first, int(head[2, -1]), c1, to1, r1))
            owns.append(own[c1:to1])
            where.append((block, c1, to1))
        if not where:
            continue
        two, one, own = np.concatenate(twos), np.concatenate(ones), np.concatenate(owns)
        del twos, ones, owns
        key = pair_hash(one, two)
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(own[order].astype(np.int64), at)
        head = order[at]  # one of each bigram
        two_, one_ = two[head], one[head]
        # The second word's own count: sent along, or known to all.
        code = words_.code(two_)
        hot = code >= 0
        c2 = np.zeros(len(two_), np.int64)
        c2[hot] = words_.count[code[hot]]
        if len(known_w):
            place = np.minimum(np.searchsorted(known_w, two_[~hot]), len(known_w) - 1)
            c2[~hot] = np.where(known_w[place] == two_[~hot], known_c[place], 0)
        count, of_second = np.empty(len(key), number), np.empty(len(key), number)
        size = np.diff(np.append(at, len(key)))
        count[order], of_second[order] = np.repeat(total, size), np.repeat(c2, size)
        begin = 0
        for block, a, b in where:
            out[block][0][a:b], out[block][1][a:b] = count[begin : begin + b - a], of_second[begin : begin + b - a]
            begin += b - a
        pair = words_.pair(key[at])
        mine = np.flatnonzero(pair >= 0)
        if len(mine):
            yield _row(part, _PAIRS, 0, pair[mine], total[mine], c2[mine], two_[mine] == END)
        # The table, second word by second word.
        seen = np.flatnonzero(total > 0)
        seen = seen[np.argsort(two_[seen], kind="stable")]
        if len(seen):
            change = np.flatnonzero(np.concatenate([[True], two_[seen][1:] != two_[seen][:-1]]))
            runs = np.diff(np.append(change, len(seen))).astype(np.uint32)
            of_counts = np.bincount(np.minimum(total[seen], K + 2), minlength=K + 3)
            yield _row(part, _TABLE, 0, words_.packed(two_[seen][change])[0], runs, words_.packed(one_[seen])[0], total[seen], np.concatenate([of_counts, c2[seen][change]]).astype(np.int64))
    return out


def _answers(words_: _Words, part: int, block: int, bigrams: tuple, count: np.ndarray, c2: np.ndarray, n_texts: int, runs: np.ndarray, text: np.ndarray):
    """What a block's texts get from one bucket."""
    head, second, runs2, first, _ = bigrams
    ends = np.repeat(words_.unpacked(second, int(head[0, -1])) == END, runs2)
    base, value = words_.shares(count.astype(np.float64), c2.astype(np.float64), ends)
    rows = np.repeat(np.arange(len(runs)), runs)
    has = np.flatnonzero(np.bincount(text, minlength=n_texts))
    add = lambda x: np.bincount(text, weights=x, minlength=n_texts)[has]
    small = count[rows]
    by_count = np.bincount(text.astype(np.int64) * (K + 1) + np.where(small <= K, small, 0), minlength=n_texts * (K + 1)).reshape(n_texts, K + 1)[has]
    by_count[:, 0] = add(c2[rows] > 0)
    yield _row(part, _SUMS, block, has.astype(np.uint16), add(base[rows]), add(value[rows]), by_count.astype(np.uint32))
    lost = np.flatnonzero(small == 0)
    if len(lost):
        yield _row(part, _UNSEEN, block, words_.packed(words_.unpacked(first, int(head[2, -1]))[rows[lost]])[0], text[lost])


def contexts(tables: DataFrame, shared, star: np.ndarray) -> DataFrame:
    """(v, weight): log10 of alpha(v) c(v) of every word that begins a seen bigram, from the bigram table."""

    def run(batches):
        words_ = shared.value
        for _, _, _, _, b, c, d, e in _rows(batches):
            count = np.frombuffer(d, np.int64).astype(np.float64)
            one = words_.unpacked(c, len(count))
            covered = np.repeat(words_.probability(np.frombuffer(e, np.int64)[K + 3 :].astype(np.float64)), np.frombuffer(b, np.uint32))
            u, inverse = np.unique(one, return_inverse=True)
            freed, covered = np.bincount(inverse, weights=count - _star(count, star)), np.bincount(inverse, weights=covered)
            yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(freed), pa.array(covered)], ["v", "freed", "covered"])

    shares = tables.where(F.col("kind") == _TABLE).mapInArrow(run, "v long, freed double, covered double")
    least = F.lit(1e-300)
    summed = shares.groupBy("v").agg(F.sum("freed").alias("freed"), F.sum("covered").alias("covered"))
    return summed.select("v", F.log10(F.greatest("freed", least) / F.greatest(1 - F.col("covered"), least)).alias("weight"))


def _sum_row(block: int, text: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    has, inverse = np.unique(text, return_inverse=True)
    return _row(0, _SUMS, block, has.astype(np.uint16), np.zeros(len(has)), np.bincount(inverse, weights=weight, minlength=len(has)), np.zeros((len(has), K + 1), np.uint32))


def _unseen_answers(tables: DataFrame, weights: DataFrame, shared, parts: int) -> DataFrame:
    """The context weights of unseen bigrams, added up by text: hot contexts from a broadcast, the others by a join."""
    spark = tables.sparkSession

    def hot(batches):
        words_ = shared.value
        for batch in batches:
            code = words_.code(batch.column("v").to_numpy().view(np.uint64))
            mine = pa.array(code >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)).filter(mine), batch.column("weight").filter(mine)], ["code", "weight"])

    known = np.zeros(len(shared.value.hash))  # the hot words and the start
    found = weights.mapInArrow(hot, "code int, weight double").toArrow()
    known[found.column("code").to_numpy()] = found.column("weight").to_numpy()
    hot_weights = spark.sparkContext.broadcast(known)
    unseen = tables.where(F.col("kind") == _UNSEEN)

    def hot_answers(batches):
        words_ = shared.value
        for _, _, block, a, b, _, _, _ in _rows(batches):
            text = np.frombuffer(b, np.uint16)
            code = words_.code(words_.unpacked(a, len(text)))
            ok = code >= 0
            if ok.any():
                yield _sum_row(block, text[ok], hot_weights.value[code[ok]])

    def plain(batches):
        words_ = shared.value
        for _, _, block, a, b, _, _, _ in _rows(batches):
            text = np.frombuffer(b, np.uint16)
            first = words_.unpacked(a, len(text))
            rare = words_.code(first) < 0
            if not rare.any():
                continue
            both, n = np.unique(np.stack([first[rare], text[rare].astype(np.uint64)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(both[0].copy())), pa.array(np.full(len(n), block)), pa.array(both[1].astype(np.int32)), pa.array(n)], ["v", "block", "text", "n"])

    def packed(batches):
        for batch in batches:
            block, text, weight = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            for a, b in zip(cut, np.append(cut[1:], len(block)), strict=True):
                yield _sum_row(int(block[a]), text[a:b], weight[a:b])

    # An unknown context has no bigrams and no row: weight 1.
    met = unseen.mapInArrow(plain, "v long, block long, text int, n long").join(weights, "v").groupBy("block", "text").agg(F.sum(F.col("weight") * F.col("n")).alias("weight"))
    return unseen.mapInArrow(hot_answers, _PACKED).unionByName(met.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(packed, _PACKED))


def score(docs: DataFrame, buckets: int | None = None, slices: int | None = None, hot: int = HOT, pairs: int = PAIRS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text, train).

    `hot` (16 million at most) and `pairs` bound the words and bigrams known to all tasks.
    """
    spark: SparkSession = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    every = stored(token_counts(texts, pairs, block_bytes))
    counts = every.where("kind = 0")
    facts = counts.agg(F.sum("c"), F.count("*"), *(F.sum((F.col("c") == r).cast("long")) for r in range(1, K + 2))).first()
    total, distinct = int(facts[0] or 0), int(facts[1])
    n_r = [float(x or 0) for x in facts[2:]]
    star = discounts([0.0, *n_r])
    small = sum(r * n for r, n in zip(range(1, K + 1), n_r, strict=False))
    rest = small - sum(s * n for s, n in zip(star[1:], n_r, strict=False)) + BIG * (distinct - sum(n_r[:K]))  # counts freed for unknown words
    # No more than `hot` words and `pairs` bigrams can reach these shares of the tokens.
    hot_words = counts.where(F.col("c") * hot >= total).select("w", "c").toArrow()
    hot_pairs = [r["w"] for r in every.where("kind = 1").where(F.col("c") * pairs >= total).select("w").collect()]
    training_texts = texts.where("train").count()
    start = int(START) - (1 << 64) if int(START) >= 1 << 63 else int(START)
    shared = spark.sparkContext.broadcast(_Words(np.append(hot_words.column("w").to_numpy(), start), np.append(hot_words.column("c").to_numpy(), training_texts), hot_pairs, total, distinct, star, max(rest, 1e-12)))
    parts = buckets or max(shuffles // 4, -(-total // BUCKET_TOKENS), 1)
    slices = slices or max(1, -(-total // (parts * SLICE_TOKENS)))

    def known(batches):
        words_ = shared.value
        for batch in batches:
            w = batch.column("w").to_numpy().view(np.uint64)
            c = batch.column("c").to_numpy()
            rare = words_.code(w) < 0
            w, c = w[rare], c[rare]
            where = (mix(w) % U(parts * slices)).astype(np.int64) // slices
            order = np.argsort(where, kind="stable")
            cuts = _slices(where[order], parts)
            for p in range(parts):
                mine = order[cuts[p] : cuts[p + 1]]
                if len(mine):
                    yield _row(p, _KNOWN, 0, w[mine], c[mine])

    sent = _deal_bigrams(texts, shared, parts, slices, block_bytes).unionByName(counts.select("w", "c").mapInArrow(known, _PACKED))
    tables = stored(_grouped(sent, parts, "part", lambda part, rows: _count_bucket(shared, slices, part, rows), _PACKED))

    def count_counts(batches):
        for r in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(r[7], np.int64)[: K + 3].tolist()], pa.list_(pa.int64()))], ["n"])

    bigram_n = tables.where(F.col("kind") == _TABLE).mapInArrow(count_counts, "n array<long>").agg(*(F.sum(F.col("n")[r]) for r in range(1, K + 2))).first()
    bigram_star = np.array(discounts([0.0, *(float(x or 0) for x in bigram_n)]))
    weights = stored(contexts(tables, shared, bigram_star))
    # Hot bigrams' counts: `pairs` entries at most, in a row for each slice that has some.
    pair_count, pair_c2, pair_end = np.zeros(len(hot_pairs)), np.zeros(len(hot_pairs)), np.zeros(len(hot_pairs), bool)
    for r in tables.where(F.col("kind") == _PAIRS).select("a", "b", "c", "d").toLocalIterator():
        at = np.frombuffer(r["a"], np.int64)
        pair_count[at], pair_c2[at], pair_end[at] = np.frombuffer(r["b"], np.int64), np.frombuffer(r["c"], np.int64), np.frombuffer(r["d"], bool)
    base_of, value_of = shared.value.shares(pair_count, pair_c2, pair_end)
    of_pairs = spark.sparkContext.broadcast((pair_count.astype(np.int64), pair_c2, base_of, value_of))
    log_star, log_start = np.log10(np.maximum(bigram_star, 1e-300)), float(np.log10(max(training_texts, 1)))

    def add_up(_, rows):
        """One block's texts: its own row comes first."""
        _, kind, block, a, b, c, d, e = next(rows)
        if kind != _TEXTS:
            raise RuntimeError(f"block {block} has no texts")
        ids, length, valid = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(c, bool)
        n = len(ids)
        held = np.frombuffer(d, np.uint32).reshape(2, -1)
        pair, text = np.repeat(held[0], held[1]), np.frombuffer(e, np.uint16)
        count, c2, base_p, value_p = (x[pair] for x in of_pairs.value)
        base, value = (np.bincount(text, weights=x, minlength=n).astype(float) for x in (base_p, value_p))
        by_count = np.bincount(text.astype(np.int64) * (K + 1) + np.where(count <= K, count, 0), minlength=n * (K + 1)).reshape(n, K + 1).astype(float)
        by_count[:, 0] = np.bincount(text, weights=c2 > 0, minlength=n)
        for r in rows:
            at = np.frombuffer(r[3], np.uint16)
            base[at] += np.frombuffer(r[4], np.float64)
            value[at] += np.frombuffer(r[5], np.float64)
            by_count[at] += np.frombuffer(r[6], np.uint32).reshape(-1, K + 1)
        out = value + by_count[:, 1:] @ log_star[1:] - log_start if total else np.zeros(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), pa.array(length), pa.array(by_count[:, 0].astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(out)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sums = tables.where(F.col("kind").isin(_SUMS, _TEXTS)).unionByName(_unseen_answers(tables, weights, shared, shuffles))
    done = _grouped(sums, shuffles, "block", add_up, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind_of_id))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (fold != 0).alias("train"))
    scored = score(docs)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLES: dict[str, str] = {}
