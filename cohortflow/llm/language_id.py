r"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of its labelled text. A text is then parsed, from left to
right, into the longest pieces that occur somewhere in the sample: the automaton follows the text until it has no
transition, one phrase ends there and the next begins at its start state. A language close to the text's needs few,
long phrases. A phrase is worth log2 of the sample's size in bits (a pointer into it), so samples of unequal size
compare; the language with the fewest bits for each symbol wins.

Texts are lower-cased; runs of characters that aren't letters are one blank. Every letter of the samples is a symbol of
its own; one that a sample lacks is a phrase by itself. The transitions of all automata are one open hash table of
(state, symbol), so its size follows the samples and not the alphabet.

Texts are parsed whole and exactly, though in lanes of LANE symbols: numpy steps through all lanes of a chunk and all
languages together, each lane as if a phrase began with it. Then the state that the lane before really ends in is
carried on: a lane is parsed again from there until a phrase begins where one began before, for from that place on both
parses are the same. If that never happens in the lane, its new last state is carried on in turn.

The samples are bounded: SAMPLE_DOCS rows of each language, those with the smallest hash of doc_id, and ALL_DOCS in all,
dealt evenly over the languages, of which the ALL_DOCS most frequent can be learned. Their whole texts are all that is
sent to the tasks; each worker builds the automata once.

Defined results: a null text or one without a letter is `und` with score 0; without labelled text everything is; a
null doc_id is neither learned from nor held out; ties go to the first language in order; repeated rows get a row each and
are learned from once; texts of any length are parsed whole; an empty table gives an empty result; extra columns are kept,
those named like the results replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cohortflow.llm._text import CHUNK_BYTES, U, text_chunks

SAMPLE_DOCS, ALL_DOCS = 48, 512
LANE = 512
#: How fast certainty grows with the bits that a text of at least so many symbols saves.
SHARPNESS, FULL = 12.0, 200

_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, and its lower-case form."""
    if "letter" not in _tables:
        chars = [chr(c) for c in range(0x110000)]
        _tables["letter"] = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
        _tables["lower"] = np.fromiter((ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars), np.uint32, len(chars))
    return _tables["letter"], _tables["lower"]


def _points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def normalised(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased letters and single blanks of all texts, their number in each, number of letters in each)."""
    letter, lower = _letters()
    is_letter = letter[points]
    low = np.where(is_letter, lower[points], 32)
    keep = is_letter.copy()
    opens = np.zeros(len(points) + 1, bool)
    opens[edges] = True
    keep[1:] |= ~is_letter[1:] & is_letter[:-1] & ~opens[1 : len(points)]
    sums = np.concatenate([[0], np.cumsum(keep)])[edges]
    letters = np.concatenate([[0], np.cumsum(is_letter)])[edges]
    return low[keep], np.diff(sums), np.diff(letters)


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of text; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return follow


class CrossParser:
    """The automata of all languages: a hash table of (state, symbol), and where a phrase that begins with a symbol leads."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(k for k, v in samples.items() if v)
        texts = [_points(samples[k].encode()) for k in self.langs]
        letters = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint32)
        self.n_symbols = len(letters) + 1  # the last one is every letter that no sample holds
        self.symbol = np.full(0x110000, len(letters), np.int32)
        self.symbol[letters] = np.arange(len(letters))
        self.bits = np.array([float(np.log2(max(2, len(t)))) for t in texts])
        # State 0 leads nowhere: before the first phrase, and after a symbol that the language lacks.
        self.first = np.zeros((len(texts), self.n_symbols), np.int64)
        keys, to, offset = [], [], 1
        for lang, points in enumerate(texts):
            follow = suffix_automaton(self.symbol[points].tolist())
            degree = [len(f) for f in follow]
            symbol = np.fromiter((c for f in follow for c in f), np.int64, sum(degree))
            target = np.fromiter((t for f in follow for t in f.values()), np.int64, len(symbol)) + offset
            self.first[lang, symbol[: degree[0]]] = target[: degree[0]]
            keys.append((np.repeat(np.arange(len(follow)), degree) + offset) * self.n_symbols + symbol)
            to.append(target)
            offset += len(follow)
        self._fill(np.concatenate(keys) if keys else np.zeros(0, np.int64), np.concatenate(to) if to else np.zeros(0, np.int64))

    def _fill(self, keys: np.ndarray, to: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32 if len(keys) < 1 << 30 else np.int64)
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[free]
            mine = self.keys[place] == keys
            self.to[place[mine]] = to[mine]
            keys, to, place = keys[~mine], to[~mine], (place[~mine] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins with the symbol)."""
        key = state * self.n_symbols + symbol
        place = self._place(key)
        found = self.keys[place]
        out = self.to[place].astype(np.int64)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            place[left] = (place[left] + 1) & self.mask
            found[left] = self.keys[place[left]]
            out[left] = self.to[place[left]]
            left = left[(found[left] != key[left]) & (found[left] >= 0)]
        begins = found != key
        out[begins] = self.first[lang[begins], symbol[begins]]
        return out, begins

    def phrases(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How many phrases each text (its symbols follow each other) has in each language."""
        n_langs = len(self.langs)
        lanes = -(-counts // LANE)
        text = np.repeat(np.arange(len(counts)), lanes)
        ends = np.cumsum(counts)
        index = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (ends - counts)[text] + index * LANE
        size = np.minimum(ends[text] - begin, LANE)
        order = np.argsort(-size, kind="stable")
        begin, size, text, index = begin[order], size[order], text[order], index[order]
        after = np.full(len(order) + 1, -1)  # the lane that goes on where one ends
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        after[where[:-1]] = np.where(index[where[1:]] > 0, where[1:], -1) if len(where) > 1 else -1
        n, steps = len(order), int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
        lang = np.tile(np.arange(n_langs), n)
        state = np.zeros(n * n_langs, np.int64)
        began: list[np.ndarray] = []  # for each step, the lanes that reach it
        for t in range(steps):
            a = int(active[t])
            state[: a * n_langs], begins = self.step(state[: a * n_langs], np.repeat(symbols[begin[:a] + t], n_langs).astype(np.int64), lang[: a * n_langs])
            began.append(begins)
        # Carry states on, to all lanes that follow another at first, then wherever a lane ends differently.
        item = np.flatnonzero(np.repeat(index > 0, n_langs))
        before = np.full(n, -1)
        before[after[:n][after[:n] >= 0]] = np.flatnonzero(after[:n] >= 0)
        while len(item):
            lane, own = item // n_langs, lang[item]
            now = state[before[lane] * n_langs + own]
            again = np.zeros(len(item), bool)  # parsed to the lane's end without meeting the old parse
            live = np.arange(len(item))
            for t in range(steps):
                done = size[lane[live]] <= t
                again[live[done]] = True
                live = live[~done]
                if not len(live):
                    break
                to, begins = self.step(now[live], symbols[begin[lane[live]] + t].astype(np.int64), own[live])
                old = began[t][item[live]]
                began[t][item[live]] = begins
                now[live] = to
                live = live[~(begins & old)]
            again[live] = True
            moved = np.flatnonzero(again)
            moved = moved[state[item[moved]] != now[moved]]
            state[item[moved]] = now[moved]
            following = after[lane[moved]]
            item = (following * n_langs + own[moved])[following >= 0]
        found = np.zeros(n * n_langs)
        for begins in began:
            found[: len(begins)] += begins
        total = np.zeros((len(counts), n_langs))
        np.add.at(total, text, found.reshape(n, n_langs))
        return total

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits for each symbol of each text in each language; letters; symbols)."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points, counts, letters = normalised(_points(data.tobytes()), np.searchsorted(at, offsets))
        return self.phrases(self.symbol[points], counts) * self.bits / np.maximum(counts, 1)[:, None], letters, counts


_parsers: dict[int, CrossParser] = {}


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, all_docs: int = ALL_DOCS) -> dict[str, str]:
    """A sample of normalised text for each language of `labelled` (doc_id, text, lang)."""
    spark = labelled.sparkSession
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(all_docs).collect()
    if not sizes:
        return {}
    quota = max(1, min(sample_docs, all_docs // len(sizes)))
    # A hash threshold for each language, somewhat above its share: all_docs rows at most, and few of the table pass.
    shares = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, (1.5 * quota + 20) / r["n"])) for r in sizes], "lang string, share double"))
    position = (F.xxhash64("doc_id").cast("double") + float(1 << 63)) / float(1 << 64)
    near = usable.join(shares, "lang").where(position <= F.col("share")).groupBy("lang", "doc_id").agg(F.min("h").alias("h"), F.min(position).alias("position"))
    by_lang: dict[str, list] = {}
    for r in sorted(near.collect(), key=lambda r: (r["lang"], r["position"], r["doc_id"])):
        own = by_lang.setdefault(r["lang"], [])
        if len(own) < quota:
            own.append((r["lang"], r["doc_id"], r["h"]))
    kind = labelled.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame([x for own in by_lang.values() for x in own], f"lang string, doc_id {kind}, h long"))
    texts = {(r["lang"], r["doc_id"]): r["text"] for r in usable.join(chosen, ["lang", "doc_id", "h"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()}

    def clean(text: str) -> str:
        points = _points(text.encode())
        return normalised(points, np.array([0, len(points)]))[0].astype(np.uint32).tobytes().decode("utf-32-le")

    return {lang: " ".join(clean(texts[lang, i]) for _, i, _ in own) for lang, own in by_lang.items()}


def predict(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """`docs` with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches):
        known = shared.value
        key = hash(tuple(sorted(known.items())))
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = CrossParser(known)
        parser = _parsers[key]
        langs = np.array([*parser.langs, "und"], dtype=object)
        for batch in batches:
            names, scores = [], []
            for first, last, data, offsets in text_chunks(batch.column("text"), min(CHUNK_BYTES, 4 * CHUNK_BYTES // max(1, len(parser.langs)))):
                if not parser.langs:
                    names += ["und"] * (last - first)
                    scores.append(np.zeros(last - first))
                    continue
                cost, letters, symbols = parser.costs(data, offsets)
                best = np.argmin(cost, axis=1)
                sharp = SHARPNESS * np.minimum(symbols, FULL)[:, None] / FULL
                share = 1 / np.exp(-sharp * (cost - cost.min(axis=1, keepdims=True))).sum(axis=1)
                best[letters == 0] = len(parser.langs)
                names += langs[best].tolist()
                scores.append(np.where(letters == 0, 0.0, share))
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(flat)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    samples = learn(docs.select("doc_id", "text", "lang").where(fold != 1))
    return predict(docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text"), samples).drop("text")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
