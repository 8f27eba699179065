r"""Token counts by a linear longest-match automaton.

Word-piece tokenizers cut a word greedily: the longest piece that starts it, then the longest that starts the rest.
Instead of trying lengths, one pass suffices over a trie of the pieces with failure links: where no child fits, the
automaton pops the pieces that the greedy cut has made certain and goes on at the node of what is left. Only the number
of popped pieces is kept at each node, so the pass counts tokens and builds none.

The vocabulary's pieces are byte strings; a word is led by `marker` (pieces that start words begin with it), and bytes
that no piece covers are tokens of their own (byte fallback), so every word can be cut. Failure links are resolved into
one table of 2^8 * next node + popped pieces by node and byte. Each chunk's different words are stepped through
together, a byte at a time, and their counts are added up for each text.

Words are runs of [^\x20\x09-\x0D], with their case. The vocabulary file is a parameter that every worker opens.

Defined results: a null, empty or wordless text has 0 words and 0 tokens; repeated rows get a row each; an empty table
gives an empty table; extra columns are kept and those named like results replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortflow.llm._text import SPACE, exact_ids, span_hashes, text_chunks, words

MARKER = "▁".encode()


class LongestMatch:
    """The automaton of a set of pieces."""

    def __init__(self, pieces, marker: bytes = MARKER):
        child: list[dict[int, int]] = [{}]
        token = [False]
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            v = 0
            for b in piece:
                to = child[v].get(b)
                if to is None:
                    to = child[v][b] = len(child)
                    child.append({})
                    token.append(False)
                v = to
            token[v] = True
        n = len(child)
        fail, popped = [0] * n, [0] * n
        order = list(child[0].values())
        for v in order:
            popped[v] = 1  # single bytes are always tokens
        for p in order:
            for b, v in child[p].items():
                order.append(v)
                if token[v]:
                    popped[v] = 1
                    continue
                z, count = fail[p], popped[p]
                while b not in child[z]:
                    count += popped[z]
                    z = fail[z]
                fail[v], popped[v] = child[z][b], count
        if n >= 1 << 23 or max(popped) > 255:
            raise ValueError("the vocabulary is too large for one table")
        table = np.zeros((n, 256), np.int32)
        self.end = np.zeros(n, np.int64)
        table[0, list(child[0])] = [v << 8 for v in child[0].values()]
        for v in order:
            table[v] = table[fail[v]] + popped[v]
            if child[v]:
                table[v, list(child[v])] = [to << 8 for to in child[v].values()]
            self.end[v] = popped[v] + self.end[fail[v]]
        self.table = table.ravel()
        self.start, self.led = 0, 0
        for b in marker:
            to = int(table[self.start, b])
            self.start, self.led = to >> 8, self.led + (to & 255)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word."""
        order = np.argsort(starts - ends, kind="stable")
        s, size = starts[order], (ends - starts)[order]
        state = np.full(len(s), self.start, np.int64)
        total = np.full(len(s), self.led, np.int64)
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), "right")
        for t, a in enumerate(active.tolist()):
            step = self.table[(state[:a] << 8) + data[s[:a] + t]]
            total[:a] += step & 255
            state[:a] = step >> 8
        out = np.empty(len(s), np.int64)
        out[order] = total + self.end[state]
        return out


def piece_file(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


_open: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    """The automaton of the file's pieces, built once by each worker."""
    if path not in _open:
        _open.clear()
        _open[path] = LongestMatch(piece_file(path))
    return _open[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with n_words and n_tokens of each text."""
    docs = docs.drop("n_words", "n_tokens")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        m = automaton(path)
        for batch in batches:
            n_words, n_tokens = [], []
            for _, _, data, offsets in text_chunks(batch.column("text")):
                _, s, e, counts = words(data, offsets, SPACE)
                codes, first = exact_ids(data, s, e, span_hashes(data, s, e))
                sums = np.concatenate([[0], np.cumsum(m.count(data, s[first], e[first])[codes])])
                edges = np.concatenate([[0], np.cumsum(counts)])
                n_words.append(counts)
                n_tokens.append(np.diff(sums[edges]))
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([none, *n_words])), pa.array(np.concatenate([none, *n_tokens]))], [*batch.schema.names, "n_words", "n_tokens"])

    return docs.mapInArrow(run, f"{schema}, n_words long, n_tokens long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, default_path()).drop("text")


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
