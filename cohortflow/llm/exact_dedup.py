r"""Exact dedup by Grace hash partitioning.

Texts are equal when they are identical after each run of [\x20\x09-\x0D] became one space; null counts as empty. No hash
decides that: an open-addressing table compares complete contents, and hashes only choose buckets and slots.

1. Every task folds its own rows first: a table of at most `budget` bytes of content finds equal texts among them. Of each
   group the task writes one row with the content and one small row per document, to a table in the shared folder. A text
   that a third of all rows hold is thus one row a task, and nothing travels twice.
2. The rows with content are hash-partitioned into buckets, as many as their measured size asks for. A task fills the
   bucket's table up to the budget. Contents already in the table are merged; when it is full, records of other contents
   are spilled to a table in the shared folder, and the next level partitions them anew by other bits of the hash. Levels
   go on until nothing is spilled; each resolves a full table a bucket, so they end even if all contents share one hash.
3. Each document learns its group's verdict by the number of the group that its task gave it: a join on small rows, whose
   keys are as even as the tasks of step 1.

Spill files are Spark tables in spark.checkpoint.dir, so a lost executor costs the tasks it ran and no more.

Defined results: null and empty texts are equal to each other; a null doc_id stays only if no row of its text has an id,
and then one such row stays; of rows that repeat a doc_id and a text one stays; an empty table gives an empty result; a
text of any length is one content, even beyond the budget (a table takes at least one); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm._text import give_back, stored

#: Bytes of content that one table holds.
BUDGET = 64 << 20

_FOLDED = "doc_id long, rid long, grp long, sha binary, hash long, content binary, n long, low_id long, low_rid long"
_VERDICT = "grp long, keep_id long, keep_rid long, group_size long, spilled boolean, hash long, content binary, n long, low_id long, low_rid long"


class ContentTable:
    """Open addressing with linear probing; entries are known by their complete content."""

    def __init__(self, budget: int):
        self.budget, self.size = budget, 0
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def find(self, h: int, content: bytes) -> int:
        """The entry of this content, made if there is room, else -1."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = at + 1 & mask
        if self.contents and self.size + len(content) > self.budget:
            return -1
        slots[at] = entry = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.size += len(content) + 200  # what an entry takes beside its content
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = at + 1 & mask
            slots[at] = entry


def _digests(texts: pa.Array) -> Iterator[tuple[bytes, bytes, int]]:
    """(content, SHA-256, 64-bit hash) of each text."""
    plain = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[ \t-\r]+", " ")
    for x in plain.cast(pa.large_binary()):
        content = x.as_py()
        sha = hashlib.sha256(content).digest()
        yield content, sha, int.from_bytes(sha[:8], "little", signed=True)


def _lower(a: tuple, b: tuple) -> tuple:
    """The smaller (doc_id, rid), null ids last."""
    return min(a, b, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_LONG, _BYTES = pa.int64(), pa.binary()
_FOLDED_ARROW = pa.schema([("doc_id", _LONG), ("rid", _LONG), ("grp", _LONG), ("sha", _BYTES), ("hash", _LONG), ("content", _BYTES), ("n", _LONG), ("low_id", _LONG), ("low_rid", _LONG)])
_VERDICT_ARROW = pa.schema([("grp", _LONG), ("keep_id", _LONG), ("keep_rid", _LONG), ("group_size", _LONG), ("spilled", pa.bool_()), ("hash", _LONG), ("content", _BYTES), ("n", _LONG), ("low_id", _LONG), ("low_rid", _LONG)])

#: Bytes of content in one batch that a task writes.
_OUT = 8 << 20


def folded(docs: DataFrame, budget: int) -> DataFrame:
    """Step 1: a row per document with its group's number; one row of each group also has the content, its number of
    rows and the smallest document."""

    def run(batches):
        base = TaskContext.get().partitionId() << 36
        rid = grp = base

        def flush(table, members, lows, sizes):
            nonlocal grp
            seen, out, held = set(), [], 0
            for doc_id, r, entry, sha in members:
                if entry in seen:
                    out.append((doc_id, r, grp + entry, sha, None, None, None, None, None))
                else:
                    seen.add(entry)
                    content = table.contents[entry]
                    out.append((doc_id, r, grp + entry, sha, table.hashes[entry], content, sizes[entry], *lows[entry]))
                    held += len(content)
                if held > _OUT or len(out) >= 10_000:
                    yield _batch(out, _FOLDED_ARROW)
                    out, held = [], 0
            if out:
                yield _batch(out, _FOLDED_ARROW)
            grp += len(table.contents)
            give_back()

        table, members, lows, sizes = ContentTable(budget), [], [], []
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, (content, sha, h) in zip(ids, _digests(batch.column("text")), strict=True):
                entry = table.find(h, content)
                if entry < 0:
                    yield from flush(table, members, lows, sizes)
                    table, members, lows, sizes = ContentTable(budget), [], [], []
                    entry = table.find(h, content)
                if entry == len(lows):
                    lows.append((doc_id, rid))
                    sizes.append(0)
                lows[entry] = _lower(lows[entry], (doc_id, rid))
                sizes[entry] += 1
                members.append((doc_id, rid, entry, sha))
                rid += 1
        yield from flush(table, members, lows, sizes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _FOLDED)


def _bucket(records: DataFrame, parts: int, level: int, budget: int) -> DataFrame:
    """One level of step 2: verdicts of the groups whose contents found room in their bucket's table, and what was spilled."""

    def run(batches):
        table, lows, sizes, asked = ContentTable(budget), [], [], []
        spilled, held = [], 0
        for batch in batches:
            for grp, h, content, n, low_id, low_rid in zip(*(batch.column(c).to_pylist() for c in ("grp", "hash", "content", "n", "low_id", "low_rid")), strict=True):
                entry = table.find(h, content)
                if entry < 0:
                    spilled.append((grp, None, None, None, True, h, content, n, low_id, low_rid))
                    held += len(content)
                    if held > _OUT:
                        yield _batch(spilled, _VERDICT_ARROW)
                        spilled, held = [], 0
                    continue
                if entry == len(lows):
                    lows.append((low_id, low_rid))
                    sizes.append(0)
                lows[entry] = _lower(lows[entry], (low_id, low_rid))
                sizes[entry] += n
                asked.append((grp, entry))
        if spilled:
            yield _batch(spilled, _VERDICT_ARROW)
        del table
        for i in range(0, len(asked), 10_000):
            yield _batch([(grp, *lows[e], sizes[e], False, None, None, None, None, None) for grp, e in asked[i : i + 10_000]], _VERDICT_ARROW)
        give_back()

    own = records.select("grp", "hash", "content", "n", "low_id", "low_rid")
    return own.repartition(parts, F.xxhash64(F.lit(level), "hash")).mapInArrow(run, _VERDICT)


def exact_groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """A row per document: doc_id, keep_id (the smallest doc_id of its text), group_size, kept and text_sha256."""
    spark = docs.sparkSession
    rows = stored(folded(docs, budget))
    pending = rows.where("content IS NOT NULL")
    verdicts, level = None, 0
    while True:
        size = pending.agg(F.sum(F.octet_length("content") + 200).alias("bytes")).first()["bytes"] or 0
        # Half full on average, so that few buckets spill.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size // budget + 1)
        done = stored(_bucket(pending, parts, level, budget))
        settled = done.where("NOT spilled").select("grp", "keep_id", "keep_rid", "group_size")
        verdicts = settled if verdicts is None else verdicts.unionByName(settled)
        pending = done.where("spilled")
        if pending.isEmpty():
            break
        level += 1
    joined = rows.select("doc_id", "rid", "grp", "sha").join(verdicts, "grp")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The documents whose row stays, with all their columns; copies of a (doc_id, text) that stays are told apart by it."""
    found = exact_groups(docs, budget).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    plain = F.regexp_replace(F.coalesce(docs["text"].cast("string"), F.lit("")), r"[ \t-\r]+", " ")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.sha2(plain, 256) == F.col("_sha"))
    return docs.join(found, same, "left_semi").dropDuplicates(["doc_id", "text"])


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS place, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""

QUERIES = {"op11_exact_dedup": op11_exact_dedup}
ORACLES = {"op11_exact_dedup": ORACLE}
