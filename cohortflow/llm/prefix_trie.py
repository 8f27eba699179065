r"""The trie of conversation prefixes, rolled up by pointer jumping.

A node is a distinct sequence of first turns (role, text); its key is a digest of the sequence, its edge to the parent the
digest of the sequence without its last turn. Digests are an associative fold: a turn maps d to d * A + h(turn) modulo
2^127 - 1, h being a 128-bit cryptographic hash. Runs of turns compose, so conversations are range-partitioned by (id,
turn), each task folds its own run, the first and last conversation of a partition are composed on the driver (one row a
partition, whatever the input), and a conversation of a third of all rows is spread over many tasks.

Totals of subtrees take logarithmically many rounds. In round k every node that has a 2^k-th ancestor sends that ancestor
the sum over its own descendants nearer than 2^k, and learns the ancestor's ancestor: pointers double. Sums are combined
before the shuffle, nodes leave as soon as their pointer passes the root, and the messages of all rounds, added up, give
every node its subtree. The ids that end in a node are hashed in order by chunks: a range partition sorts and joins them, and
only finished chunks go to the task that runs the node's SHA-256.

Defined results: null roles and texts are empty; null turns come first; turns with equal numbers follow each other by role
and text; repeated rows are turns of their own; rows with a null conv_id belong to no conversation and are left out; a
conversation without turns after rebuilding is a member of the root only; a text of any length is one turn; an empty table
has no node, not even the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortflow.llm._text import kept, stored

P = (1 << 127) - 1
A = 0x5A7D1F3C9B2E8846A10C77F0D3B5E92B % P

#: The most turns that a conversation takes from its group's first one.
HEAD = 3

#: Ids in one chunk of a node's digest.
CHUNK_IDS = 50_000

_ORDER = ("part", "turn", "role", "text")


def _rank() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def rebuilt_rows(turns: DataFrame, group: int = 20) -> DataFrame:
    """The rows of which each conversation is rebuilt, still with all of its own turns: part 0 are the first turns of its
    group's first conversation that it takes, part 1 its own. `head` says how many of its own it gives up."""
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    # A limit of rows a group: Spark keeps three of each conversation before it shuffles.
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*_rank()))).where(F.col("place") <= HEAD)
    every = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), head.alias("head"))
    taken = every.join(first.select(F.col("conv_id").alias("base"), "place", "turn", "role", "text"), "base").where(F.col("place") <= F.col("head"))
    columns = ["conv_id", "head", "part", *_ORDER[1:]]
    return taken.withColumn("part", F.lit(0)).select(*columns).unionByName(own.withColumns({"head": head, "part": F.lit(1)}).select(*columns))


def _turn_hash(role: str, text: str) -> int:
    r = role.encode()
    return int.from_bytes(hashlib.blake2b(len(r).to_bytes(8, "little") + r + text.encode(), digest_size=16).digest(), "little") % P


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "part", "role", "text")), strict=True)


def _compose(runs: list[tuple]) -> dict[int, tuple]:
    """What is known of a partition's first conversation where the partition begins: {partition: (conv_id, own turns before,
    depth, digest)}. A run is (partition, conv_id, own turns, depths gained, digests gained), the last two for each
    number of own turns before, from 0 to HEAD."""
    known, now = {}, None
    for partition, conv, own, gained, digests in runs:
        if now is None or now[0] != conv:
            now = (conv, 0, 0, 0)
        else:
            known[partition] = now
        case = min(now[1], HEAD)
        now = (conv, now[1] + own, now[2] + gained[case], (now[3] * pow(A, gained[case], P) + int(digests[case])) % P)
    return known


def trie_rows(rows: DataFrame) -> DataFrame:
    """A row per conversation and depth, the root included: node, parent, depth, words of the last text, conv_id."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("conv_id"), F.col("part"), *_rank()]
    ordered = kept(spark, kept(spark, rows).repartitionByRange(parts, *keys).sortWithinPartitions(*keys))

    def runs(batches):
        """Of a partition's first and last conversation: what its rows here add, for each number of own turns before."""
        first = now = None
        for conv, head, part, role, text in _rows(batches):
            if now is None or now[0] != conv:
                first = first or now
                now = [conv, 0, [0] * (HEAD + 1), [0] * (HEAD + 1)]
            h = _turn_hash(role, text)
            for case in range(HEAD + 1):
                if part == 0 or case + now[1] >= head:
                    now[2][case] += 1
                    now[3][case] = (now[3][case] * A + h) % P
            now[1] += part
        at = TaskContext.get().partitionId()
        found = [x for x in (first, now) if x is not None]
        arrays = [pa.array([at] * len(found), pa.int32()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int64())), pa.array([list(map(str, x[3])) for x in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, ["at", "conv_id", "own", "gained", "digests"])

    spans = [tuple(r) for r in ordered.mapInArrow(runs, "at int, conv_id long, own long, gained array<long>, digests array<string>").toLocalIterator()]
    spans.sort(key=lambda r: r[0])  # stable: a partition's first conversation stays before its last
    known = {at: (conv, own, depth, str(digest)) for at, (conv, own, depth, digest) in _compose(spans).items()}
    shared = spark.sparkContext.broadcast(known)

    schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("conv_id", pa.int64())])

    def walk(batches):
        before = shared.value.get(TaskContext.get().partitionId())
        conv, own, depth, digest = (*before[:3], int(before[3])) if before else (None, 0, 0, 0)
        out: list[tuple] = []
        for c, head, part, role, text in _rows(batches):
            if c != conv:
                conv, own, depth, digest = c, 0, 0, 0
                out.append((_key(0, 0), None, 0, 0, c))
            if part == 0 or own >= head:
                parent, digest, depth = _key(depth, digest), (digest * A + _turn_hash(role, text)) % P, depth + 1
                out.append((_key(depth, digest), parent, depth, len(text.encode().split()), c))
            own += part
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return ordered.mapInArrow(walk, "node binary, parent binary, depth long, words long, conv_id long")


def _key(depth: int, digest: int) -> bytes:
    return digest.to_bytes(16, "little") + depth.to_bytes(8, "little")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def subtree_sums(nodes: DataFrame, values: list[str], depth: int) -> DataFrame:
    """(node, the values summed over the node's subtree): log2(depth) + 1 rounds of pointer doubling over (node, parent)."""
    spark = nodes.sparkSession
    total = nodes.select("node", *values)
    sums = lambda: [F.sum(v).alias(v) for v in values]
    active = nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("jump"), *values)
    reach = 1
    while reach <= depth:
        sent = kept(spark, active.groupBy("jump").agg(*sums()))
        total = total.unionByName(sent.withColumnRenamed("jump", "node"))
        reach *= 2
        if reach <= depth:
            beyond = active.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
            got = sent.select(F.col("jump").alias("node"), *(F.col(v).alias(f"+{v}") for v in values))
            ahead = active.join(beyond, "jump").join(got, "node", "left")
            active = kept(spark, ahead.select("node", F.col("next").alias("jump"), *((F.col(v) + F.coalesce(F.col(f"+{v}"), F.lit(0))).alias(v) for v in values)))
    return total.groupBy("node").agg(*sums())


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of each node's conv_ids, in numerical order, joined by commas."""
    spark = ends.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def join(batches):
        node, ids, first = None, [], None
        schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            out = []
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if n != node or len(ids) == CHUNK_IDS:
                    if ids:
                        out.append((node, first, ",".join(ids).encode()))
                    node, ids, first = n, [], c
                ids.append(str(c))
            if out:
                yield _batch(out, schema)
        if ids:
            yield _batch([(node, first, ",".join(ids).encode())], schema)

    def digest(batches):
        node, h = None, None
        schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n != node:
                    if h is not None:
                        out.append((node, h.hexdigest()))
                    node, h = n, hashlib.sha256(ids)
                else:
                    h.update(b"," + ids)
            if out:
                yield _batch(out, schema)
        if h is not None:
            yield _batch([(node, h.hexdigest())], schema)

    ordered = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = ordered.mapInArrow(join, "node binary, first long, ids binary")
    return chunks.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, group: int = 20) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    node's key."""
    spark = turns.sparkSession
    rows = stored(trie_rows(rebuilt_rows(turns, group)))
    facts = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words")]
    nodes = kept(spark, rows.groupBy("node").agg(*facts))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(children, "node", "left").select("*", F.coalesce("n_children", F.lit(0)).cast("long").alias("children"))
    valued = kept(spark, valued.select("node", "parent", "depth", "conv_id", "n_convs", F.col("children").alias("n_children"), (F.col("children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    depth = valued.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(valued.select("node", "parent", "leaf", "saved"), ["leaf", "saved"], depth).select("node", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = kept(spark, rows.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node")))
    # The root has a child for each first turn, so its one row is sent to all of them; other parents are met by a join.
    root = F.broadcast(valued.where("depth = 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    others = valued.where("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = valued.where("depth <= 1").join(root, "parent", "left").unionByName(valued.where("depth > 1").join(others, "parent"), allowMissingColumns=True)
    full = below.join(sums, "node").join(ends_digests(ends), "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "node")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(turns).drop("node")


ORACLE = r"""
WITH RECURSIVE crcs AS (SELECT b AS byte, 0 AS step, b::BIGINT AS v FROM range(256) r(b)
  UNION ALL SELECT byte, step + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crcs WHERE step < 8),
remainder AS (SELECT list(v ORDER BY byte) AS t FROM crcs WHERE step = 8),
ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, s, 0 AS i, 4294967295::BIGINT AS v FROM ids
  UNION ALL SELECT c, s, i + 1, xor(v // 256, (SELECT t FROM remainder)[1 + xor(v % 256, ascii(s[i + 1]))]) FROM crc WHERE i < length(s)),
heads AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE i = length(s)),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
mixed AS (SELECT heads.c, 0 AS part, i, role, text FROM heads JOIN t ON t.c = heads.c - heads.c % 20 AND i <= h UNION ALL SELECT c, 1, i, role, text FROM t JOIN heads USING (c) WHERE i > h),
numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, {'r': role, 't': text} AS turn FROM mixed),
whole AS (SELECT c, coalesce((SELECT list(turn ORDER BY d) FROM numbered n WHERE n.c = heads.c), []) AS l FROM heads),
member AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS depth FROM whole),
placed AS (SELECT c, depth, l[1:depth] AS node, CASE WHEN depth > 0 THEN l[1:depth - 1] END AS parent, depth = len(l) AS ends, CASE WHEN depth > 0 THEN len(regexp_extract_all(l[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM member),
nodes AS (SELECT node, any_value(parent) AS parent, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ids FROM placed GROUP BY node, depth),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
up AS (SELECT node[1:k] AS node, n_children, n_convs, words FROM (SELECT node, n_children, n_convs, words, unnest(range(0, depth + 1)) AS k FROM valued)),
sums AS (SELECT node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM up GROUP BY node)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ids) AS ends_sha256
FROM valued v JOIN sums USING (node) LEFT JOIN nodes p ON p.node = v.parent
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": ORACLE}
