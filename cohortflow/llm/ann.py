"""Approximate nearest neighbours by largest inner product on robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by length class (a factor of 4) and hash, and get one more component that makes all lengths of
a shard equal (its own largest one), so the largest inner product is the nearest neighbour however much longer vectors of
other shards are. A shard's graph grows in batches that double: each point of a batch is looked up by a greedy beam
search on the graph so far, and of all points met the relaxed rule keeps as neighbours the nearest one, then the nearest
of those that are not ALPHA times closer to a kept one than to the point, and so on, DEGREE at most. Edges back are added
and pruned by the same rule. An index is a table of one row per shard: vectors, edges, ids.

A search sends blocks of queries to all shards: rows of both are dealt by shard and lane, a shard's row going first, so a
task holds one shard and one block at a time. Each block is answered with a beam search on the shard's graph, numpy
stepping through all queries of the block at once. All is computed in double precision. Scores are inner products of the
original vectors; the shards' lists are merged by score, ties to the smaller vec_id.

Equal vectors are one point of the graph that carries its 21 smallest ids: more can't be among a query's 20 nearest, as
ties go to the smaller id. Nothing else is left out; every vector is indexed.

Defined results: null ids and vectors that are null, all zero, empty or hold null or non-finite components take no part;
vectors of different numbers of components never meet; repeated rows count once; an empty table gives an empty result;
extra columns are ignored whatever their names. There are no texts, so no very long ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortflow.llm._text import kept, mix

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 64
SEARCH_BEAM = 128
_WIDTH = 4  # points that a step of the search expands for each query


def _entries(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(8, n)).astype(np.int64))


def beam_search(points: np.ndarray, edges: np.ndarray, n: int, queries: np.ndarray, beam: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, closeness) of the `beam` best points found for each query, best first; place n stands for none."""
    b = len(queries)
    seen = np.zeros((b, len(points) + 1), bool)
    seen[:, n:] = True
    seen[:, entries] = True
    ids = np.full((b, beam), n, np.int64)
    near = np.full((b, beam), -np.inf)
    m = min(len(entries), beam)
    ids[:, :m] = entries[:m]
    near[:, :m] = queries @ points[entries[:m]].T
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    open_ = ids < n
    rows = np.arange(b)
    while len(rows):
        # The _WIDTH best points not expanded yet.
        rank = np.cumsum(open_[rows], axis=1)
        pick = open_[rows] & (rank <= _WIDTH)
        some = pick.any(axis=1)
        rows, pick = rows[some], pick[some]
        if not len(rows):
            break
        place = np.argsort(~pick, axis=1, kind="stable")[:, :_WIDTH]
        chosen = np.where(np.take_along_axis(pick, place, 1), np.take_along_axis(ids[rows], place, 1), n)
        open_[rows] &= ~pick
        around = edges[chosen].reshape(len(rows), -1)
        fresh = ~seen[rows[:, None], around]
        seen[rows[:, None], around] = True
        around = np.where(fresh, around, n)
        around.sort(axis=1)
        twice = np.zeros(around.shape, bool)
        twice[:, 1:] = around[:, 1:] == around[:, :-1]
        around[twice] = n
        width = int((around < n).sum(axis=1).max())
        around.sort(axis=1)
        around = around[:, :width]
        if not width:
            continue
        close = np.einsum("bwd,bd->bw", points[np.minimum(around, len(points) - 1)], queries[rows])
        close[around >= n] = -np.inf
        all_ids = np.concatenate([ids[rows], around], axis=1)
        all_near = np.concatenate([near[rows], close], axis=1)
        all_open = np.concatenate([open_[rows], around < n], axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[rows] = np.take_along_axis(all_ids, order, 1)
        near[rows] = np.take_along_axis(all_near, order, 1)
        open_[rows] = np.take_along_axis(all_open, order, 1)
    return ids, near


def robust_prune(points: np.ndarray, at: np.ndarray, candidates: np.ndarray, none: int) -> np.ndarray:
    """DEGREE diverse neighbours for each point in `at` of its row of candidates; `none` fills up.

    Distances are those of differences to the own point, so they hold among points that are close together, too.
    """
    cand = points[np.minimum(candidates, len(points) - 1)] - points[at][:, None]
    square = np.einsum("bcd,bcd->bc", cand, cand)
    far = square.copy()
    far[(candidates >= none) | (candidates == at[:, None])] = np.inf
    out = np.full((len(at), DEGREE), none, np.int64)
    rows = np.arange(len(at))
    for k in range(DEGREE):
        best = np.argmin(far, axis=1)
        ok = np.isfinite(far[rows, best])
        if not ok.any():
            break
        out[ok, k] = candidates[rows[ok], best[ok]]
        star = cand[rows, best]
        between = square + square[rows, best][:, None] - 2 * np.einsum("bcd,bd->bc", cand, star)
        far[ALPHA * ALPHA * between <= far] = np.inf
        far[rows, best] = np.inf
    return out


def build_graph(points: np.ndarray) -> np.ndarray:
    """Edges of one shard: a row of DEGREE places for each point and one for `none`, which is len(points)."""
    n = len(points)
    edges = np.full((n + 1, DEGREE), n, np.int64)
    done = min(n, DEGREE)
    edges[:done, :done] = np.where(np.eye(done, dtype=bool), n, np.arange(done))
    while done < n:
        to = min(n, done + min(done, 512))
        batch = np.arange(done, to)
        met, _ = beam_search(points, edges, n, points[batch], BUILD_BEAM, _entries(done))
        edges[batch] = robust_prune(points, batch, met, n)
        source = np.repeat(batch, DEGREE)
        target = edges[batch].ravel()
        source, target = source[target < n], target[target < n]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, first, count = np.unique(target, return_index=True, return_counts=True)
        # Targets of like numbers of new edges together, so that padding stays small.
        by_count = np.argsort(count, kind="stable")
        for a in range(0, len(who), 512):
            group = by_count[a : a + 512]
            most = int(count[group].max())
            offer = np.full((len(group), DEGREE + most), n, np.int64)
            offer[:, :DEGREE] = edges[who[group]]
            span = np.arange(most)
            offer[:, DEGREE:] = np.where(span < count[group][:, None], source[np.minimum(first[group][:, None] + span, len(source) - 1)], n)
            degree = (offer < n).sum(axis=1)
            small = degree <= DEGREE
            if small.any():
                packed = np.sort(offer[small], axis=1)[:, :DEGREE]
                edges[who[group[small]]] = packed
            if (~small).any():
                edges[who[group[~small]]] = robust_prune(points, who[group[~small]], offer[~small], n)
        done = to
    return edges


def _evened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest one's length, with the component that makes every length 1."""
    x = vectors / longest
    rest = np.sqrt(np.maximum(1 - np.einsum("nd,nd->n", x, x), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and the sum of squares of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("square", square).where("square > 0")


def _classes(rows: DataFrame, ids: int) -> DataFrame:
    """Distinct vectors with their smallest ids."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.select("vec_id", "embedding", "dim", "class").withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= ids)
    return few.groupBy("embedding", "dim", "class").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def build_index(vectors: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per shard: (shard, class, dim, n, longest, ids, vectors, edges); vectors are the original ones, as doubles.

    The lengths of a class are within a factor of 4; the median length is in the middle of its class.
    """
    spark = vectors.sparkSession
    rows = kept(spark, usable(vectors))
    middle = rows.agg(F.percentile_approx("square", 0.5)).first()[0] or 1.0
    placed = rows.withColumn("dim", F.size("embedding")).withColumn("class", F.floor((F.log2("square") - float(np.log2(middle)) + 2) / 4).cast("int"))
    # A row for each dimension and length class.
    sizes = placed.groupBy("dim", "class").agg(F.greatest(F.lit(1), F.round(F.approx_count_distinct(F.xxhash64("embedding")) / shard_rows).cast("int")).alias("shards"))
    dealt = _classes(placed, k + 1).join(F.broadcast(sizes), ["dim", "class"]).withColumn("shard", F.pmod(F.xxhash64("embedding"), "shards").cast("int"))

    def build(key, part):
        part = part.iloc[np.argsort(mix(np.fromiter((x[0] for x in part["ids"]), np.int64, len(part)).view(np.uint64)))]
        x = np.stack(part["embedding"].tolist()).astype(np.float64)
        counts = np.fromiter(map(len, part["ids"]), np.int32, len(part))
        longest = float(np.sqrt(np.einsum("nd,nd->n", x, x).max()))
        edges = build_graph(_evened(x, longest)).astype(np.int32)
        return pd.DataFrame({"shard": [key[0]], "class": [key[1]], "dim": [key[2]], "n": [len(x)], "longest": [longest], "counts": [counts.tobytes()], "ids": [np.concatenate(part["ids"].tolist()).astype(np.int64).tobytes()], "vectors": [x.tobytes()], "edges": [edges.tobytes()]})

    return kept(spark, dealt.groupBy("shard", "class", "dim").applyInPandas(build, "shard int, class int, dim int, n int, longest double, counts binary, ids binary, vectors binary, edges binary"))


def _found(x, points, edges, counts, begin, ids, q, k: int, beam: int) -> tuple[pa.Array, pa.Array]:
    """The ids and inner products of the k + 1 best vectors of a shard for each query."""
    n = len(x)
    flat = np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)
    lists, scores = [], []
    for a in range(0, len(q), 256):
        met, _ = beam_search(points, edges, n, flat[a : a + 256], max(beam, k + 1), _entries(n))
        for i, places in enumerate(met, a):
            places = places[places < n]
            close = np.cumsum(x[places] * q[i], axis=1)[:, -1]
            m = counts[places]
            all_ids = ids[np.repeat(begin[places], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)]
            all_close = np.repeat(close, m)
            best = np.lexsort((all_ids, -all_close))[: k + 1]
            lists.append(all_ids[best])
            scores.append(all_close[best])
    offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(scores)))


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all shards for each query, never the query's own row."""
    spark = index.sparkSession
    asked = kept(spark, usable(queries).select("vec_id", "embedding").distinct())
    distinct = asked.groupBy("embedding").agg(F.min("vec_id").alias("qkey"), F.xxhash64("embedding").alias("qhash")).withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-distinct.count() // block))
    blocked = distinct.withColumn("block", F.pmod(F.hash("qkey", "qhash"), F.lit(blocks)))
    packed = blocked.groupBy("dim", "block").agg(F.collect_list(F.struct("qkey", "qhash", "embedding")).alias("asked"))
    # A shard is read by several tasks where there are fewer shards than tasks; each takes its share of the blocks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = index.count()
    lanes = max(1, min(blocks, -(-parts // max(shards, 1))))
    places = index.select("shard", "class", "dim")
    no_block, no_shard = F.lit(None).cast(packed.schema["asked"].dataType), F.lit(None).cast("binary")
    graphs = index.select("shard", "class", "dim", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).alias("block"), "n", "longest", "counts", "ids", "vectors", "edges", no_block.alias("asked"))
    # Every block goes to every shard of its dimension; the shards' names are few, their rows are not sent along.
    sent = packed.join(places, "dim").select("shard", "class", "dim", F.pmod("block", F.lit(lanes)).alias("lane"), "block", F.lit(0).alias("n"), F.lit(0.0).alias("longest"), *(no_shard.alias(c) for c in ("counts", "ids", "vectors", "edges")), "asked")
    met = graphs.unionByName(sent).repartition(max(parts, shards), "shard", "class", "dim", "lane").sortWithinPartitions("shard", "class", "dim", "lane", "block")

    def answer(batches):
        shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda name, i=i, batch=batch: batch.column(name)[i].as_py()
                if value("block") < 0:
                    x = np.frombuffer(value("vectors"), np.float64).reshape(value("n"), value("dim"))
                    counts, edges = np.frombuffer(value("counts"), np.int32), np.frombuffer(value("edges"), np.int32)
                    shard = (x, _evened(x, value("longest")), edges.astype(np.int64).reshape(len(x) + 1, DEGREE), counts, np.cumsum(counts) - counts, np.frombuffer(value("ids"), np.int64))
                else:
                    asked = batch.column("asked")[i].values
                    q = asked.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(asked), -1)
                    yield pa.RecordBatch.from_arrays([asked.field("qkey"), asked.field("qhash"), *_found(*shard, q, k, beam)], ["qkey", "qhash", "ids", "scores"])

    hits = met.mapInArrow(answer, "qkey long, qhash long, ids array<long>, scores array<double>")
    hits = hits.select("qkey", "qhash", F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score")).alias("found"))
    one = hits.select("qkey", "qhash", F.explode("found").alias("f"))
    order = Window.partitionBy("qkey", "qhash").orderBy(F.col("f.score").desc(), "f.vec_id")
    best = one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = best.groupBy("qkey", "qhash").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "f"))), lambda x: x["f"]).alias("found"))
    named = asked.withColumn("qhash", F.xxhash64("embedding")).join(distinct.select("embedding", "qkey"), "embedding").select("vec_id", "qkey", "qhash")
    answers = named.join(lists, ["qkey", "qhash"]).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("pos", "f")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(build_index(vectors), vectors.where("vec_id % 20 = 0"))


QUERIES = {"op9_ann": op9_ann}
ORACLES: dict[str, str] = {}
