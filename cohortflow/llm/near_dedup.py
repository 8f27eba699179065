r"""MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles (words [^\x20\x09-\x0D]+ after lower-casing A-Z; with fewer words than a
shingle has, the whole sequence as one). Each set gets 160 MinHash samples. They serve twice: 32 bands of 5 samples
propose candidates, and all samples are folded into an odd sketch, a bitmap whose bits hold the parity of the samples
that hash to them. The population count of the XOR of two odd sketches estimates how many samples differ, most exactly
where sets are nearly equal. Candidates whose sketches differ by more than a similar pair's ever do (five standard
deviations of the sample, four of the bitmap) are dropped; the others are confirmed on their full sets, so a link is
never taken from an estimate. A pair at exactly 0.8 shares no band once in 300,000 times, at 0.9 once in 10^12.

Groups of copies: documents with equal sets form a class first and go on as one. Buckets are never expanded into all
pairs. Each member of a bucket is compared with one leader; confirmed links merge components, and buckets whose members
all lie in one component are done, for no further link could change anything. The leader is the most central member, whose bands
most others share: among copies of one text that is the text itself. What is left is settled exactly by a prefix filter:
members outside their bucket's largest component meet all others of open buckets that share one of their rarest items.

Components come from alternating large-star and small-star steps on the links; labels are class keys and never leave
the executors.

Defined results: null, empty or wordless texts have an empty set, are linked with nothing and kept; a null doc_id never
names a component unless all its ids are null; repeated rows fall into one class and each is reported; a text of any
length is one set; leaders that tie are chosen by class key, which changes no result; an empty table gives an empty
result; extra columns are ignored by the operator and returned as they were by the stage, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm._text import SPACE, U, framed, kept, mix, shingle_hashes, signed, text_chunks, unframed, words

BANDS = 32
ROWS = 5
SKETCH_BITS = 512
#: Bits of the filter that keeps texts without a counterpart out of a shuffle: 2^18 rows are broadcast at most.
FILTER_BITS = 1 << 24

_WORDS = SKETCH_BITS // 64
_SKETCH = [f"s{i}" for i in range(_WORDS)]
_SIG = "doc_id {id}, tk long, cls binary, n_shingles long, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, in a row; their number for each text)."""
    h, _, _, counts = words(data, offsets, SPACE)
    edges = np.concatenate([[0], np.cumsum(counts)])
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(edges[:-1] - (ends - n), n) + np.arange(total)
    flat = np.empty(total, np.uint64)
    long_text = np.repeat(counts >= k, n)
    if long_text.any():
        flat[long_text] = shingle_hashes(h, k)[at[long_text]]
    for size in range(1, k):
        short = np.repeat(counts == size, n)
        if short.any():
            flat[short] = mix(shingle_hashes(h, size)[at[short]] + U(size * 0x9E3779B97F4A7C15 % (1 << 64)))
    new = np.ones(total, bool)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        flat[a:b].sort()
    if total:
        new[1:] = flat[1:] != flat[:-1]
        new[(ends - n)[n > 0]] = True
    sums = np.concatenate([[0], np.cumsum(new)])
    return flat[new], sums[ends] - sums[ends - n]


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as Arrow binaries."""
    n, width = rows.shape
    offsets = (np.arange(n + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _class_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits of each set; equal for equal sets."""
    both = np.stack([np.add.reduceat(mix(flat), starts), np.add.reduceat(mix(flat ^ U(0xA5A5A5A55A5A5A5A)), starts)], axis=1)
    return np.ascontiguousarray(both).view(np.uint8).reshape(len(starts), 16)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text key, class key, set size, bands and odd sketch of every document with a word."""
    samples = BANDS * ROWS
    draw = np.random.default_rng(20260902)
    factor = draw.integers(1, 1 << 63, samples, dtype=np.uint64) | U(1)
    flip = draw.integers(0, 1 << 63, samples, dtype=np.uint64)
    weight = draw.integers(1, 1 << 63, ROWS, dtype=np.uint64) | U(1)

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("tk")
            for first, last, data, offsets in text_chunks(batch.column("text")):
                flat, counts = shingle_sets(data, offsets, k)
                has = np.flatnonzero(counts)
                if not len(has):
                    continue
                starts = (np.cumsum(counts) - counts)[has]
                sig = np.empty((samples, len(has)), np.uint64)
                for i in range(samples):
                    sig[i] = np.minimum.reduceat((flat ^ flip[i]) * factor[i], starts)
                rows = sig.reshape(BANDS, ROWS, len(has))
                bands = mix((rows * weight[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * U(0xD6E8FEB86659FD93))
                bit = (mix(sig + np.arange(samples, dtype=np.uint64)[:, None] * U(0x9E3779B97F4A7C15)) % U(SKETCH_BITS)).astype(np.int64)
                cell = (bit + np.arange(len(has)) * SKETCH_BITS).ravel()
                odd = (np.bincount(cell, minlength=len(has) * SKETCH_BITS) & 1).astype(np.uint8).reshape(len(has), SKETCH_BITS)
                sketch = np.packbits(odd, axis=1).view(np.int64)
                pick = pa.array(has + first)
                band_lists = pa.ListArray.from_arrays(pa.array((np.arange(len(has) + 1) * BANDS).astype(np.int32)), pa.array(signed(np.ascontiguousarray(bands.T).ravel())))
                arrays = [ids.take(pick), keys.take(pick), _binary(_class_keys(flat, starts)), pa.array(counts[has].astype(np.int64)), band_lists]
                arrays += [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(_WORDS)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "tk", "cls", "n_shingles", "bands", *_SKETCH])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tk"), "text").mapInArrow(run, _SIG.format(id=kind))


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                flat, counts = shingle_sets(data, offsets, k)
                has = np.flatnonzero(counts)
                if not len(has):
                    continue
                starts = (np.cumsum(counts) - counts)[has]
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(signed(flat)))
                yield pa.RecordBatch.from_arrays([_binary(_class_keys(flat, starts)), lists], ["cls", "items"])

    return docs.select("text").mapInArrow(run, "cls binary, items array<long>")


def _settled(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (u, v) is either tied to one other, or others are tied to it."""
    as_child = F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
    as_parent = F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    roles = edges.select(F.inline(F.array(as_child, as_parent))).groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return roles.where("child > 1 OR child > 0 AND parent > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected graph (u, v) but the roots, the smallest nodes of the components."""
    spark = edges.sparkSession
    tie = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    edges = kept(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not _settled(edges):
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours. An edge gives one at most.
        both = edges.select(F.inline(F.array(tie("u", "v"), tie("v", "u"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(tie("v", "m"), tie("u", "m")))).where("u <> v").distinct()
        edges = kept(spark, small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sketch_bound(threshold: float) -> int:
    """The largest XOR population count that a pair at the threshold may show."""
    samples = BANDS * ROWS
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / samples)
    differ = 2 * samples * (1 - max(least, 0.0))
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ)
    return math.ceil(mean + 4 * math.sqrt(SKETCH_BITS) / 2)


def _plausible(percent: int):
    """Length and sketch bounds on the columns of a and b."""
    differ = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    return (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent) & (differ <= _sketch_bound(percent / 100))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v), those whose full sets are similar enough."""
    left = sets.select(F.col("cls").alias("u"), F.col("items").alias("x"))
    right = sets.select(F.col("cls").alias("v"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "u").join(right, "v").where(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("u", "v")


def _prefix_pairs(side: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) in different components, one of them outside its bucket's main one, that may be similar enough.

    Exact prefix filter: with items in order of rarity, similar sets share an item among the first
    n - ceil(n * percent / 100) + 1 of each, at places that leave room for the overlap they need.
    """
    own = side.join(sets, "cls").select("cls", "comp", "outside", F.size("items").alias("n"), F.posexplode("items").alias("p", "item")).drop("p")
    often = own.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    # An item that no other set holds proposes nothing, but keeps its place in the order; such items come first.
    ranked = own.join(often, "item", "left").groupBy("cls", "comp", "outside", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item"))).alias("order"))
    size = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    prefix = ranked.select("cls", "comp", "outside", "n", F.posexplode(F.slice("order", 1, size)).alias("at", "x")).where("x.df > 1").select("cls", "comp", "outside", "n", "at", F.col("x.item").alias("item"))
    a, b = prefix.where("outside").alias("a"), prefix.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    room = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    once = ~F.col("b.outside") | (F.col("a.cls") < F.col("b.cls"))
    length = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    met = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.comp") != F.col("b.comp")) & once & length & (room >= need))
    return met.select(F.greatest("a.cls", "b.cls").alias("u"), F.least("a.cls", "b.cls").alias("v")).distinct()


def _with_filter(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """`docs` with `maybe`: false only where no row of `keys` (doc_id, tk) has the row's id and text key."""
    bit = lambda text_key: F.pmod(F.xxhash64("doc_id", text_key), F.lit(FILTER_BITS))
    # Of 64 bits a row each; true for some others too, the more the fuller it is, so an exact join has to follow.
    words = keys.select(bit("tk").alias("b")).groupBy(F.expr("b div 64").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias("_bits"))
    placed = docs.withColumn("_b", bit(F.xxhash64("text"))).withColumn("_w", F.expr("_b div 64"))
    hit = F.expr("coalesce(_bits & shiftleft(1L, CAST(_b % 64 AS INT)), 0L) <> 0")
    return placed.join(F.broadcast(words), "_w", "left").withColumn("maybe", hit).drop("_w", "_b", "_bits")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, tk (xxhash64 of the text), n_shingles, component_id, kept and the component's key."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sig = kept(spark, signatures(docs, shingle_words))
    alike = [F.first(c).alias(c) for c in ("n_shingles", "bands", *_SKETCH)]
    one = kept(spark, sig.groupBy("cls").agg(F.min(F.struct("doc_id", "tk")).alias("rep"), F.min("doc_id").alias("smallest"), *alike))

    keyed = one.select("cls", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # Candidates are classes that share a bucket; a class has a bucket for each band at most.
    placed = keyed.join(crowded, "key").groupBy("cls").agg(F.collect_list(F.struct("key", "size")).alias("buckets"), F.sum("size").alias("weight"))
    candidates = kept(spark, placed.join(one.select("cls", "rep", F.col("n_shingles").alias("n"), *_SKETCH), "cls"))
    # The most central member leads: the one whose bands the most others share, in a group of copies their original.
    weighed = candidates.select("cls", "weight", F.inline("buckets"))
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("l")).select("key", F.col("l.cls").alias("lead"))
    members = kept(spark, weighed.select("key", "cls", "size").join(leaders, "key"))
    # The full sets of candidates only: their representatives' texts are found again by id and text key.
    reps = candidates.select("rep.doc_id", "rep.tk")
    wanted = reps.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).hint("shuffle_hash")
    likely = _with_filter(docs, reps).where("maybe").select("doc_id", "text")
    texts = likely.join(wanted, likely["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(likely["text"]) == F.col("_tk")), "left_semi")
    sets = kept(spark, _full_sets(texts, shingle_words).dropDuplicates(["cls"]))
    sketches = candidates.select("cls", "n", *_SKETCH)

    def merged(labels: DataFrame, ties: DataFrame) -> DataFrame:
        roots = components(ties)
        return kept(spark, labels.join(roots, labels["comp"] == roots["node"], "left").select("cls", F.coalesce("root", "comp").alias("comp")))

    def star(pairs: DataFrame) -> DataFrame:
        a = sketches.alias("a")
        b = sketches.alias("b")
        near = pairs.join(a, F.col("u") == F.col("a.cls")).join(b, F.col("v") == F.col("b.cls")).where(_plausible(percent)).select("u", "v")
        return _confirmed(kept(spark, near), sets, percent)

    # A class has a leader for each of its buckets at most.
    led = members.where("cls <> lead").select(F.col("cls").alias("u"), "lead").groupBy("u").agg(F.collect_set("lead").alias("leads"))
    labels = merged(candidates.select("cls", F.col("cls").alias("comp")), star(led.select("u", F.explode("leads").alias("v"))))

    # Buckets of three and more whose members still lie in several components: all that is left to compare.
    now = members.where("size > 2").select("key", "cls").join(labels, "cls")
    split = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    now = kept(spark, now.join(split, "key"))
    if not now.isEmpty():
        shares = now.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
        side = now.join(shares, "key").groupBy("cls").agg(F.min("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("outside"))
        links = star(_prefix_pairs(side, sets, percent))
        own = labels.select(F.col("cls").alias("u"), F.col("comp").alias("cu"))
        other = labels.select(F.col("cls").alias("v"), F.col("comp").alias("cv"))
        labels = merged(labels, links.join(own, "u").join(other, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))

    named = one.select("cls", "smallest").join(labels, "cls", "left").select("cls", "smallest", F.coalesce("comp", "cls").alias("component"))
    names = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_class = named.join(names, "component").select("cls", "component", "component_id")
    linked = sig.select("doc_id", "tk", "cls", "n_shingles").join(of_class, "cls", "left")
    whole = linked.select("doc_id", "tk", "n_shingles", "component_id", "component")
    bare = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    zero = bare.select("doc_id", F.xxhash64("text").alias("tk"), F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return whole.unionByName(zero).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle_words=2).select("doc_id", "n_shingles", "component_id", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, by the query's own setting (two-word shingles, 0.8).

    Texts without a word all stay; every column of those that stay, whatever its name, comes out as it was.
    """
    own = framed(docs)
    found = kept(spark, near_duplicates(own, shingle_words=2))
    key = F.xxhash64("d.text")
    same = lambda side: F.col("d.doc_id").eqNullSafe(F.col(f"{side}.doc_id")) & (key == F.col(f"{side}.tk"))
    gone = found.where("not kept").select("doc_id", "tk").distinct()
    # Most texts have no copy to be told from, so they needn't travel.
    held = _with_filter(own, found.where("not kept"))
    looked_up = held.where("maybe").drop("maybe").alias("d").join(gone.hint("shuffle_hash").alias("g"), same("g"), "left_anti")
    rest = held.where("not maybe").drop("maybe").unionByName(looked_up)
    # Rows that repeat an id as well as a text are kept together above; only such tables need another look.
    grouped = found.where("kept and component is not null")
    twice = grouped.groupBy("component").count().where("count > 1")
    if not twice.isEmpty():
        mine = grouped.join(twice, "component", "left_semi")
        first = mine.groupBy("component").agg(F.min(F.struct("doc_id", "tk")).alias("f")).select("f.*")
        lone = rest.alias("d").join(mine.select("doc_id", "tk").distinct().alias("s"), same("s"), "left_anti")
        again = own.alias("d").join(first.alias("f"), same("f"), "left_semi")
        # Of rows equal in id and text the first in the order of their other columns' text.
        one = again.groupBy("doc_id", "text").agg(F.min_by("row", F.to_json("row")).alias("row"))
        rest = lone.unionByName(one)
    return unframed(rest, docs)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, s FROM (SELECT rid, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM
  (SELECT rid, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS u, b.rid AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, e.v FROM reach JOIN e ON e.u = reach.b),
c AS (SELECT a AS rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.b GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id IS NOT DISTINCT FROM c.component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES = {"op2_near_dedup": ORACLE}
