"""Views of the star schema in the roles that the operators expect, for queries and benchmarks; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def turn_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rated turn for each line item; the order is the conversation."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    j = li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
    level = F.when(F.col("o_orderstatus") == "F", "fixed_belief").when(F.col("o_orderstatus") == "O", "control").otherwise("ambiguous")
    theme = F.concat(F.lit("theme_"), (F.col("o_orderkey") % 3).cast("string"))
    q = F.col("l_quantity").cast("int")
    s = lambda c: c.cast("string")
    return j.select(
        F.concat(F.lit("run_"), s(F.col("l_orderkey"))).alias("run_id"),
        F.col("l_linenumber").alias("turn_number"),
        level.alias("presentation_level"),
        theme.alias("theme"),
        F.concat(F.lit("model_"), s(F.col("o_custkey") % 2)).alias("model_slot"),
        F.when(F.col("o_custkey") % 4 < 2, "no_preloaded").otherwise("preloaded").alias("context_condition"),
        (F.lit(1) + F.expr("(o_custkey % 8 - o_custkey % 4) div 4")).cast("int").alias("repetition"),
        F.concat(theme, F.lit("_"), level).alias("script_id"),
        F.when(F.col("l_discount") == 0.0, F.lit(None).cast("string")).when(F.col("l_discount") == 0.1, "99").otherwise(s(q % 3)).alias("A1"),
        F.when(F.col("l_returnflag") == "N", "N/A").otherwise(s(F.col("l_suppkey") % 3)).alias("A2"),
        F.when(F.col("l_tax") == 0.0, " n/a ").when(F.col("l_tax") == 0.08, "2").otherwise(s(F.col("l_partkey") % 2)).alias("A3"),
        s((F.col("l_suppkey") + F.col("l_linenumber")) % 3).alias("B1"),
        s(F.col("l_partkey") % 3).alias("B2"),
        s((q + F.col("l_linenumber")) % 3).alias("B3"),
        s((F.col("l_orderkey") + F.col("l_linenumber")) % 3).alias("C1"),
        F.col("l_shipdate").alias("saved_at"),
        F.col("l_partkey").alias("log_index"),
    )


TURNS = """turns AS (SELECT 'run_' || l_orderkey AS run_id, l_linenumber AS turn_number,
  CASE o_orderstatus WHEN 'F' THEN 'fixed_belief' WHEN 'O' THEN 'control' ELSE 'ambiguous' END AS presentation_level,
  'theme_' || (o_orderkey % 3) AS theme, 'model_' || (o_custkey % 2) AS model_slot,
  CASE WHEN o_custkey % 4 < 2 THEN 'no_preloaded' ELSE 'preloaded' END AS context_condition,
  CAST(1 + (o_custkey % 8 - o_custkey % 4) // 4 AS INT) AS repetition,
  'theme_' || (o_orderkey % 3) || '_' || CASE o_orderstatus WHEN 'F' THEN 'fixed_belief' WHEN 'O' THEN 'control' ELSE 'ambiguous' END AS script_id,
  CASE WHEN l_discount = 0.0 THEN NULL WHEN l_discount = 0.1 THEN '99' ELSE CAST(CAST(floor(l_quantity) AS INT) % 3 AS VARCHAR) END AS A1,
  CASE WHEN l_returnflag = 'N' THEN 'N/A' ELSE CAST(l_suppkey % 3 AS VARCHAR) END AS A2,
  CASE WHEN l_tax = 0.0 THEN ' n/a ' WHEN l_tax = 0.08 THEN '2' ELSE CAST(l_partkey % 2 AS VARCHAR) END AS A3,
  CAST((l_suppkey + l_linenumber) % 3 AS VARCHAR) AS B1, CAST(l_partkey % 3 AS VARCHAR) AS B2,
  CAST((CAST(floor(l_quantity) AS INT) + l_linenumber) % 3 AS VARCHAR) AS B3, CAST((l_orderkey + l_linenumber) % 3 AS VARCHAR) AS C1,
  l_shipdate AS saved_at, l_partkey AS log_index
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

#: Domain-aware ratings r_X and scores s_X of turns, and what each (run, turn) collapses to.
SCORED = f"""{TURNS},
scored AS (SELECT *,
  CASE WHEN TRY_CAST(A1 AS DOUBLE) IN (0, 1, 2) THEN CAST(TRY_CAST(A1 AS DOUBLE) AS INT) END AS s_A1,
  CASE WHEN TRY_CAST(A2 AS DOUBLE) IN (0, 1, 2) THEN CAST(TRY_CAST(A2 AS DOUBLE) AS INT) END AS s_A2,
  CASE WHEN TRY_CAST(A3 AS DOUBLE) IN (0, 1) THEN CAST(TRY_CAST(A3 AS DOUBLE) AS INT) END AS s_A3 FROM turns),
rated AS (SELECT *, CAST(s_A1 AS VARCHAR) AS r_A1,
  CASE WHEN upper(trim(A2)) = 'N/A' THEN 'N/A' ELSE CAST(s_A2 AS VARCHAR) END AS r_A2,
  CASE WHEN upper(trim(A3)) = 'N/A' THEN 'N/A' ELSE CAST(s_A3 AS VARCHAR) END AS r_A3 FROM scored),
cells AS (SELECT run_id, turn_number AS t, count(*) AS c, {", ".join(f"CASE WHEN min({p}_{a}) = max({p}_{a}) THEN max({p}_{a}) END AS {p}_{a}" for a in ("A1", "A2", "A3") for p in "rs")}
  FROM rated GROUP BY run_id, turn_number)"""


#: Line items that a task of rater_items holds on average.
ITEMS = 100_000


def rater_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, source (human and three judges), axis and rating; some judges shift some scores by one."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # All rows of an item stay in the task that it is dealt to, whatever they are grouped by next; a task's share is bounded.
    dealt = li.withColumn("item_id", F.concat_ws("_", "l_orderkey", "l_linenumber")).repartition(max(1, -(-li.count() // ITEMS)), "item_id")
    item = dealt.groupBy("item_id", "l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max(F.col("l_quantity").cast("int")).alias("q"))
    a = F.when(F.col("s") % 5 == 0, "N/A").otherwise((F.col("s") % 3).cast("string"))
    base = {"A1": (F.col("q") % 3).cast("string"), "A2": a, "A3": (F.col("p") % 2).cast("string")}
    cell = lambda axis, c, source, judge: F.struct(F.lit(axis).alias("axis"), c.alias("base"), F.lit(source).alias("source"), F.lit(judge).alias("judge"))
    cells = F.array(*(cell(x, c, n, i) for x, c in base.items() for i, n in enumerate(("human", "judge_1", "judge_2", "judge_3"))))
    rows = item.select("item_id", "p", F.explode(cells).alias("x")).select("item_id", "p", "x.*")
    shifted = (F.col("judge") > 0) & ((F.col("p") + 7 * F.col("judge") + F.substring("axis", 2, 1).cast("int")) % 10 < 2)
    moved = F.when(F.col("base") == "N/A", "0").otherwise(((F.col("base").try_cast("int") + 1) % F.when(F.col("axis") == "A3", 2).otherwise(3)).cast("string"))
    return rows.select("item_id", "source", "axis", F.when(shifted, moved).otherwise(F.col("base")).alias("rating"))


RATERS = """raters AS (SELECT item_id, source, axis, CASE WHEN judge > 0 AND (p + 7 * judge + CAST(substr(axis, 2, 1) AS INT)) % 10 < 2
    THEN CASE WHEN base = 'N/A' THEN '0' ELSE CAST((TRY_CAST(base AS INT) + 1) % (CASE WHEN axis = 'A3' THEN 2 ELSE 3 END) AS VARCHAR) END ELSE base END AS rating
  FROM (UNPIVOT (SELECT l_orderkey || '_' || l_linenumber AS item_id, max(l_partkey) AS p, CAST(max(CAST(floor(l_quantity) AS INT)) % 3 AS VARCHAR) AS A1,
      CASE WHEN max(l_suppkey) % 5 = 0 THEN 'N/A' ELSE CAST(max(l_suppkey) % 3 AS VARCHAR) END AS A2, CAST(max(l_partkey) % 2 AS VARCHAR) AS A3
    FROM lineitem GROUP BY l_orderkey, l_linenumber) ON A1, A2, A3 INTO NAME axis VALUE base),
  (VALUES ('human', 0), ('judge_1', 1), ('judge_2', 2), ('judge_3', 3)) AS v(source, judge))"""


def annotation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log: item, annotator, time, log index and scores."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return li.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("item_id"),
        F.concat(F.lit("annotator_"), (F.col("l_suppkey") % 2).cast("string")).alias("annotator_id"),
        F.col("l_shipdate").alias("saved_at"),
        (F.col("l_partkey") * 1000003 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("log_index"),
        (F.col("l_quantity").cast("int") % 3).cast("string").alias("A1"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(None).cast("string")).otherwise((F.col("l_partkey") % 3).cast("string")).alias("A2"),
    )


LOG = """log AS (SELECT l_orderkey || '_' || l_linenumber AS item_id, 'annotator_' || (l_suppkey % 2) AS annotator_id, l_shipdate AS saved_at,
  l_partkey * 1000003 + CAST(round(l_extendedprice * 100) AS BIGINT) AS log_index, CAST(CAST(floor(l_quantity) AS INT) % 3 AS VARCHAR) AS A1,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 3 AS VARCHAR) END AS A2 FROM lineitem)"""


def technical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, event_id, ts, kind (success or error), model, latency, tokens and status code of calls."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        "event_id",
        "ts",
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("kind"),
        F.concat(F.lit("model_"), (F.col("user_id") % 2).cast("string")).alias("model_slot"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(F.col("value")).alias("latency"),
        F.when(k % 4 == 0, F.lit(None).cast("int")).otherwise(k).alias("tokens"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("http_"), F.element_at(F.array(*map(F.lit, ("429", "500", "503", "404"))), (k % 4 + 1).cast("int")))).alias("error_code"),
    )


CALLS = """calls AS (SELECT 'run_' || user_id AS run_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS kind,
  'model_' || (user_id % 2) AS model_slot, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS latency,
  CASE WHEN k % 4 = 0 THEN NULL ELSE k END AS tokens, CASE WHEN event_type = 'error' THEN 'http_' || (['429', '500', '503', '404'])[k % 4 + 1] END AS error_code
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
