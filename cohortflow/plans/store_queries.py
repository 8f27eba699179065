"""Round trips through sources and sinks: tables are written, read back by an operator and held against themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortflow.operators import design, events, integrity
from cohortflow.plans.event_queries import _EXCHANGES, _ITEMS, KEY, _scorable, _table, exchanges
from cohortflow.plans.fixtures import CALLS, LOG, TURNS, annotation_log, technical_events, turn_ratings
from cohortflow.sources import event_store
from cohortflow.streaming import event_log

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark):
    return f"{event_store.shared_folder(spark)}/store-{uuid.uuid4().hex}"


def _one_file_each(frame, folder, *by):
    """A JSON file for every row, in a directory for each of its keys; for small tables."""
    dirs = {f"{c}_dir": F.col(c) for c in by}
    frame.withColumns(dirs).repartition(*dirs).write.partitionBy(*dirs).json(folder)
    return folder


@query("SELECT 'run_' || n_nationkey AS run_id, n_name AS theme, CAST(n_regionkey AS INT) AS repetition FROM nation")
def run_headers_scan(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.concat(F.lit("run_"), F.col("n_nationkey").cast("string")).alias("run_id"), F.col("n_name").alias("theme"), F.col("n_regionkey").cast("int").alias("repetition"))
    return event_store.read_headers(spark, _one_file_each(n, _folder(spark), "run_id"), "part-*").select("run_id", "theme", "repetition")


_NATION_TURNS = "nation_turns AS (SELECT 'run_' || n_regionkey AS run_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS turn_number, n_name AS user_message FROM nation)"


def _nation_turns(spark, sf_dir):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return _table(spark, sf_dir, "nation").select(F.concat(F.lit("run_"), F.col("n_regionkey").cast("string")).alias("run_id"), at.alias("turn_number"), F.col("n_name").alias("user_message"))


@query(f"WITH {_NATION_TURNS} SELECT run_id, turn_number, user_message, true AS contiguous FROM nation_turns WHERE run_id LIKE 'run_1%'")
def success_turns_scan(spark, sf_dir):
    """Turns of the runs of one prefix: other directories aren't opened."""
    from pyspark.sql import Window

    folder = _one_file_each(_nation_turns(spark, sf_dir), _folder(spark), "run_id", "turn_number")
    t = event_store.read_turns(spark, folder, "run_id_dir=run_1", "turn_number_dir=*/part-*")
    run = Window.partitionBy("run_id")
    return t.select("run_id", "turn_number", "user_message", ((F.max("turn_number").over(run) == F.count("*").over(run)) & (F.min("turn_number").over(run) == 1)).alias("contiguous"))


@query(f"WITH {_NATION_TURNS} SELECT run_id, turn_number, user_message AS event_id FROM nation_turns")
def error_events_scan(spark, sf_dir):
    e = _nation_turns(spark, sf_dir).withColumnRenamed("user_message", "event_id")
    folder = _one_file_each(e, _folder(spark), "run_id", "turn_number")
    return event_store.read_errors(spark, folder, files="turn_number_dir=*/part-*").select("run_id", "turn_number", "event_id")


@query("SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS n_name, n_nationkey % 5 = 0 AS broken, count(*) AS n FROM nation GROUP BY ALL")
def fault_isolating_scan(spark, sf_dir):
    """Files cut in the middle come as broken rows; the others are read."""
    line = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit('{"n_name": "'), "n_name")).otherwise(F.to_json(F.struct("n_name")))
    folder = _folder(spark)
    _table(spark, sf_dir, "nation").select(line.alias("value"), F.col("n_nationkey").alias("k")).repartition("k").write.partitionBy("k").text(folder)
    found = event_store.read_json_files(spark, f"{folder}/*/part-*", "n_name string", strict=False)
    return found.select("n_name", F.col("_broken").isNotNull().alias("broken")).groupBy("n_name", "broken").agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT item_id, annotator_id, A1, A2 FROM log")
def annotation_log_scan(spark, sf_dir):
    """A log of several files, each numbered by itself."""
    folder = _folder(spark)
    event_store.write_once(annotation_log(spark, sf_dir).select("item_id", "annotator_id", "A1", "A2"), folder)
    return event_store.read_log(spark, folder, "item_id string, annotator_id string, A1 string, A2 string").drop("log_index")


@query(f"WITH {TURNS} SELECT run_id, CAST(turn_number AS INT) AS turn_number, A1, CASE WHEN A2 <> 'N/A' THEN A2 END AS A2 FROM turns")
def csv_tables(spark, sf_dir):
    folder = _folder(spark)
    rated = turn_ratings(spark, sf_dir).select("run_id", F.col("turn_number").cast("int").alias("turn_number"), "A1", "A2")
    event_store.write_tables({"ratings": rated}, folder)
    return event_store.read_table(spark, f"{folder}/ratings", rated.schema.simpleString()[7:-1].replace(":", " "))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_dict_rows(spark, sf_dir):
    folder = _folder(spark)
    event_store.write_tables({"nation": _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")}, folder)
    return event_store.read_rows(spark, f"{folder}/nation")


@query(f"WITH {_EXCHANGES} SELECT run_id, CAST(turn_number AS INT) AS turn_number, user_message, response_text FROM x")
def full_record_export(spark, sf_dir):
    """Headers with nested turns, written as JSON and flattened again."""
    x = exchanges(spark, sf_dir).withColumns({"turn_number": F.col("turn_number").cast("int"), "event_id": F.concat_ws("_", "run_id", "turn_number")})
    turns = x.select("run_id", "turn_number", "event_id", "user_message", F.struct(F.col("response_text").alias("text")).alias("result"))
    full = event_store.assemble(turns.select("run_id").distinct(), turns)
    folder = _folder(spark)
    event_store.write_once(full, folder)
    return event_store.flatten_turns(spark.read.schema(full.schema).json(folder))


@query(f"WITH {CALLS} SELECT event_id, run_id, kind FROM calls")
def append_only_store(spark, sf_dir):
    """Half of the events, then all: each is stored once."""
    e = technical_events(spark, sf_dir).select("event_id", "run_id", "kind")
    folder = _folder(spark)
    event_store.append_events(e.where("event_id % 2 = 0"), folder, by="kind", reject=True)
    event_store.append_events(e, folder, by="kind")
    return spark.read.schema(e.schema).parquet(folder)


@query(f"""WITH {CALLS}, old AS (SELECT run_id, CAST(event_id % 6 AS INT) AS turn_number, event_id, ts, event_id % 4 = 0 AS stored FROM calls WHERE kind = 'error')
  , taken AS (SELECT run_id, turn_number, list(2 * n) AS l FROM (SELECT run_id, turn_number, row_number() OVER (PARTITION BY run_id, turn_number ORDER BY ts, event_id) AS n FROM old WHERE stored) GROUP BY ALL)
  SELECT run_id, turn_number, event_id, (list_filter(range(1, 2 * k + 1), lambda i: NOT list_contains(coalesce(l, []), i)))[k] AS sequence
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, turn_number ORDER BY ts, event_id) AS k FROM old WHERE NOT stored) LEFT JOIN taken USING (run_id, turn_number)""")
def error_sequence_numbers(spark, sf_dir):
    e = technical_events(spark, sf_dir).where("kind = 'error'").select("run_id", (F.col("event_id") % 6).cast("int").alias("turn_number"), "event_id", F.col("ts").alias("occurred_at"))
    none = e.limit(0).withColumn("sequence", F.lit(0))
    stored = event_store.numbered_errors(none, e.where("event_id % 4 = 0")).withColumn("sequence", 2 * F.col("sequence"))  # odd numbers are free
    return event_store.numbered_errors(stored, e.where("event_id % 4 <> 0")).select("run_id", "turn_number", "event_id", F.col("sequence").cast("long").alias("sequence"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(doc_id || ' ' || coalesce(text, ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS s FROM documents) SELECT doc_id, substr(s, 1, 180) AS name FROM t""")
def safe_names(spark, sf_dir):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "documents").select("doc_id", event_store.safe_name(name).alias("name"))


#: The columns of the tables that the dictionary covers, as DuckDB names their types.
_FIELDS = {
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
}
_SPARK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz"}


def _dictionary_sql():
    rows = []
    for table, fields in _FIELDS.items():
        for i, (name, kind) in enumerate((f.split() for f in fields.split(", ") if f), 1):
            rows.append(f"SELECT '{table}' AS table_name, {i} AS position, '{name}' AS field, '{_SPARK_TYPES[kind]}' AS type, count(*) AS n_rows, count(*) - count({name}) AS n_null FROM {table}")
    return " UNION ALL ".join(rows)


@query(_dictionary_sql())
def data_dictionary(spark, sf_dir):
    return event_store.data_dictionary({t: _table(spark, sf_dir, t) for t in _FIELDS})


@query(f"WITH {LOG}, a AS (SELECT DISTINCT item_id FROM log WHERE A2 IS NOT NULL), b AS (SELECT DISTINCT item_id FROM log WHERE A1 = '0') SELECT item_id FROM a INTERSECT SELECT item_id FROM b")
def shared_items(spark, sf_dir):
    log = annotation_log(spark, sf_dir)
    return integrity.common(log.where("A2 IS NOT NULL"), log.where("A1 = '0'"), ["item_id"])


@query("SELECT DISTINCT c_nationkey AS g FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def split_overlap(spark, sf_dir):
    c, s = (_table(spark, sf_dir, t).select(F.col(k).alias("g")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return integrity.overlap(c, s, "g")


@query("SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant')) AS n FROM conversations GROUP BY conv_id")
def dialogue_messages(spark, sf_dir):
    """Messages of a conversation without the system's; a conversation's turns are few by design."""
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role")).alias("m"))
    return c.select("conv_id", F.size(design.dialogue_only(F.col("m"))).cast("long").alias("n"))


@query(f"WITH {LOG}, latest AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY saved_at DESC, log_index DESC) AS r FROM log WHERE annotator_id = 'annotator_0') SELECT DISTINCT item_id FROM log WHERE item_id NOT IN (SELECT item_id FROM latest WHERE r = 1 AND A1 IS NOT NULL AND A2 IS NOT NULL)")
def unrated_items(spark, sf_dir):
    log = annotation_log(spark, sf_dir)
    return events.incomplete_items(log.select("item_id").distinct(), log, ("A1", "A2"), "annotator_0")


@query(f"WITH {_ITEMS} SELECT item_id, run_id, turn_number, source_response_hash FROM items")
def blinded_files(spark, sf_dir):
    """Items and map are stored apart and meet by the opaque id alone."""
    items, item_map = events.blinded_items(_scorable(spark, sf_dir), KEY)
    folder = _folder(spark)
    event_store.write_blinded(items, item_map, folder)
    a, b = (spark.read.schema(f.schema).json(f"{folder}/{n}") for f, n in ((items, "items"), (item_map, "map")))
    return a.select("item_id", "source_response_hash").join(b.select("item_id", "run_id", "turn_number"), "item_id")


@query("""WITH e AS (SELECT 'run_' || user_id || '_' || (day(ts) - 1) // 7 AS run_id, event_id, event_type = 'error' AS bad, CAST(event_id % 9 + 1 AS INT) AS turn, ts FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL),
u AS (SELECT * FROM e WHERE bad OR turn <= 6), l AS (SELECT run_id, max(ts) FILTER (NOT bad) AS last_ok FROM u GROUP BY run_id),
g AS (SELECT e.run_id, count(DISTINCT turn) FILTER (NOT bad AND turn <= 6) AS turns, count(DISTINCT event_id) FILTER (bad) AS errors,
  count(DISTINCT event_id) FILTER (bad AND (last_ok IS NULL OR ts > last_ok)) AS failures, list(DISTINCT turn) FILTER (NOT bad AND turn <= 6) AS had FROM e LEFT JOIN l USING (run_id) GROUP BY e.run_id)
SELECT run_id, CAST(turns AS INT) AS turns, CAST(errors AS INT) AS errors, CASE WHEN turns = 6 THEN 'completed' WHEN turns > 0 THEN 'partial' WHEN errors > 0 THEN 'failed' ELSE 'planned' END AS status,
  CAST(list_min(list_filter([1, 2, 3, 4, 5, 6], lambda x: NOT list_contains(coalesce(had, []), x))) AS INT) AS next_turn, CAST(failures AS INT) AS failures,
  CASE WHEN turns < 6 AND failures BETWEEN 1 AND 9 THEN CAST(least(60, 3 * pow(2, failures - 1)) AS INT) END AS wait_seconds, CASE WHEN turns < 6 AND failures >= 10 THEN 'gave_up' END AS note FROM g""")
def streamed_run_progress(spark, sf_dir):
    """The events as a stream of runs, a user's week each; every run's row after the last batch that touched it."""
    folder = _folder(spark)
    session = spark.newSession()  # the state store is the stream's own setting
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{sf_dir}/events.parquet"
    # As a pattern: a stream takes a folder or a pattern, and the table may be one file.
    e = event_log.read_events(session, f"{sf_dir}/events[.]parquet", spark.read.parquet(path).schema)
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")
    rows = e.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string"), F.lit("_"), week).alias("run_id"),
        "event_id",
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("kind"),
        (F.col("event_id") % 9 + 1).cast("int").alias("turn_number"),
        "ts",
    )
    # The files are in no order of time: no event may count as late.
    states = event_log.run_progress(rows, lateness="36500 days")
    # A batch that is run again replaces its own rows.
    sink = lambda frame, batch: frame.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/rows/{batch}")
    states.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(StructType([*states.schema.fields, StructField("batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    return kept.groupBy("run_id").agg(F.max_by(F.struct(*states.columns[1:]), "batch").alias("s")).select("run_id", "s.*")
