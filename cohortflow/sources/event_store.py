"""Readers and writers of the event store: JSON events by run, JSONL logs, CSV tables, file digests.

Readers take explicit schemas; a malformed line fails or is kept aside, never silently dropped.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = "struct<prompt_tokens: long, completion_tokens: long, reasoning_tokens: long, total_tokens: long>"
RESULT = f"struct<status: string, text: string, finish_reason: string, truncated: boolean, requested_model_id: string, resolved_model_id: string, provider_name: string, latency_ms: double, retry_count: int, http_attempts: int, error_type: string, error_message: string, visible_word_count: int, usage: {USAGE}, response_metadata: map<string, string>>"
HEADER = "run_id string, study_version string, data_status string, script_id string, theme string, presentation_level string, model_slot string, requested_model_id string, context_condition string, repetition int, created_at timestamp"
TURN = f"event_id string, run_id string, turn_number int, user_message string, request_messages array<struct<role: string, content: string>>, result {RESULT}, requested_at timestamp, responded_at timestamp"
ERROR = f"event_id string, run_id string, turn_number int, result {RESULT}, occurred_at timestamp"
ANNOTATION = "annotation_id string, item_id string, rating_round string, annotator_id string, scores struct<A1: string, A2: string, A3: string, B1: string, B2: string, B3: string, C1: string>, notes string, source_response_hash string, saved_at timestamp"


def read_json_files(spark: SparkSession, pattern: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON document a file. Not strict: broken files come as rows with `_broken` set, beside the good ones."""
    reader = spark.read.option("multiLine", True)
    if strict:
        return reader.option("mode", "FAILFAST").schema(schema).json(pattern).withColumn("_file", F.input_file_name())
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").schema(f"{schema}, _broken string").json(pattern).withColumn("_file", F.input_file_name())


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session may go without one and gets a folder of its own."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-store-")
    return folder


def read_headers(spark: SparkSession, root: str, files: str = "run.json") -> DataFrame:
    return read_json_files(spark, f"{root}/*/{files}", HEADER)


def read_turns(spark: SparkSession, root: str, prefix: str = "", files: str = "turn-*-success.json") -> DataFrame:
    """Success events of the runs whose directories start with the prefix: others aren't opened."""
    return read_json_files(spark, f"{root}/{prefix}*/{files}", TURN)


def read_errors(spark: SparkSession, root: str, prefix: str = "", files: str = "*error*.json") -> DataFrame:
    return read_json_files(spark, f"{root}/{prefix}*/{files}", ERROR)


def read_log(spark: SparkSession, path: str, schema: str = ANNOTATION) -> DataFrame:
    """A JSONL log with its line number as log_index; blank lines are skipped, a malformed one fails with its number.

    A log is one file; its lines are numbered by their place in it, from the file's own order.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=False).withColumn("_at", F.monotonically_increasing_id())
    numbered = lines.where(F.trim("value") != "").withColumn("log_index", F.row_number().over(Window.partitionBy(F.input_file_name()).orderBy("_at")))
    parsed = numbered.withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad = F.raise_error(F.concat(F.lit("malformed line "), F.col("log_index").cast("string")))
    first = schema.split()[0]
    ok = F.when(F.col("_r").isNull() | F.col(f"_r.{first}").isNull(), bad.cast("boolean")).otherwise(F.lit(True))
    return parsed.where(ok).select("_r.*", "log_index")


def read_table(spark: SparkSession, path: str, schema: str, null: str | None = "N/A") -> DataFrame:
    """A CSV table with a header; `null` is the text that stands for missing, None to keep "N/A" a value."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    return (reader.option("nullValue", null) if null else reader).schema(schema).csv(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV as strings, tolerant of a byte-order mark; an empty table is an error."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def read_config(spark: SparkSession, path: str, required: Sequence[str] = ()) -> dict:
    """A small JSON or YAML document (by its ending) as a dictionary, through Spark's own file access.

    A document that isn't a mapping, or lacks a required key, is an error.
    """
    text = spark.read.text(path, wholetext=True).first()["value"]  # a configuration file
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        import json

        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} isn't a mapping")
    if missing := [k for k in required if found.get(k) in (None, "", [], {})]:
        raise ValueError(f"{path} lacks {missing}")
    return found


def read_lexicon(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """The categories of a lexicon file, as `lexical_features` takes them."""
    from cohortflow.functions.text import checked_lexicon

    return checked_lexicon(read_config(spark, path, ("version", "categories"))["categories"])


def data_dictionary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row for every column of the tables: table, position from 1, field, type, and how many rows and nulls it has.

    One aggregate a table; only their schemas reach the driver.
    """
    out = None
    for name, frame in tables.items():
        counts = frame.agg(F.count("*").alias("_all"), *(F.count(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(frame.schema)))
        rows = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_all").alias("n_rows"), (F.col("_all") - F.col(f"_{i}")).alias("n_null")) for i, f in enumerate(frame.schema))))
        own = counts.select(F.lit(name).alias("table_name"), rows.alias("r")).select("table_name", "r.*")
        out = own if out is None else out.unionByName(own)
    return out


def flatten_turns(records: DataFrame) -> DataFrame:
    """Conversation records with nested turns as a row per turn; a null text is an empty one."""
    t = records.select("run_id", F.explode("turns").alias("t"))
    return t.select("run_id", F.col("t.turn_number").alias("turn_number"), F.col("t.user_message").alias("user_message"), F.coalesce("t.result.text", F.lit("")).alias("response_text"))


def _by_turn(a: Column, b: Column) -> Column:
    return F.when(a["turn_number"] < b["turn_number"], -1).when(a["turn_number"] > b["turn_number"], 1).otherwise(0)


def assemble(headers: DataFrame, turns: DataFrame) -> DataFrame:
    """Headers with their turns as an ordered array: the full record for export. A run's turns are few by design."""
    nested = turns.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("turn_number", "event_id", "user_message", "result")), _by_turn).alias("turns"))
    return headers.join(nested, "run_id", "left")


def key_values(frame: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: its name and its value as text."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    return frame.selectExpr(f"stack({len(columns)}, {pairs}) AS (field, value)")


def write_once(frame: DataFrame, path: str, kind: str = "json", overwrite: bool = False, **options) -> None:
    """Writes a table; an existing one is refused unless overwriting is asked for. Of two writers at once one is refused."""
    writer = frame.write.mode("overwrite" if overwrite else "errorifexists").options(**options).format(kind)
    if overwrite:
        writer.save(path)
        return
    with append_lock(frame.sparkSession, path) as still_held:
        still_held()
        writer.save(path)


#: Seconds after which a writer that hasn't finished counts as dead.
LEASE = 3600.0


@contextmanager
def append_lock(spark: SparkSession, path: str, lease: float = LEASE) -> Iterator[Callable[[], None]]:
    """Holds path.lock, a file that one writer alone can create; a second writer is refused.

    A lock older than the lease is a dead writer's: it is renamed away, which of several takers only one can do, and
    claimed anew. What is yielded is a check to make right before a write: it fails once another writer has taken over.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    lock = hadoop.Path(f"{path}.lock")
    files = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    owner = uuid.uuid4().hex

    def holder() -> str | None:
        try:
            with contextlib.closing(files.open(lock)) as stream:
                return bytes(stream.readAllBytes()).decode()
        except Exception as e:  # noqa: BLE001  the lock may be gone by now
            if "FileNotFound" not in str(e):
                raise
            return None

    def claim() -> bool:
        try:
            with contextlib.closing(files.create(lock, False)) as stream:  # fails where the file exists
                stream.write(owner.encode())
            return True
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" not in str(e):
                raise
            return False

    def expired() -> bool:
        try:
            return time.time() - files.getFileStatus(lock).getModificationTime() / 1000 > lease
        except Exception as e:  # noqa: BLE001
            if "FileNotFound" not in str(e):
                raise
            return False

    if not claim():
        old = hadoop.Path(f"{path}.lock-{owner}")
        if not (expired() and files.rename(lock, old) and claim()):
            raise RuntimeError(f"{path} is being written to: {path}.lock exists")
        files.delete(old, False)

    def still_held() -> None:
        if holder() != owner:
            raise RuntimeError(f"the lease on {path} has run out and another writer has taken over")

    try:
        yield still_held
    finally:
        if holder() == owner:
            files.delete(lock, False)


def append_events(frame: DataFrame, path: str, key: str = "event_id", by: str = "run_id", reject: bool = False) -> int:
    """Appends events that the store doesn't hold yet, partitioned by a column; the number of rows that were new.

    One writer at a time. With `reject`, keys that the store holds or that repeat are an error and nothing is written.
    """
    spark = frame.sparkSession
    with append_lock(spark, path) as still_held:
        try:
            known = spark.read.parquet(path).select(key)
        except Exception as e:  # noqa: BLE001  only a store that doesn't exist yet is empty
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = frame.select(key).limit(0)
        fresh = frame.join(known, key, "left_anti").dropDuplicates([key])
        n = fresh.count()
        if reject and n < frame.count():
            raise ValueError(f"values of {key} repeat or are in {path} already")
        still_held()
        fresh.write.mode("append").partitionBy(by).parquet(path)
    return n


def with_headers(turns: DataFrame, headers: DataFrame) -> DataFrame:
    """Successes that may be stored: one of a run without a header fails the query."""
    known = headers.select("run_id").distinct().withColumn("_known", F.lit(True))
    none = F.raise_error(F.concat(F.lit("no header for run "), F.coalesce("run_id", F.lit("null")))).cast("boolean")
    return turns.join(known, "run_id", "left").where(F.coalesce("_known", none)).drop("_known")


def numbered_errors(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New error events with the free sequence numbers of their (run, turn), from the first on: gaps are filled.

    A turn has as many errors as attempts, so its numbers fit in a row.
    """
    from pyspark.sql import Window

    taken = existing.groupBy("run_id", "turn_number").agg(F.collect_set(F.col("sequence").cast("int")).alias("_taken"))
    order = Window.partitionBy("run_id", "turn_number").orderBy("occurred_at", "event_id")
    rows = incoming.join(taken, ["run_id", "turn_number"], "left").withColumn("_k", F.row_number().over(order)).withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(1), F.size("_taken") + F.col("_k")), "_taken")
    return rows.withColumn("sequence", F.element_at(free, F.col("_k"))).drop("_taken", "_k")


def write_tables(tables: Mapping[str, DataFrame], folder: str, kind: str = "csv") -> None:
    for name, frame in tables.items():
        write_once(frame, f"{folder}/{name}", kind, header=True)


def write_blinded(items: DataFrame, item_map: DataFrame, folder: str) -> None:
    """Items and map in tables apart, after checking that nothing of the map shows in the items."""
    shared = set(items.columns) & {"run_id", "model_slot", "script_id", "context_condition", "repetition"}
    if shared:
        raise ValueError(f"items reveal {sorted(shared)}")
    write_once(items, f"{folder}/items")
    write_once(item_map, f"{folder}/map")


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores, 180 characters at most; a name that has none of them
    fails the query."""
    clean = lambda c: F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9._-]++", "-"), F.lit("-._"))
    # Where a name's beginning alone gives 180 characters, the rest can't change them: the last is at no end that is trimmed.
    begin, whole = clean(F.substring(name, 1, 1024)), clean(name)
    named = F.when(whole == "", F.raise_error(F.lit("an identifier without characters for a file name"))).otherwise(F.substring(whole, 1, 180))
    return F.when(F.length(begin) >= 180, F.substring(begin, 1, 180)).otherwise(named)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """name (the path below root), length and content of all files of a folder, nested ones too.

    Spark's readers pass over empty files, so these come from the folder's listing.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = store.makeQualified(path).toString().rstrip("/") + "/"
    listing, empty = store.listFiles(path, True), []
    while listing.hasNext():
        f = listing.next()
        if not f.getLen():
            empty.append((f.getPath().toString()[len(top) :],))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.select(F.expr(f"substring(path, {len(top) + 1})").alias("name"), "length", "content")
    return found.unionByName(spark.createDataFrame(empty, "name string").select("name", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def file_digests(spark: SparkSession, root: str, portable: bool = False) -> DataFrame:
    """name, length and SHA-256 of a folder's files; portable digests don't depend on line ends."""
    f, content = read_files(spark, root), F.col("content")
    if portable:
        from cohortflow.functions.hashing import portable_hash

        return f.select("name", "length", portable_hash(F.decode(content, "UTF-8")).alias("sha256"))
    return f.select("name", "length", F.sha2(content, 256).alias("sha256"))


#: Bytes of a file that are hashed at once.
PIECE = 1 << 20


def tree_digest(files: DataFrame) -> DataFrame:
    """One row: the SHA-256 of name, a zero byte, content and a zero byte of every file in order of name, and their number.

    files: name, length and content. Such a hash is one chain, so one task folds it, from pieces of a megabyte that a sort
    (which can spill) puts in order; it never holds a whole file.
    """
    import pyarrow as pa

    pieces = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / PIECE).cast("int")))
    cut = files.select("name", pieces.alias("at"), "content").select("name", "at", F.expr(f"substring(content, at * {PIECE} + 1, {PIECE})").alias("piece"))

    def fold(batches):
        import hashlib

        h, n, last = hashlib.sha256(), 0, None
        for batch in batches:
            for name, piece in zip(batch.column("name").to_pylist(), batch.column("piece"), strict=True):
                if name != last:
                    h.update((b"\0" if n else b"") + name.encode() + b"\0")
                    n, last = n + 1, name
                h.update(piece.as_buffer() or b"")
        if n:
            h.update(b"\0")
        yield pa.RecordBatch.from_pydict({"tree_sha256": [h.hexdigest()], "files": [n]})

    return cut.repartition(1).sortWithinPartitions("name", "at").mapInArrow(fold, "tree_sha256 string, files long")


#: Lines of a manifest that hold no digest start with one of these.
MANIFEST_HEADS = ("ANALYSIS ", "Git commit:", "Created:")


def manifest_problems(spark: SparkSession, manifest: str, digests: DataFrame) -> DataFrame:
    """Files of a manifest (lines of a digest, two blanks and the path below the folder) that are missing or changed, and
    files that it doesn't list. Digests match in either case; a line of another form fails the query, as does a manifest
    without entries."""
    lines = spark.read.text(manifest).withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    some = lines.where((F.trim("value") != "") & ~F.col("value").rlike("^(" + "|".join(MANIFEST_HEADS) + ")"))
    form = r"^([0-9A-Fa-f]{64})\s{2}(.+)$"
    broken = F.raise_error(F.concat(F.lit("malformed manifest line: "), F.col("value")))
    named = some.select(F.lower(F.regexp_extract("value", form, 1)).alias("expected"), F.when(F.col("value").rlike(form), F.regexp_extract("value", form, 2)).otherwise(broken).alias("name"))
    j = named.join(digests.select("name", "sha256"), "name", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("expected") != F.col("sha256"), "changed")
    entries = F.broadcast(named.agg(F.count("*").alias("_entries")))  # one row
    empty = F.raise_error(F.lit("the manifest has no entries"))
    return entries.join(j.withColumn("problem", problem), F.lit(True), "left").select("name", F.when(F.col("_entries") > 0, F.col("problem")).otherwise(empty).alias("problem")).where("problem IS NOT NULL")
