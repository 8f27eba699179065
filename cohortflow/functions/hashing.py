"""Hashes and opaque tokens. The keyed token is a native HMAC-SHA256, so blinding needs no Python rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def response_hash(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes; blank texts have none."""
    return F.when(F.trim(text) != "", F.sha2(text, 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column under a fixed key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in block).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in block).hex()))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def opaque_token(key: bytes, purpose: str, parts: Sequence[Column]) -> Column:
    """Twenty base-32 letters of the HMAC of purpose and parts, joined by a unit separator."""
    digest = hmac_sha256(key, F.concat_ws("\x1f", F.lit(purpose), *(p.cast("string") for p in parts)))
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(5)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567")


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def canonical(value) -> str:
    """Compact JSON with sorted keys and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json_hash(texts: pd.Series) -> pd.Series:
    """The canonical hash of JSON texts, whatever their key order and spacing; null where a text isn't JSON."""

    def one(t):
        try:
            return None if t is None else canonical_hash(json.loads(t))
        except ValueError:
            return None

    return texts.map(one)


def portable_hash(text: Column) -> Column:
    """SHA-256 that doesn't depend on the line ends of the system a file was saved on."""
    return F.sha2(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), 256)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON texts with sorted keys and no spaces; null where a text isn't JSON."""

    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return texts.map(one)


#: What a version of the generation settings lacks unless it is this one, and what versions before the second have not.
GENERATION, LATER_SETTINGS, ROUTING = "generation-v4", ("completion_limit_parameter", "visible_response_instruction", "reasoning_policy"), "provider_routing"


def versioned_models(models: dict) -> dict:
    """A models document without the fields that its version's hash never covered."""
    out = dict(models)
    if (out.get("generation") or {}).get("version") != GENERATION:
        out["generation"] = {k: v for k, v in (out.get("generation") or {}).items() if k not in LATER_SETTINGS}
        out["model_slots"] = {name: {k: v for k, v in slot.items() if k != LATER_SETTINGS[0]} for name, slot in (out.get("model_slots") or {}).items()}
    if str(out.get("version", "")).startswith("1."):
        out.pop(ROUTING, None)
    return out


@F.pandas_udf(T.StringType())
def canonical_models(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else canonical(versioned_models(json.loads(t))))


def bundle_hashes(documents: DataFrame, bundle: str = "bundle_id") -> DataFrame:
    """(bundle, bundle_sha256): one hash over each bundle's scripts, histories and models.

    documents: bundle, kind (scripts, histories or models), document_id and document, a JSON text. Scripts and histories
    go in order of their ids; a bundle has one models document, else the query fails, as it does for a text that isn't
    JSON. Canonical parts are put together as columns: a bundle is a configuration, so it fits in a row.
    """
    broken = F.raise_error(F.concat(F.lit("not JSON: "), F.coalesce("document_id", F.lit("null"))))
    text = F.when(F.col("kind") == "models", canonical_models("document")).otherwise(canonical_json("document"))
    rows = documents.select(bundle, "kind", "document_id", text.alias("_t")).withColumn("_t", F.coalesce("_t", broken))
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("document_id", "_t")))), lambda x: x["_t"]), ",")
    n = F.count(F.when(F.col("kind") == "models", 1))
    found = rows.groupBy(bundle).agg(listed("scripts").alias("s"), listed("histories").alias("h"), F.max(F.when(F.col("kind") == "models", F.col("_t"))).alias("m"), n.alias("n"))
    one = F.when(F.col("n") == 1, F.col("m")).otherwise(F.raise_error(F.lit("a bundle has one models document")))
    whole = F.concat(F.lit('{"histories":['), "h", F.lit('],"models":'), one, F.lit(',"scripts":['), "s", F.lit("]}"))
    return found.select(bundle, F.sha2(whole, 256).alias("bundle_sha256"))
