"""Classification of call results and catalogue entries: ordered rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status codes that pass, transport errors, and errors that stop a study.
TRANSIENT = (408, 429, 500, 502, 503, 504)
TRANSPORT = ("ConnectError", "ConnectTimeout", "NetworkError", "PoolTimeout", "ReadError", "ReadTimeout", "RemoteProtocolError", "WriteError", "WriteTimeout")
HARD_STOP = ("configuration_mismatch", "duplicate_success", "malformed_evidence", "resolved_model_mismatch")


def classify_errors(frame: DataFrame, error: str = "error_type", upstream: str | None = None, finish: str | None = None, responded: str | None = None) -> DataFrame:
    """Adds retryable, category, reason_code and upstream_code to results.

    `upstream` names the column of an embedded status code, `finish` and `responded` those of finished responses.
    """
    e = F.coalesce(F.col(error), F.lit("unknown_error"))
    outer = F.regexp_extract(e, r"^http_(\d{3})$", 1).try_cast("int")
    inner = F.regexp_extract(e, r"^upstream_http_(\d{3})$", 1).try_cast("int")
    embedded = F.col(upstream).try_cast("int") if upstream else F.lit(None).cast("int")
    embedded = F.when((e == "provider_body_error") & embedded.between(100, 599), embedded)
    code = F.coalesce(inner, embedded)
    is_response = F.col(responded) if responded else F.lit(False)
    stopped = F.lower(F.trim(F.col(finish))) == "stop" if finish else F.lit(False)
    category = (
        F.when(is_response & F.coalesce(stopped, F.lit(False)), "success")
        .when(is_response | e.isin(*HARD_STOP), "scientific_hard_stop")
        .when(outer.isNotNull(), F.when(outer.isin(*TRANSIENT), "outer_http_transient").otherwise("permanent"))
        .when(code == 402, "operator_recoverable")
        .when(code.isNotNull(), F.when(code.isin(*TRANSIENT), "upstream_transient").otherwise("permanent"))
        .when(e.isin(*TRANSPORT, "catalogue_preflight_error"), "transport_transient")
        .otherwise("permanent")
    )
    reason = F.when(is_response, F.when(category == "success", "response").otherwise("incomplete_result")).when(embedded.isNotNull(), F.concat(F.lit("upstream_http_"), embedded.cast("string"))).otherwise(e)
    return frame.withColumns({"category": category, "retryable": category.isin("outer_http_transient", "upstream_transient", "transport_transient"), "reason_code": reason, "upstream_code": F.when(is_response, None).otherwise(code)})


def finish_status(finish: Column) -> Column:
    """unreported (null or blank), reported_stop, reported_length or reported_other; case and surrounding blanks don't count."""
    clean = F.lower(F.trim(finish))
    return F.when(clean.isNull() | (clean == ""), "unreported").when(clean == "stop", "reported_stop").when(clean == "length", "reported_length").otherwise("reported_other")


def http_attempts(attempts: Column, exhausted: Column, retries: Column) -> Column:
    """Recorded attempts, else none where the budget was spent before, else one more than the retries."""
    return F.coalesce(attempts, F.when(F.coalesce(exhausted, F.lit(False)), F.lit(0)).otherwise(F.coalesce(retries, F.lit(0)) + 1))


def retry_wait(failures: Column, first: float = 3.0, most: float = 60.0) -> Column:
    """Seconds before the next attempt: doubling up to the most."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), failures - 1))


#: What an eligible model must advertise.
MIN_CONTEXT, MIN_COMPLETION, HORIZON_DAYS = 32_768, 4_096, 30
RETIRED = ("expired", "deprecated", "retired", "unavailable")
LIMIT_PARAMETERS = ("max_completion_tokens", "max_tokens")


def eligibility(entries: DataFrame, retrieved_at: str | Column, banned: tuple[str, ...] = ()) -> DataFrame:
    """Adds eligible and rejection_reasons (sorted, distinct) to catalogue entries.

    Columns: id, canonical_slug, prompt_price, completion_price, input_modalities, output_modalities, parameters,
    context_length, completion_limits (array of numbers), availability, status, expires_at. Whatever can't be verified
    counts against an entry.
    """
    at = F.to_timestamp(F.lit(retrieved_at) if isinstance(retrieved_at, str) else retrieved_at)
    price = lambda c: F.col(c).try_cast("decimal(38,18)")
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    limit = F.array_max(F.filter("completion_limits", lambda x: x > 0))
    expires = F.try_to_timestamp(F.col("expires_at"))
    given = F.coalesce(F.col("expires_at"), F.lit("")) != ""
    slug = F.lower(F.trim(F.col("id")))
    rules = [
        ("excluded_comparator", slug.isin(*banned) if banned else F.lit(False)),
        ("not_exact_free_slug", ~slug.endswith(":free") | ~slug.contains("/")),
        ("router_or_unstable_alias", slug.contains("latest") | slug.contains("router/") | slug.endswith("/auto")),
        ("canonical_slug_mismatch_or_alias", F.coalesce("canonical_slug", "id") != F.col("id")),
        ("pricing_unverifiable", price("prompt_price").isNull() | price("completion_price").isNull()),
        ("nonzero_prompt_or_completion_price", (price("prompt_price") != 0) | (price("completion_price") != 0)),
        ("text_input_not_advertised", ~has("input_modalities", "text")),
        ("text_output_not_advertised", ~has("output_modalities", "text")),
        ("seed_not_advertised", ~has("parameters", "seed")),
        ("explicit_completion_limit_parameter_not_advertised", ~(has("parameters", LIMIT_PARAMETERS[0]) | has("parameters", LIMIT_PARAMETERS[1]))),
        ("maximum_completion_capability_unverifiable", limit.isNull()),
        ("maximum_completion_capability_below_4096", limit < MIN_COMPLETION),
        ("context_length_below_study_minimum", F.col("context_length").isNull() | (F.col("context_length") < MIN_CONTEXT)),
        ("batch_only_endpoint", F.lower("availability").isin("batch", "batch_only")),
        ("expired_deprecated_or_unavailable", F.lower("status").isin(*RETIRED)),
        ("expiration_unverifiable", given & expires.isNull()),
        ("expired_or_disappearing_within_30_days", expires <= at + F.expr(f"INTERVAL {HORIZON_DAYS} DAYS")),
    ]
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)))))
    preferred = F.when(has("parameters", LIMIT_PARAMETERS[0]), LIMIT_PARAMETERS[0]).when(has("parameters", LIMIT_PARAMETERS[1]), LIMIT_PARAMETERS[1])
    return entries.withColumns({"rejection_reasons": reasons, "eligible": F.size(reasons) == 0, "maximum_completion_capability": limit, "completion_limit_parameter": preferred})


def candidate_order(entries: DataFrame, flag: str = "warned", slug: str = "id") -> DataFrame:
    return entries.orderBy(F.col(flag).asc(), F.lower(slug).asc(), F.col(slug).asc())


def phrase_warnings(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that a text holds as whole words."""
    found = [F.when(F.lower(text).rlike(rf"(?U)(?<!\w){p}(?!\w)"), F.lit(p)) for p in phrases]
    return F.array_compact(F.array(*found))


def leaks(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a payload holds any forbidden term, in any case."""
    return F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(F.lower(text), t))
