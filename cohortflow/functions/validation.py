"""Rules of the entities' schemas as named conditions, for `integrity.expectations` and `integrity.failed_checks`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortflow.functions.ratings import ALL_AXES, ALLOWED, ALLOWS_NA


def script_rules(turns: str = "turns", expected: int = 6) -> dict[str, Column]:
    return {"six_turns": F.size(turns) == expected, "no_blank_turn": F.forall(turns, lambda t: F.trim(t) != "")}


def prefix_rules(messages: str = "messages") -> dict[str, Column]:
    """Even length, user and assistant in turn."""
    roles = F.transform(messages, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return {"even_length": F.size(messages) % 2 == 0, "alternating": F.forall(roles, lambda ok: ok)}


def model_rules(slug: str = "requested_model_id") -> dict[str, Column]:
    s = F.lower(F.col(slug))
    return {"free_slug": s.endswith(":free"), "not_a_router": ~s.contains("/auto") & ~s.contains("router"), "not_latest": ~s.contains("latest"), "no_placeholder": ~s.contains("placeholder")}


def response_rules(text: str = "text", words: str = "visible_word_count", truncated: str = "truncated", finish: str = "finish_reason") -> dict[str, Column]:
    from cohortflow.functions.text import visible_metrics

    return {
        "has_text": F.trim(F.coalesce(F.col(text), F.lit(""))) != "",
        "counts_match": F.col(words) == visible_metrics(F.col(text))["visible_words"],
        "truncation_consistent": F.col(truncated) == (F.lower(F.trim(F.coalesce(F.col(finish), F.lit("")))) == "length"),
    }


def rating_rules() -> dict[str, Column]:
    """Each axis holds an allowed score, "N/A" where the axis allows it, or nothing."""
    out = {}
    for a in ALL_AXES:
        allowed = [str(v) for v in ALLOWED[a]] + (["N/A"] if a in ALLOWS_NA else [])
        out[f"{a}_in_domain"] = F.col(a).isNull() | F.col(a).isin(*allowed)
    return out


def judge_rules(rationale: str = "rationale") -> dict[str, Column]:
    return {"complete": F.expr(" AND ".join(f"{a} IS NOT NULL" for a in ALL_AXES)), "rationale_length": F.length(F.trim(F.col(rationale))).between(1, 1000)} | rating_rules()
