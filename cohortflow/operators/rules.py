"""Validation by versioned rule files: each rule is a named SQL condition on rows, on groups or on the whole table.

A file has a version and an ordered list of rules. A row rule must hold in every row, a group rule is a condition on
aggregates that must hold in every group of its `by` columns, a table rule is one on the aggregates of all rows. A condition
that is null doesn't hold. Parameters are columns of the struct `param`; a condition on aggregates takes them by any_value.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELDS = {"row": {"name", "level", "check"}, "table": {"name", "level", "check"}, "group": {"name", "level", "check", "by"}}


@dataclass(frozen=True)
class Rule:
    name: str
    level: str
    check: str
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...]


def rule_set(document: Mapping) -> RuleSet:
    """The rules of a parsed file; unknown fields or levels, missing ones and repeated names are refused."""
    if set(document) != {"version", "rules"} or not document["rules"]:
        raise ValueError(f"a rule file has a version and rules, not {sorted(document)}")
    rules = []
    for r in document["rules"]:
        if r.get("level") not in _FIELDS or set(r) != _FIELDS[r["level"]] or not all(r.values()):
            raise ValueError(f"not a rule: {r}")
        rules.append(Rule(r["name"], r["level"], r["check"], tuple(r.get("by", ()))))
    names = [r.name for r in rules]
    if repeated := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"rules repeat: {repeated}")
    return RuleSet(document["version"], tuple(rules))


def bundled(name: str) -> RuleSet:
    """A rule file that comes with the library."""
    return rule_set(json.loads(resources.files("cohortflow").joinpath("rulesets", f"{name}.json").read_text()))


def _with(frame: DataFrame, param: Column | None) -> DataFrame:
    return frame if param is None else frame.withColumn("param", param)


def violations(frame: DataFrame, rules: RuleSet, param: Column | None = None) -> DataFrame:
    """A row per rule, in their order: position, rule, level, violations (rows, groups, or 1 for the table) and passes.

    Row and table rules are one aggregate over the frame; group rules are one each for their `by` columns.
    """
    own = _with(frame, param)
    number = lambda broken: F.coalesce(F.sum(F.when(broken, 1).otherwise(0)), F.lit(0)).cast("long")
    broken = lambda r: ~F.coalesce(F.expr(r.check), F.lit(False))
    place = {r.name: i for i, r in enumerate(rules.rules, 1)}
    parts = []
    together = [r for r in rules.rules if r.level != "group"]
    if together:
        counts = own.agg(*((number(broken(r)) if r.level == "row" else broken(r).cast("long")).alias(f"r{place[r.name]}") for r in together))
        parts.append(counts.unpivot([], [f"r{place[r.name]}" for r in together], "key", "violations").select(F.substring("key", 2, 9).cast("int").alias("position"), "violations"))
    for by in dict.fromkeys(r.by for r in rules.rules if r.level == "group"):
        some = [r for r in rules.rules if r.by == by and r.level == "group"]
        groups = own.groupBy(*by).agg(*(broken(r).alias(f"r{place[r.name]}") for r in some))
        counts = groups.agg(*(number(F.col(f"r{place[r.name]}")).alias(f"r{place[r.name]}") for r in some))
        parts.append(counts.unpivot([], [f"r{place[r.name]}" for r in some], "key", "violations").select(F.substring("key", 2, 9).cast("int").alias("position"), "violations"))
    named = lambda of: F.element_at(F.array(*(F.lit(of(r)) for r in rules.rules)), F.col("position"))
    found = reduce(DataFrame.unionByName, parts)
    return found.select("position", named(lambda r: r.name).alias("rule"), named(lambda r: r.level).alias("level"), "violations", (F.col("violations") == 0).alias("passes"))


def broken_rules(frame: DataFrame, rules: RuleSet, param: Column | None = None, into: str = "failed") -> DataFrame:
    """Every row with the names of the row rules that it breaks, in the rules' order. Other rules aren't looked at."""
    own = _with(frame, param)
    names = F.array(*(F.when(~F.coalesce(F.expr(r.check), F.lit(False)), F.lit(r.name)) for r in rules.rules if r.level == "row"))
    found = own.withColumn(into, F.array_compact(names))
    return found if param is None else found.drop("param")


def enforced(frame: DataFrame, rules: RuleSet, keys: Sequence[str], param: Column | None = None) -> DataFrame:
    """The frame; the query fails at the first row that breaks a row rule and says its keys and what it breaks."""
    found = broken_rules(frame, rules, param, "_failed")
    said = F.concat(F.lit(f"{rules.version}: "), F.to_json(F.struct(*keys)), F.lit(" breaks "), F.array_join("_failed", ", "))
    return found.where(F.when(F.size("_failed") > 0, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).drop("_failed")
