"""Ordinal ratings that may be "N/A": three readings of one raw value, and reshaping between wide and long.

A rating is 'N/A' or an integer as a string; a score is an integer, null where the rating is 'N/A' or missing. "N/A"
counts as a complete rating, but never as a number. Missing is always SQL null, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rating axes, the values each allows, and the axes that allow "N/A".
AXES = ("A1", "A2", "A3")
ALL_AXES = ("A1", "A2", "A3", "B1", "B2", "B3", "C1")
ALLOWED = {"A1": (0, 1, 2), "A2": (0, 1, 2), "A3": (0, 1), "B1": (0, 1, 2), "B2": (0, 1, 2), "B3": (0, 1, 2), "C1": (0, 1, 2)}
ALLOWS_NA = ("A2", "A3")


def _text(raw: Column) -> Column:
    return F.upper(F.trim(raw.cast("string")))


def score(raw: Column, axis: str) -> Column:
    """The number of a rating in the axis' domain, else null ('2.0' is 2; 99, 'x' and 'N/A' are null)."""
    number = _text(raw).try_cast("double")
    return F.when(number.isin(*map(float, ALLOWED[axis])), number.cast("int"))


def rating(raw: Column, axis: str) -> Column:
    """'N/A' on axes that allow it, else the score as a string, else null."""
    number = score(raw, axis).cast("string")
    return F.when(_text(raw) == "N/A", F.lit("N/A")).otherwise(number) if axis in ALLOWS_NA else number


def lenient_rating(raw: Column) -> Column:
    """'N/A' on any axis or an integer literal as a string, without a domain; else null."""
    return F.when(_text(raw) == "N/A", F.lit("N/A")).otherwise(F.trim(raw.cast("string")).try_cast("int").cast("string"))


def numeric_view(raw: Column) -> Column:
    """Any number; 'N/A' and missing are null."""
    return F.trim(raw.cast("string")).try_cast("double")


def canonical_rating(raw: Column) -> Column:
    """A string for every value: integers without a fraction, null and 'N/A' as 'N/A', anything else as it is."""
    text = F.trim(raw.cast("string"))
    number = text.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("long").cast("string"))
    return F.when(text.isNull() | F.upper(text).isin("N/A", "", "NAN"), F.lit("N/A")).otherwise(F.coalesce(whole, text))


def valid_turn(raw: Column) -> Column:
    """A whole turn number of at least 1 as an integer, else null."""
    number = raw.try_cast("double") if hasattr(raw, "try_cast") else raw.cast("double")
    return F.when((number >= 1) & (number % 1 == 0), number.cast("int"))


def with_axes(frame: DataFrame, axes: Sequence[str]) -> DataFrame:
    """The frame with a null column for every axis that it lacks."""
    return frame.withColumns({a: F.lit(None).cast("string") for a in axes if a not in frame.columns})


def one_or_missing(value: Column) -> Column:
    """Within a group: the one value that all non-null rows share, else null."""
    return F.when(F.min(value) == F.max(value), F.max(value))


def long_ratings(frame: DataFrame, keys: Sequence[str], axes: Sequence[str] = ALL_AXES, name: str = "axis", value: str = "raw") -> DataFrame:
    """A row per key and axis."""
    cast = with_axes(frame, axes).select(*keys, *(F.col(a).cast("string").alias(a) for a in axes))
    return cast.unpivot(list(keys), list(axes), name, value)


def wide_ratings(long: DataFrame, keys: Sequence[str], axes: Sequence[str] = ALL_AXES, name: str = "axis", value: str = "raw") -> DataFrame:
    """A row per key with a column per axis, the first non-null value of each."""
    return long.groupBy(*keys).pivot(name, list(axes)).agg(F.min(value))


def tidy_rows(events: DataFrame, axes: Sequence[str] = ALL_AXES) -> DataFrame:
    """One row per annotation event and axis, with the event's revision of its (item, annotator) in log order."""
    from pyspark.sql import Window

    order = Window.partitionBy("item_id", "annotator_id").orderBy("log_index")
    keys = ["annotation_id", "item_id", "annotator_id", "log_index", "revision"]
    return long_ratings(events.withColumn("revision", F.row_number().over(order)), keys, axes)
