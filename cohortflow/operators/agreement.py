"""Agreement between raters. Every figure is an aggregate over pairs of ratings of the same item; none needs the pairs in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNWEIGHTED = ("A3",)


def rater_pairs(raters: DataFrame, sources: Sequence[str]) -> DataFrame:
    """item_id, axis, source_a, source_b, a, b for all pairs of sources in their given order.

    An item's ratings are columns, one for each source; of a source that rates an item twice the largest rating counts.
    """
    own = lambda s: F.col("source") == s
    columns = [x for i, s in enumerate(sources) for x in (F.max(F.when(own(s), F.col("rating"))).alias(f"_r{i}"), F.count(F.when(own(s), 1)).alias(f"_n{i}"))]
    by_item = raters.where(F.col("source").isin(*sources)).groupBy("item_id", "axis").agg(*columns)
    both = [(i, j) for i in range(len(sources)) for j in range(i + 1, len(sources))]
    pair = lambda i, j: F.when((F.col(f"_n{i}") > 0) & (F.col(f"_n{j}") > 0), F.struct(F.lit(sources[i]).alias("source_a"), F.lit(sources[j]).alias("source_b"), F.col(f"_r{i}").alias("a"), F.col(f"_r{j}").alias("b")))
    return by_item.select("item_id", "axis", F.explode(F.array(*(pair(i, j) for i, j in both))).alias("x")).where("x IS NOT NULL").select("item_id", "axis", "x.*")


def _kappa(a: Column, b: Column, weighted: Column, copies: Column | None = None) -> Column:
    """Cohen's kappa over the fixed categories 0, 1, 2 of numeric pairs; null below two pairs or without expected disagreement."""
    ok, c = a.isNotNull() & b.isNotNull(), F.lit(1) if copies is None else copies
    n = F.coalesce(F.sum(F.when(ok, c)), F.lit(0))
    mean = lambda x: F.sum(F.when(ok, x * c)) / F.sum(F.when(ok, c))
    p = [mean((a == k).cast("double")) for k in (0, 1, 2)]
    q = [mean((b == k).cast("double")) for k in (0, 1, 2)]
    far = mean(F.abs(a - b) / 2.0)
    expected_far = sum((abs(i - j) / 2.0 * p[i] * q[j] for i in range(3) for j in range(3) if i != j), F.lit(0.0))
    same = mean((a == b).cast("double"))
    expected_same = p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    linear = F.when(expected_far > 1e-15, 1 - far / expected_far)
    plain = F.when(F.abs(1 - expected_same) > 1e-15, (same - expected_same) / (1 - expected_same))
    return F.when(n >= 2, F.when(weighted, linear).otherwise(plain))


def _numbers() -> tuple[Column, Column]:
    return F.col("a").try_cast("int"), F.col("b").try_cast("int")


def agreement_table(raters: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Per pair of sources and axis: exact agreement with and without "N/A", and kappa; from counts of pairs of ratings."""
    pairs = rater_pairs(raters, sources).groupBy("source_a", "source_b", "axis", "a", "b").agg(F.count("*").alias("n"))
    a, b = _numbers()
    n = F.col("n")
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    numeric = a.isNotNull() & b.isNotNull()
    weighted = ~F.max("axis").isin(*UNWEIGHTED)
    number = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    share = lambda x, of: F.sum(F.when(of, x.cast("double") * n)) / F.sum(F.when(of, n))
    return pairs.groupBy("source_a", "source_b", "axis").agg(
        F.sum("n").alias("n_items_common"),
        number(whole).alias("n_all_ratings"),
        share(F.col("a") == F.col("b"), whole).alias("exact_agreement_including_na"),
        number(numeric).alias("n_numeric_pairs"),
        share(a == b, numeric).alias("exact_agreement_numeric"),
        _kappa(a, b, weighted, n).alias("cohen_kappa"),
        F.when(weighted, "linear_weighted").otherwise("unweighted").alias("kappa_method"),
    )


def confusion(raters: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Counts of (source_a, source_b, axis, score_a, score_b); missing is 'None'."""
    pairs = rater_pairs(raters, sources)
    return pairs.groupBy("source_a", "source_b", "axis", F.coalesce("a", F.lit("None")).alias("score_a"), F.coalesce("b", F.lit("None")).alias("score_b")).agg(F.count("*").alias("n"))


def unanimity(raters: DataFrame, reference: str, judges: Sequence[str]) -> DataFrame:
    """Per axis: on how many items all judges give one rating, and how often the reference gives it too."""
    j = F.col("source").isin(*judges)
    item = raters.groupBy("item_id", "axis").agg(F.min(F.when(j, F.col("rating"))).alias("lo"), F.max(F.when(j, F.col("rating"))).alias("hi"), F.count(F.when(j, F.col("rating"))).alias("votes"), F.max(F.when(F.col("source") == reference, F.col("rating"))).alias("ref"))
    one = (F.col("votes") == len(judges)) & (F.col("lo") == F.col("hi"))
    match = one & (F.col("ref") == F.col("lo"))
    n = lambda c: F.count(F.when(c, 1))
    return item.groupBy("axis").agg(F.count("*").alias("n_items"), n(one).alias("unanimous_items"), n(match).alias("unanimous_matches"), (n(one) / F.count("*")).alias("unanimity_rate"), F.when(n(one) > 0, n(match) / n(one)).alias("match_rate_when_unanimous"), (n(match) / F.count("*")).alias("match_rate_all_items"))


def majority_vote(raters: DataFrame, reference: str, judges: Sequence[str]) -> DataFrame:
    """Per axis: the judges' majority (at least half of them and one more) against the reference, "N/A" as a vote like any other."""
    need = len(judges) // 2 + 1
    votes = raters.withColumn("rating", F.coalesce("rating", F.lit("N/A")))
    judge = F.col("source").isin(*judges) & F.col("item_id").isNotNull() & F.col("axis").isNotNull()
    ref = F.col("source") == reference
    by_rating = votes.where(judge | ref).groupBy("item_id", "axis", "rating").agg(F.count(F.when(judge, 1)).alias("c"), F.count(F.when(ref, 1)).alias("m"))
    top = F.max(F.when(F.col("c") > 0, F.struct("c", "rating"))).over(Window.partitionBy("item_id", "axis"))
    # Only counts of (reference, vote) go on: m is how many ratings of the reference a row stands for.
    met = by_rating.select("axis", F.col("rating").alias("ref"), "m", top.alias("top")).where("m > 0")
    rows = met.groupBy("axis", "ref", F.when(F.col("top.c") >= need, F.col("top.rating")).alias("vote"), (F.col("top.c") == len(judges)).alias("all")).agg(F.sum("m").alias("m"))
    rows = rows.select("*", F.col("ref").try_cast("int").alias("a"), F.col("vote").try_cast("int").alias("b"))
    total = F.sum("m")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0)).cast("long")
    available, numeric = F.col("vote").isNotNull(), F.col("a").isNotNull() & F.col("b").isNotNull()
    na_ref, na_vote = F.col("ref") == "N/A", F.col("vote") == "N/A"
    weighted = ~F.max("axis").isin(*UNWEIGHTED)
    share = lambda a, b: F.when(b > 0, a / b)
    return rows.groupBy("axis").agg(
        total.alias("total_items"),
        n(available).alias("majority_available"),
        share(n(available), total).alias("majority_available_rate"),
        n(F.col("all")).alias("judges_unanimous"),
        n(available & (F.col("ref") == F.col("vote"))).alias("exact_matches"),
        share(n(available & (F.col("ref") == F.col("vote"))), n(available)).alias("exact_agreement"),
        n(numeric).alias("numeric_pairs"),
        share(n(numeric & (F.col("a") == F.col("b"))), n(numeric)).alias("numeric_exact_agreement"),
        n(na_ref & na_vote).alias("both_na"),
        n(na_ref & available & ~na_vote).alias("reference_na_only"),
        n(~na_ref & na_vote).alias("majority_na_only"),
        _kappa(F.col("a"), F.col("b"), weighted, F.col("m")).alias("kappa"),
        F.when(weighted, "linear_weighted").otherwise("unweighted").alias("kappa_method"),
    )


def reliability(first: DataFrame, second: DataFrame, keys: Sequence[str], axis: str = "axis", rating: str = "rating") -> DataFrame:
    """Intra- or inter-rater report by axis of two sets of ratings, paired by keys, with the reason where kappa is undefined."""
    a = first.select(*keys, axis, F.col(rating).alias("a"))
    b = second.select(*keys, axis, F.col(rating).alias("b"))
    pairs = a.join(b, [*keys, axis])
    x, y = _numbers()
    numeric = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(numeric, 1))
    kappa = _kappa(x, y, ~F.max(axis).isin(*UNWEIGHTED))
    g = pairs.groupBy(axis).agg(F.count("*").alias("n_common"), n.alias("n_pairs"), F.avg(F.when(numeric, (x == y).cast("double"))).alias("exact_agreement"), kappa.alias("kappa"))
    return g.withColumn("reason", F.when(F.col("n_pairs") < 2, "fewer than two numeric pairs").when(F.col("kappa").isNull(), "no expected disagreement"))


def invalid_pairs(pairs: DataFrame) -> DataFrame:
    """Numeric ratings outside 0..2: the violations that make an agreement figure meaningless."""
    a, b = _numbers()
    out = lambda c: c.isNotNull() & ~c.isin(0, 1, 2)
    return pairs.where(out(a) | out(b))


def _reported(first: DataFrame, second: DataFrame, axes: Sequence[str]) -> DataFrame:
    """A row per axis of two annotations of the same sources, in the axes' order; axes without a pair too."""
    keys = ["run_id", "turn_number"]
    pairs = first.select(*keys, *(F.col(x).alias(f"a_{x}") for x in axes)).join(second.select(*keys, *(F.col(x).alias(f"b_{x}") for x in axes)), keys)
    row = lambda i, x: F.struct(F.lit(i).alias("place"), F.lit(x).alias("axis"), F.col(f"a_{x}").try_cast("int").alias("a"), F.col(f"b_{x}").try_cast("int").alias("b"))
    long = pairs.select(F.explode(F.array(*(row(i, x) for i, x in enumerate(axes)))).alias("p")).select("p.*")
    a, b = F.col("a"), F.col("b")
    valid = a.isNotNull() & b.isNotNull()
    bad = F.raise_error(F.concat(F.lit("scores outside 0 to 2 on "), F.col("axis"))).cast("int")
    checked = long.withColumn("a", F.when(valid & ~(a.isin(0, 1, 2) & b.isin(0, 1, 2)), bad).otherwise(a))
    n = F.count(F.when(valid, 1))
    weighted = ~F.max("axis").isin(*UNWEIGHTED)
    found = checked.groupBy("place", "axis").agg(F.count("*").alias("matched_items"), n.alias("n_pairs"), F.avg(F.when(valid, (a == b).cast("double"))).alias("exact_agreement"), _kappa(a, b, weighted).alias("cohen_kappa"))
    every = pairs.sparkSession.createDataFrame(list(enumerate(axes)), "place int, axis string")
    out = every.join(found.drop("axis"), "place", "left").withColumns({"matched_items": F.coalesce("matched_items", F.lit(0)), "n_pairs": F.coalesce("n_pairs", F.lit(0))})
    plain = F.col("axis").isin(*UNWEIGHTED)
    reason = (
        F.when(F.col("n_pairs") == 0, "No paired complete scores are available for this axis")
        .when(F.col("n_pairs") < 2, "At least two paired complete scores are required for kappa")
        .when(F.col("cohen_kappa").isNull() & plain, "Kappa is undefined because expected disagreement is zero")
        .when(F.col("cohen_kappa").isNull(), "Kappa is undefined because expected weighted disagreement is zero")
    )
    return out.select("axis", "matched_items", "n_pairs", "exact_agreement", "cohen_kappa", F.when(plain, "unweighted").otherwise("linear_weighted").alias("kappa_method"), reason.alias("reason"))


def intra_rater(log: DataFrame, item_map: DataFrame, annotator: str, axes: Sequence[str]) -> DataFrame:
    """One annotator's latest initial scores against the latest re-ratings of the same sources, straight from the log."""
    from cohortflow.operators.events import latest_by_source

    return _reported(latest_by_source(log, item_map, annotator, "initial"), latest_by_source(log, item_map, annotator, "rerating"), axes)


def inter_rater(log: DataFrame, item_map: DataFrame, annotator_a: str, annotator_b: str, axes: Sequence[str], rating_round: str = "initial") -> DataFrame:
    """Two annotators' latest scores of the same sources in one round, straight from the log."""
    from cohortflow.operators.events import latest_by_source

    if annotator_a == annotator_b:
        raise ValueError("two different annotators are needed")
    return _reported(*(latest_by_source(log, item_map, who, rating_round) for who in (annotator_a, annotator_b)), axes)
