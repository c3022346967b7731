"""Evaluation metrics: percentiles, cohort rates, transitions, paired comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.vectors import wilson
from tessera.session import kept


def percentile_linear(value: Column, p: float) -> Column:
    """Interpolated between the two nearest values. A group's distinct values meet in one row: for small groups; see percentiles()."""
    return F.percentile(value, F.lit(p))


def percentile_lower_index(value: Column, p: float) -> Column:
    """The value at place floor((n - 1) * p), from 0; nulls left out. Neither interpolated nor a nearest rank. A group's values meet in one row: for small groups; see lower_index()."""
    values = F.sort_array(F.collect_list(value))
    return F.when(F.size(values) > 0, F.element_at(values, F.floor((F.size(values) - 1) * F.lit(p)).cast("int") + 1))


def lower_index(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, name for each of shares): as percentile_lower_index(), for groups of any size. Equal values are counted first, and a group's distinct values are passed in order, none of them held."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    order = W.partitionBy(*group).orderBy(value)
    total = F.sum("__n").over(W.partitionBy(*group))
    placed = counted.withColumn("__upto", F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("__all", total)
    reached = lambda p: F.min(F.when(F.col("__upto") > F.floor((F.col("__all") - 1) * F.lit(p)), F.col(value)))
    return placed.groupBy(*group).agg(*(reached(p).alias(name) for name, p in shares.items()))


def percentile_nearest_rank(value: str, p: float) -> Column:
    """The value at place ceil(n * p), from 1."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


#: Buckets that a value's range is cut into in each round; and rows of a bucket that are few enough to be sorted in one task.
CUTS, FEW = 1024, 100_000


def at_places(df: DataFrame, group: list[str], value: str, places: DataFrame) -> DataFrame:
    """places (group, place, from 0) with value: what stands at each place of its group's sorted values. No task holds a group.

    In rounds, the range in which a place lies is cut into buckets, these are counted, and the place is
    known within one of them. Buckets of FEW rows are sorted; one whose values are equal is their value.
    """
    own = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v"))
    spans = own.groupBy(*group).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__n"))
    open_ = kept(places.select(*group, "place").distinct().withColumn("__at", F.col("place").cast("long")).join(spans, group), "places")
    done, same = [], [*group, "__lo", "__hi"]

    def rows(of: DataFrame) -> DataFrame:
        return own.join(of.select(*same).distinct(), group).filter(F.col("__v").between(F.col("__lo"), F.col("__hi")))

    while True:
        done.append(open_.filter("__lo = __hi").select(*group, "place", F.col("__lo").alias("value")))
        open_ = open_.filter("__lo < __hi")
        largest = open_.agg(F.max("__n")).first()[0] or 0
        if largest <= FEW:
            break
        cut = F.least(F.lit(CUTS - 1), F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * CUTS)).cast("int")
        counted = rows(open_).groupBy(*same, cut.alias("__cut")).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        counted = counted.withColumn("__before", F.sum("__n").over(W.partitionBy(*same).orderBy("__cut")) - F.col("__n"))
        inside = open_.drop("__n").join(counted, same).filter((F.col("__before") <= F.col("__at")) & (F.col("__at") < F.col("__before") + F.col("__n")))
        open_ = kept(inside.select(*group, "place", (F.col("__at") - F.col("__before")).alias("__at"), F.col("__low").alias("__lo"), F.col("__high").alias("__hi"), "__n"), "places")
    ranked = rows(open_).withColumn("__at", (F.row_number().over(W.partitionBy(*same).orderBy("__v")) - 1).cast("long"))
    done.append(open_.join(ranked, [*same, "__at"]).select(*group, "place", F.col("__v").alias("value")))
    return reduce(DataFrame.unionByName, done)


LINEAR, LOWER, NEAREST = "linear", "lower", "nearest"


def percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, tuple[str, float]]) -> DataFrame:
    """(group, name for each of shares): exact percentiles of groups of any size. A share is (kind, p).

    linear: interpolated between the values around place (n - 1) * p; lower: the value at the place below it;
    nearest: the value at place ceil(n * p), from 1. Groups without a value are left out.
    """
    own = df.filter(F.col(value).isNotNull())
    sizes = own.groupBy(*group).agg(F.count("*").alias("__size"))
    if (sizes.agg(F.max("__size")).first()[0] or 0) <= FEW:  # each group fits one task: the same figures by one aggregation
        direct = {LINEAR: lambda p: percentile_linear(F.col(value), p), LOWER: lambda p: percentile_lower_index(F.col(value), p), NEAREST: lambda p: percentile_nearest_rank(value, p)}
        return own.groupBy(*group).agg(*(direct[kind](p).cast("double").alias(name) for name, (kind, p) in shares.items()))
    wanted = []
    for name, (kind, p) in shares.items():
        at = (F.col("__size") - 1) * F.lit(p)
        ends = {LINEAR: (F.floor(at), F.ceil(at)), LOWER: (F.floor(at),) * 2, NEAREST: (F.greatest(F.ceil(F.col("__size") * F.lit(p)) - 1, F.lit(0)),) * 2}[kind]
        wanted.append(F.struct(F.lit(name).alias("name"), *(e.cast("long").alias(c) for e, c in zip(ends, ("below", "above"), strict=True)), (at - F.floor(at) if kind == LINEAR else F.lit(0.0)).alias("part")))
    wanted = kept(sizes.select(*group, F.explode(F.array(*wanted)).alias("x")).select(*group, "x.*"), "wanted")
    places = wanted.select(*group, F.col("below").alias("place")).unionByName(wanted.select(*group, F.col("above").alias("place")))
    found = kept(at_places(df, group, value, places), "found")
    both = wanted.join(found.withColumnsRenamed({"place": "below", "value": "__a"}), [*group, "below"]).join(found.withColumnsRenamed({"place": "above", "value": "__b"}), [*group, "above"])
    at = F.when(F.col("part") == 0, F.col("__a").cast("double")).otherwise((1 - F.col("part")) * F.col("__a") + F.col("part") * F.col("__b"))
    return both.withColumn("__p", at).groupBy(*group).agg(*(F.max(F.when(F.col("name") == name, F.col("__p"))).alias(name) for name in shares))


def rate(condition: Column, among: Column | None = None) -> Column:
    """The share of rows for which condition holds, of all or of those among; null for none."""
    hit = F.coalesce(condition, F.lit(False))
    return F.avg(hit.cast("double")) if among is None else F.avg(F.when(among, hit.cast("double")))


def effective_mean(value: Column, useful: Column) -> Column:
    """Rows that aren't useful count as 0 and stay in the denominator."""
    return F.avg(F.when(F.coalesce(useful, F.lit(False)), value.cast("double")).otherwise(0.0))


def conditional_mean(value: Column, useful: Column) -> Column:
    return F.avg(F.when(useful, value.cast("double")))


def ordered_mean(df: DataFrame, group: list[str], value: str, order: str, out: str) -> DataFrame:
    """(group, out): the mean of value, added up in the order of a column and, where that is the same, of value, so that it doesn't hang on how rows are dealt to tasks. Rows pass one by one; no group is held."""
    placed = W.partitionBy(*group).orderBy(order, value)
    sofar = df.withColumn("__place", F.row_number().over(placed)).withColumn("__sum", F.sum(value).over(placed.rowsBetween(W.unboundedPreceding, W.currentRow)))
    sums = sofar.groupBy(*group).agg(F.max_by("__sum", "__place").alias("__sum"), F.count(value).alias("__n"))
    return sums.select(*group, F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n")).alias(out))


def rounded(value: Column, digits: int) -> Column:
    """To digits, halves away from 0, of the double times a power of ten; Spark's own round() goes by the shortest decimal that prints as the double."""
    size = F.floor(F.abs(value) * 10.0**digits + 0.5) / 10.0**digits
    return F.when(value < 0, -size).otherwise(size)


def two_level(df: DataFrame, group: list[str], case: str, value: str) -> DataFrame:
    """Repeats averaged per case, then the cases' distribution: cases, requests, mean, median, p95."""
    cases = kept(df.groupBy(*group, case).agg(F.avg(value).alias("__v"), F.count("*").alias("__n")), "cases")
    figures = cases.groupBy(*group).agg(F.count("*").alias("cases"), F.sum("__n").alias("requests"), F.avg("__v").alias("mean_value"))
    return figures.join(percentiles(cases, group, "__v", {"median_value": (LINEAR, 0.5), "p95_value": (LINEAR, 0.95)}), group, "left")


def latency(value: str) -> list[Column]:
    """count, mean, median, nearest-rank p95 and maximum."""
    return [F.count(value).alias("n"), F.avg(value).alias("mean_value"), percentile_linear(F.col(value), 0.5).alias("median_value"), percentile_nearest_rank(value, 0.95).alias("p95_value"), F.max(value).alias("max_value")]


def cohorts(df: DataFrame, outer: str, inner: str, metrics: list[Column], everything: str = "all") -> DataFrame:
    """Metrics for each (outer, inner) and for each outer over all inner, in one pass by grouping sets."""
    grouped = df.groupingSets([[outer, inner], [outer]], outer, inner).agg(F.grouping(inner).alias("__all"), *metrics)
    return grouped.withColumn(inner, F.when(F.col("__all") == 1, F.lit(everything)).otherwise(F.col(inner))).drop("__all")


def rolled_up(df: DataFrame, dimension: str, metrics: list[Column], everything: str = "all") -> DataFrame:
    """Metrics for each value of dimension, and for all rows."""
    grouped = df.rollup(dimension).agg(F.grouping(dimension).alias("__all"), *metrics)
    return grouped.withColumn(dimension, F.when(F.col("__all") == 1, F.lit(everything)).otherwise(F.col(dimension))).drop("__all")


def with_wilson(df: DataFrame, successes: str, n: str) -> DataFrame:
    low, high = wilson(F.col(successes), F.col(n))
    return df.withColumn("low", low).withColumn("high", high)


def transitions(df: DataFrame, case: list[str], order: str, outcome: str) -> DataFrame:
    """(path, cases): each case's outcomes in order, joined by arrows, counted."""
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, outcome))), lambda x: x[outcome]), " -> ")
    return df.groupBy(*case).agg(path.alias("path")).groupBy("path").agg(F.count("*").alias("cases"))


def agreement(df: DataFrame, case: list[str], outcome: Column, answer: Column) -> DataFrame:
    """Over cases with two rows or more: cases, those of one outcome, those of one outcome and answer; and cases with one row."""
    per = df.groupBy(*case).agg(F.count("*").alias("__n"), F.countDistinct(outcome).alias("__o"), F.countDistinct(F.struct(outcome, answer)).alias("__a"))
    several = F.col("__n") > 1
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return per.agg(count(several).alias("cases"), count(several & (F.col("__o") == 1)).alias("identical_outcomes"), count(several & (F.col("__a") == 1)).alias("identical_answers_and_outcomes"), count(~several).alias("unpaired_cases"))


def contingency(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """(before, after, n) over keys that both have."""
    a = left.select(*key, F.col(value).alias("before"))
    b = right.select(*key, F.col(value).alias("after"))
    return a.join(b, key).groupBy("before", "after").agg(F.count("*").alias("n"))


def paired(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key the two values and their difference, right minus left; one is null where only one side has the key."""
    a = left.select(*key, F.col(value).alias("left_value"))
    b = right.select(*key, F.col(value).alias("right_value"))
    return a.join(b, key, "full_outer").withColumn("difference", F.col("right_value") - F.col("left_value"))


def win_tie_loss(pairs: DataFrame) -> DataFrame:
    """Counts over pairs of both values: wins of the right, ties, losses; and the median difference and keys on one side only."""
    d = F.col("difference")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return pairs.agg(count(d > 0).alias("wins"), count(d == 0).alias("ties"), count(d < 0).alias("losses"), percentile_linear(d, 0.5).alias("median_difference"), count(F.col("right_value").isNull()).alias("only_left"), count(F.col("left_value").isNull()).alias("only_right"))


def authority_violations(ranked: DataFrame, group: list[str], rank: str, tier: str) -> DataFrame:
    """(group, violations): rows of a list that stand behind one of lower authority."""
    worse = F.lag(tier).over(W.partitionBy(*group).orderBy(rank)) > F.col(tier)
    return ranked.withColumn("__v", F.coalesce(worse, F.lit(False))).groupBy(*group).agg(F.sum(F.col("__v").cast("long")).alias("violations"))
