"""Integrity constraints. Each gives the rows that break it; require() turns them into an error that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


class Violated(ValueError):
    """A constraint has rows against it."""


def require(offenders: DataFrame, what: str, show: int = 5) -> None:
    rows = offenders.limit(show + 1).collect()
    if rows:
        raise Violated(f"{what}: {[r.asDict() for r in rows[:show]]}" + (" and more" if len(rows) > show else ""))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Children whose foreign key, where it has one, finds no parent. keys: child column -> parent column."""
    known = parents.select(*(F.col(p).alias(c) for c, p in keys.items())).distinct()
    return children.dropna(subset=list(keys)).join(known, list(keys), "left_anti")


def breaking(df: DataFrame, **rules: Column) -> DataFrame:
    """Rows that break a rule, with broken: the names of those that they break. An unknown outcome breaks a rule."""
    named = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    return df.withColumn("broken", F.filter(named, lambda x: x.isNotNull())).filter(F.size("broken") > 0)


def missing_cohorts(df: DataFrame, dimensions: dict[str, list]) -> DataFrame:
    """Combinations of the given values that no row has."""
    spark, grid = df.sparkSession, None
    for name, values in dimensions.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        grid = one if grid is None else grid.crossJoin(one)
    return grid.join(df.select(*dimensions).distinct(), list(dimensions), "left_anti")


def unbalanced_clusters(df: DataFrame, cluster: str, member: str, expected: list) -> DataFrame:
    """Clusters that don't hold each expected member exactly once."""
    return df.groupBy(cluster).agg(F.sort_array(F.collect_list(member)).alias("members")).filter(F.col("members") != F.array(*map(F.lit, sorted(expected))))


def key_order(raw: Column, expected: tuple[str, ...]) -> Column:
    """Whether a JSON object has exactly these keys in this order."""
    return F.coalesce(F.json_object_keys(raw) == F.array(*map(F.lit, expected)), F.lit(False))


def forbidden_paths(schema: DataType, names: set[str], at: str = "") -> list[str]:
    """Paths of fields with forbidden names, at any depth of a schema."""
    if isinstance(schema, ArrayType):
        return forbidden_paths(schema.elementType, names, f"{at}[]")
    if not isinstance(schema, StructType):
        return []
    out = []
    for field in schema:
        path = f"{at}.{field.name}" if at else field.name
        out += [path] if field.name in names else []
        out += forbidden_paths(field.dataType, names, path)
    return out


# How a search may have gone, with the route that was taken, and what that says of dense retrieval: (attempted, contributed), null for either.
ROUTE_STATES = {
    ("hybrid", "hybrid"): (True, True),
    ("hybrid_no_dense_match", "hybrid"): (True, False),
    ("lexical_route", "lexical"): (False, False),
}
REQUIRED_MODES = {"configured_mode": "hybrid", "active_mode": "hybrid"}


def diagnostics_broken(df: DataFrame, removed: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose retrieval diagnostics contradict themselves, with broken: the names of the rules.

    Columns: configured_mode, active_mode, dense_available, embedding_dimension, last_dense_error,
    last_search_mode, query_route, dense_attempted, dense_contributed, route_reason, and
    ambiguous_candidates, an array. removed: columns that must be gone.
    """
    route = F.concat_ws("|", "last_search_mode", "query_route")
    allowed = F.array(*(F.lit("|".join(k)) for k in ROUTE_STATES))
    state = F.concat_ws("|", route, F.col("dense_attempted").cast("string"), F.col("dense_contributed").cast("string"))
    states = F.array(*(F.lit("|".join((*k, *(str(x).lower() for x in v)))) for k, v in ROUTE_STATES.items()))
    return breaking(
        df,
        **{name: F.col(name) == value for name, value in REQUIRED_MODES.items()},
        dense_available=F.col("dense_available"),
        embedding_dimension=F.col("embedding_dimension") >= 1,
        last_dense_error=F.col("last_dense_error").isNull(),
        route=F.array_contains(allowed, route),
        dense_state=F.array_contains(states, state),
        route_reason=F.col("route_reason") != "",
        ambiguous_candidates=F.col("ambiguous_candidates").isNotNull(),
        **{f"removed_{c}": F.lit(False) for c in removed if c in df.columns},
    )


def case_totals(cases: DataFrame, group: str, case_id: str, expected: dict[str, int]) -> DataFrame:
    """(group, expected, found) where the number of cases isn't what it has to be, groups that nobody expects (expected 0) too. A case without an id isn't one; one that is there twice counts once more, so it shows."""
    spark = cases.sparkSession
    wanted = spark.createDataFrame(sorted(expected.items()), f"`{group}` string, expected long")
    found = cases.filter(F.coalesce(F.trim(case_id), F.lit("")) != "").groupBy(group).agg(F.count("*").alias("found"))
    both = wanted.join(found, group, "full_outer").select(group, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.filter("expected <> found")


def check_cases(cases: DataFrame, group: str, case_id: str, expected: dict[str, int]) -> None:
    """Stop unless every group has exactly as many cases as expected, each with an id of its own."""
    require(cases.filter(F.coalesce(F.trim(case_id), F.lit("")) == "").select(group, case_id), "cases have no id")
    require(duplicate_keys(cases, [case_id]), "cases are there twice")
    require(case_totals(cases, group, case_id, expected), "there are more or fewer cases than expected")


def review_document(rows: DataFrame, document: str, position: str, item: str, source: str, note: str, needs_note: Column, prefix: Column, units: DataFrame) -> DataFrame:
    """Breaches of a review document's rules as (document, item, broken), one row an item; units: the (document, source) pairs that have to be there.

    order: sources don't descend along position; id: the item is the prefix, a dash and the item's running number
    of two digits at least; note: items that need a note have one; unknown: the source is none of the units.
    A unit without an item is a row with no item and broken missing.
    """
    here = W.partitionBy(document).orderBy(position, item)
    numbered = rows.withColumn("__n", F.row_number().over(here)).withColumn("__before", F.lag(source).over(here))
    known = units.select(document, F.col(source)).distinct().withColumn("__known", F.lit(True))
    numbered = numbered.join(known, [document, source], "left")
    number = F.when(F.col("__n") < 100, F.lpad(F.col("__n").cast("string"), 2, "0")).otherwise(F.col("__n").cast("string"))
    found = breaking(
        numbered, order=F.col("__before").isNull() | (F.col("__before") <= F.col(source)), id=F.col(item) == F.concat(prefix, F.lit("-"), number),
        note=~needs_note | (F.trim(F.coalesce(F.col(note), F.lit(""))) != ""), unknown=F.col("__known").isNotNull(),
    )
    missing = known.join(rows.select(document, source).distinct(), [document, source], "left_anti")
    return found.select(document, item, "broken").unionByName(missing.select(document, F.lit(None).cast(rows.schema[item].dataType).alias(item), F.array(F.lit("missing")).alias("broken")))


def frozen_figures(rows: DataFrame, stated: DataFrame, group: list[str], value: str, n: str, mean: str, tolerance: float = 1e-9) -> DataFrame:
    """(group, broken): groups whose rows don't give what a frozen summary states: their number, and the mean computed anew within tolerance. A group on one side only is missing or unexpected."""
    anew = rows.groupBy(*group).agg(F.count("*").alias("__n"), F.avg(value).alias("__mean"))
    both = stated.select(*group, F.col(n).alias("__stated_n"), F.col(mean).alias("__stated_mean")).join(anew, group, "full_outer")
    close = F.abs(F.col("__mean") - F.col("__stated_mean")) <= tolerance
    return breaking(
        both, missing=F.col("__n").isNotNull(), unexpected=F.col("__stated_n").isNotNull(), rows=F.col("__n").isNull() | F.col("__stated_n").isNull() | (F.col("__n") == F.col("__stated_n")),
        mean=F.col("__n").isNull() | F.col("__stated_n").isNull() | F.coalesce(close, F.col("__mean").isNull() & F.col("__stated_mean").isNull()),
    ).select(*group, "broken")
