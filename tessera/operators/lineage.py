"""Joins that trace records to their sources, and that compare, resume, reuse and overlay tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered_ids(children: DataFrame, parents: DataFrame, key: list[str], foreign: str, parent_key: str, value: str, position: str, out: str = "ids") -> DataFrame:
    """(key, out): values of the parents that children name, distinct, in the order of position."""
    found = children.join(parents.select(F.col(parent_key).alias(foreign), F.col(value).alias("__v")), foreign)
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col("__v").alias("v")))), lambda x: x["v"])
    return found.groupBy(*key).agg(F.array_distinct(listed).alias(out))


def parents_per_child(children: DataFrame, parents: DataFrame, keys: dict[str, str], child: list[str]) -> DataFrame:
    """(child, parents): how many parents each child's composite key finds; 1 is sound. keys: child column -> parent column."""
    marked = parents.select(*(F.col(p).alias(c) for c, p in keys.items()), F.lit(1).alias("__one"))
    return children.join(marked, list(keys), "left").groupBy(*child).agg(F.count("__one").alias("parents"))


def compare(left: DataFrame, right: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """(key, status): missing (only left), unexpected (only right), changed or same, by a hash of content."""
    one = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))  # noqa: E731  (null is like no text)
    digest = F.sha2(F.concat(F.lit(""), *(one(c) for c in content)), 256)
    a = left.select(*key, digest.alias("__a"))
    b = right.select(*key, digest.alias("__b"))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "unexpected").when(F.col("__a") != F.col("__b"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def pending(jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Jobs that aren't done."""
    return jobs.join(done.select(*key).distinct(), key, "left_anti")


def missing_from_grid(dimensions: list[DataFrame], observed: DataFrame, key: list[str]) -> DataFrame:
    """Combinations of the dimensions' rows that were never observed. The grid is meant to be small: cases times variants."""
    grid = dimensions[0]
    for d in dimensions[1:]:
        grid = grid.crossJoin(d)
    return grid.join(observed.select(*key).distinct(), key, "left_anti")


def reuse(packets: DataFrame, reviewed: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """Packets whose digest has been reviewed, and the others."""
    known = reviewed.select(digest).distinct()
    return packets.join(known, digest, "left_semi"), packets.join(known, digest, "left_anti")


def overlay(base: DataFrame, retry: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """base with columns taken from retry where it has the key, as a whole and nulls too; retry's other keys are left out."""
    patch = retry.select(*key, F.struct(*columns).alias("__new"))
    rest = [c for c in base.columns if c not in columns]
    joined = base.join(patch, key, "left").select(*rest, F.coalesce("__new", F.struct(*columns)).alias("__now"), F.col("__new").isNotNull().alias("replaced"))
    return joined.select(*rest, *(F.col(f"__now.{c}").alias(c) for c in columns), "replaced")


def change_partition(before: DataFrame, after: DataFrame, key: list[str], digest: Column, kept: Column) -> DataFrame:
    """(key, part) of after's rows: pending (new), changed, unchanged_kept where kept holds, else reused."""
    a = before.select(*key, digest.alias("__a"))
    b = after.select(*key, digest.alias("__b"), F.coalesce(kept, F.lit(False)).alias("__k"))
    part = F.when(F.col("__a").isNull(), "pending").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed").when(F.col("__k"), "unchanged_kept").otherwise("reused")
    return b.join(a, key, "left").select(*key, part.alias("part"))


def resolve_overrides(overrides: DataFrame, records: DataFrame, override_id: str, record_id: str, wanted: str, ids: str) -> DataFrame:
    """(override id, matches): how many records have all the ids that each override wants; 1 is sound. An override that wants none matches all, null ids count for nothing.

    Equal sets are taken once on either side. A wanted set meets the records that hold its rarest id,
    and no others, so an id that most records have brings nothing together unless a set wants no rarer one.
    """
    as_set = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array()))))
    asked = overrides.select(override_id, as_set(wanted).alias("__w"))
    sets = records.groupBy(as_set(ids).alias("__ids")).agg(F.count("*").alias("__records"))
    holders = sets.select("__ids", "__records", F.explode("__ids").alias("__id"))
    spread = holders.groupBy("__id").agg(F.count("*").alias("__spread"))
    members = asked.filter(F.size("__w") > 0).select("__w").distinct().select("__w", F.explode("__w").alias("__id"))
    rarest = members.join(spread, "__id", "left").groupBy("__w").agg(F.min(F.struct(F.coalesce("__spread", F.lit(0)).alias("n"), "__id")).alias("x")).select("__w", "x.__id")
    held = rarest.join(holders, "__id").filter(F.size(F.array_except("__w", "__ids")) == 0).groupBy("__w").agg(F.sum("__records").alias("__m"))
    everything = records.agg(F.count("*").alias("__all"))
    return asked.join(held, "__w", "left").crossJoin(F.broadcast(everything)).select(override_id, F.when(F.size("__w") == 0, F.col("__all")).otherwise(F.coalesce("__m", F.lit(0))).alias("matches"))


def last_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: a later write wins."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*(c.desc() for c in order)))).filter("__n = 1").drop("__n")


def one_family(df: DataFrame, group: list[str], family: Column) -> DataFrame:
    """(group, families, sound): whether a group's rows have exactly one family."""
    return df.groupBy(*group).agg(F.countDistinct(family).alias("families")).withColumn("sound", F.col("families") == 1)


def running_ids(df: DataFrame, group: list[str], order: list[Column], template: str, *parts: str) -> DataFrame:
    """df with ordinal and expected_id: template filled with parts and the ordinal within the group."""
    numbered = df.withColumn("ordinal", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return numbered.withColumn("expected_id", F.format_string(template, *(F.col(p) for p in parts), F.col("ordinal")))


def concatenate(*lineages: DataFrame) -> DataFrame:
    """All rows under one superset of columns, with lineage_no in the order given."""
    out = None
    for k, df in enumerate(lineages):
        df = df.withColumn("lineage_no", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
