"""Evaluation joins: cases, results, blind packets, reviews, retrieval diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import constraints
from tessera.operators.selection import hash_order


def packets(results: DataFrame, case: str, answer: str, evidence: Column | None, salt: str) -> tuple[DataFrame, DataFrame]:
    """(packets, mapping): each distinct answer with its evidence once, in an order that tells nothing of its origin; and which result has which packet."""
    text = X.squeeze(F.coalesce(F.col(answer), F.lit("")))
    support = F.to_json(F.sort_array(evidence)) if evidence is not None else F.lit("")
    keyed = results.withColumn("review_id", X.content_id(F.col(case).cast("string"), text, support, size=20, prefix="answer-"))
    unique = keyed.select("review_id", case, F.col(answer)).dropDuplicates(["review_id"])
    return unique.withColumn("place", hash_order(F.col("review_id"), salt)).orderBy("place").drop("place"), keyed


def attach(mapping: DataFrame, reviews: DataFrame, key: str = "review_id") -> DataFrame:
    """mapping with its reviews. Packets without a review, reviews of no packet and repeated reviews are errors."""
    constraints.require(constraints.duplicate_keys(reviews, [key]), "reviews are there twice")
    constraints.require(mapping.select(key).distinct().join(reviews, key, "left_anti"), "packets have no review")
    constraints.require(reviews.select(key).join(mapping, key, "left_anti"), "reviews belong to no packet")
    return mapping.join(reviews, key)


def complete(cases: DataFrame, results: DataFrame, key: list[str], variants: list[str], repeats: int) -> None:
    """An error unless each case has each variant and repeat once, with a finite time that isn't negative."""
    spark = cases.sparkSession
    grid = cases.select(*key).distinct().crossJoin(spark.createDataFrame([(v,) for v in variants], "variant string")).crossJoin(spark.range(repeats).select(F.col("id").cast("int").alias("repeat")))
    job = [*key, "variant", "repeat"]
    constraints.require(constraints.duplicate_keys(results, job), "jobs are measured twice")
    constraints.require(grid.join(results, job, "left_anti"), "jobs weren't measured")
    constraints.require(results.join(grid, job, "left_anti"), "results belong to no job")
    seconds = F.col("elapsed_seconds")
    constraints.require(constraints.breaking(results, elapsed=(seconds >= 0) & ~F.isnan(seconds) & (seconds < float("inf"))).select(*job, "broken"), "times are wrong")


def diagnostics(expected: DataFrame, retrieved: DataFrame, case: str, item: str, rank: str, cutoffs: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Per case: expected items, those found, the first rank, its reciprocal to six places and hits; nulls where nothing is expected."""
    found = expected.select(case, item).join(retrieved.select(case, item, rank), [case, item], "left")
    per = found.groupBy(case).agg(F.count(item).alias("expected"), F.count(F.when(F.col(item).isNotNull(), F.col(rank))).alias("found"), F.min(rank).alias("first_rank"))
    return _graded(per, cutoffs)


def counted_diagnostics(cases: DataFrame, found: DataFrame, case: str, rank: str, cutoffs: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """diagnostics() where the expected items aren't listed: cases has (case, expected), their number; found has (case, rank) of those retrieved."""
    hits = found.groupBy(case).agg(F.count(rank).alias("found"), F.min(rank).alias("first_rank"))
    return _graded(cases.join(hits, case, "left").select(case, "expected", F.coalesce("found", F.lit(0)).alias("found"), "first_rank"), cutoffs)


def _graded(per: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    some = F.col("expected") > 0
    hits = [F.when(some, F.coalesce(F.col("first_rank") <= k, F.lit(False))).alias(f"hit_{k}") for k in cutoffs]
    return per.select("*", F.when(some, F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6)).alias("reciprocal_rank"), *hits)


def coverage(expected: DataFrame, retrieved: DataFrame, case: str, item: str, group: str) -> DataFrame:
    """Per group and over all: cases, share with any and with all expected items, and share of items found."""
    marked = expected.select(case, item, group).join(retrieved.select(case, item).distinct().withColumn("__hit", F.lit(1)), [case, item], "left")
    return _covered(marked.groupBy(case, group).agg(F.count("*").alias("__n"), F.count("__hit").alias("__k")), group)


def counted_coverage(cases: DataFrame, found: DataFrame, case: str, group: str) -> DataFrame:
    """coverage() where the expected items aren't listed: cases has (case, group, expected), their number; found has a row for each one retrieved."""
    hits = found.groupBy(case).agg(F.count("*").alias("__k"))
    return _covered(cases.join(hits, case, "left").select(case, group, F.col("expected").alias("__n"), F.coalesce("__k", F.lit(0)).alias("__k")), group)


def _covered(per: DataFrame, group: str) -> DataFrame:
    from tessera.operators.metrics import rolled_up

    return rolled_up(per, group, [F.count("*").alias("cases"), F.avg((F.col("__k") > 0).cast("double")).alias("any_rate"), F.avg((F.col("__k") == F.col("__n")).cast("double")).alias("all_rate"), (F.sum("__k") / F.sum("__n")).alias("item_recall")])


def compacted(children: DataFrame, parents: DataFrame, key: str, ids: str, parent_key: str, fields: list[str], out: str) -> DataFrame:
    """children with out, an array of their parents' fields in the order of ids; an id without a parent is an error."""
    named = children.select(key, F.posexplode(ids).alias("__p", parent_key))
    constraints.require(named.join(parents, parent_key, "left_anti"), "ids have no record")
    found = named.join(parents.select(parent_key, F.struct(parent_key, *fields).alias("__s")), parent_key)
    lists = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__p", "__s"))), lambda x: x["__s"]).alias(out))
    return children.join(lists, key, "left")


def derived_sets_differ(chunks: DataFrame, claims: DataFrame, chunk: str, claim_ids: str, claim: str, derived: str, own: str) -> DataFrame:
    """Chunks whose own set of values isn't the union of their claims' derived arrays."""
    union = chunks.select(chunk, F.explode(claim_ids).alias(claim)).join(claims.select(claim, F.explode(derived).alias("__v")), claim, "left").groupBy(chunk).agg(F.sort_array(F.collect_set("__v")).alias("__union"))
    return chunks.join(union, chunk, "left").filter(~F.sort_array(F.array_distinct(own)).eqNullSafe(F.coalesce("__union", F.array().cast("array<string>")))).select(chunk)


def same_support(a: Column, b: Column) -> Column:
    """ordered, unordered or different: how two arrays of evidence compare."""
    return F.when(a.eqNullSafe(b), "ordered").when(F.sort_array(a).eqNullSafe(F.sort_array(b)), "unordered").otherwise("different")


def judgement_errors(judged: DataFrame, quote: str, source: str, scores: dict[str, tuple[int, int]]) -> DataFrame:
    """Judgements that can't stand: a quote that its source doesn't hold, or a score outside its bounds."""
    rules = {name: F.col(name).between(*bounds) for name, bounds in scores.items()}
    return constraints.breaking(judged, quote=F.contains(X.squeeze(F.col(source)), X.squeeze(F.col(quote))), **rules)
