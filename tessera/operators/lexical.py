"""BM25 over documents: statistics, postings and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.4, 0.75


def term_frequency(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(id_col, F.explode(tokens).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, dl); documents without tokens have 0, so they count in the mean."""
    return docs.select(id_col, F.coalesce(F.size(tokens), F.lit(0)).cast("long").alias("dl"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def inverse_frequency(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(term, df, idf). Distinct terms of a document are exploded, so counting needs no distinct aggregate."""
    terms = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.crossJoin(F.broadcast(docs.agg(F.count("*").alias("__n")))).select("term", "df", idf(F.col("df"), F.col("__n")).alias("idf"))


def weight(tf: Column, dl: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.greatest(mean, F.lit(1e-9))))


def _occurrences(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def score(docs: DataFrame, id_col: str, tokens: Column, query: list[str], condition: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """docs that meet condition, with score and dl, for one literal query; repeated query terms count again.

    Statistics cover all docs, whatever condition says. The query's terms are counted inside each
    document's token array, so nothing but one row of statistics is shuffled.
    """
    counts = docs.withColumn("__tokens", tokens).withColumn("dl", F.coalesce(F.size("__tokens"), F.lit(0)).cast("long"))
    terms = list(dict.fromkeys(query))
    if terms:  # one pass over a document's tokens, then counts in the few that are left
        counts = counts.withColumn("__tokens", F.filter("__tokens", lambda t: t.isin(*terms)))
    counts = counts.select("*", *(_occurrences("__tokens", term).alias(f"__tf{k}") for k, term in enumerate(terms))).drop("__tokens")
    stats = counts.agg(F.count("*").alias("__n"), F.avg("dl").alias("__mean"), *(F.sum((F.col(f"__tf{k}") > 0).cast("long")).alias(f"__df{k}") for k in range(len(terms))))
    chosen = counts if condition is None else counts.filter(condition)
    parts = [
        F.when(F.col(f"__tf{k}") > 0, idf(F.col(f"__df{k}"), F.col("__n")) * weight(F.col(f"__tf{k}"), F.col("dl"), F.col("__mean"), k1, b)).otherwise(0.0) * query.count(term)
        for k, term in enumerate(terms)
    ]
    total = reduce(lambda x, y: x + y, parts) if parts else F.lit(0.0)
    hidden = [c for c in counts.columns if c.startswith("__")]
    return chosen.crossJoin(F.broadcast(stats)).withColumn("score", total).drop(*hidden, *stats.columns)


#: Query terms up to this many (query, term) rows are sent to every executor; more of them are joined.
SMALL_QUERIES = 200_000


def score_queries(docs: DataFrame, id_col: str, tokens: Column, queries: DataFrame, query_id: str, query_tokens: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(query id, id, score) of all documents that share a term, for a table of queries.

    Postings are cut to the queries' terms before they are grouped; a term's weight times how often
    the query has it is summed per pair. While the queries' terms are few, counted first, they travel
    and postings are shuffled by document only, so a frequent term's list never meets in one task.
    """
    wanted = queries.select(query_id, F.explode(query_tokens).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("__times"))
    travel = F.broadcast if wanted.count() <= SMALL_QUERIES else (lambda df: df)
    dl = docs.select(id_col, tokens.alias("__tokens")).withColumn("__dl", F.coalesce(F.size("__tokens"), F.lit(0)))
    stats = dl.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__mean"))
    postings = dl.select(id_col, "__dl", F.explode("__tokens").alias("term")).join(travel(wanted.select("term").distinct()), "term", "left_semi").groupBy(id_col, "__dl", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df"))  # of the same columns as below, so that Spark shuffles the postings once
    weighted = postings.join(travel(df), "term").crossJoin(F.broadcast(stats)).select(id_col, "term", (idf(F.col("df"), F.col("__n")) * weight(F.col("tf"), F.col("__dl"), F.col("__mean"), k1, b)).alias("__w"))
    return weighted.join(travel(wanted), "term").groupBy(query_id, id_col).agg(F.sum(F.col("__w") * F.col("__times")).alias("score"))
