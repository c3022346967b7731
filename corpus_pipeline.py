"""The corpus pipeline: toxicity, line dedup, near-duplicate join, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. Rows that share an id are treated as one document by line dedup and the join.
A stage of an empty table is an empty table with the same columns. Columns that documents doesn't
have are carried along; names that begin with two underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from tessera.llm.shared import cut, documents, labels, release


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where docs has it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string kernel machine, trained on all labels, doesn't call toxic. Null and empty texts are kept; repeated rows stay or go together; texts are read whole."""
    model = toxicity.train(docs, labels(spark, sf_dir).select("doc_id", "toxic"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier document has. A null text becomes an empty one, as does a text that loses all its lines; a row without an id keeps its lines."""
    return with_length(line_dedup.drop_repeated_lines(docs).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of linked documents. Texts without a word, and rows without an id, link with nothing and are kept; rows of one id stay or go together."""
    groups = jaccard_join.components(docs.select("doc_id", "text"))
    copies = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, so documents come up to three times, or not at all. Texts without a word are never taken; equal rows of one id share what the mix takes of them."""
    marked = docs.withColumn("__body", F.xxhash64("text"))
    taken = mixing.mix(marked.select("doc_id", "text", "source", "__body")).groupBy("doc_id", "__body")
    taken = taken.agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size"), F.count("*").alias("__rows")).filter("__taken > 0")
    taken = taken.withColumn("__copies", F.expr("__taken div __size")).select(F.col("doc_id").alias("__id"), F.col("__body").alias("__hash"), "__copies", "__rows")
    found = marked.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__body") == F.col("__hash")))
    once = found.filter("__rows = 1")
    repeated = found.filter("__rows > 1").dropDuplicates(["doc_id", "__body"])
    return once.unionByName(repeated).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and whether decoding the ids gives the text's bytes back. A null text is an empty one, of no tokens; one row for each row, repeated ones too."""
    ids = bpe.encode(docs.select("doc_id", "text"), *bpe.vocabulary(), decoded=True)
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return ids.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", whole.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]
#: Toxicity, a trained machine, can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
