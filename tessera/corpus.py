"""Building and checking a corpus: lineages to one table, constraints that stop the build, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ranges as R
from tessera.functions import text as X
from tessera.operators import constraints, lineage
from tessera.sources import files

RECORD = "id string, evidence_type string, piece string, topic string, question string, answer string, note string, retrieval_aliases array<string>, source_ids array<string>, measure_range array<struct<start:int,end:int>>, measure_status string, measure_scope string"
STATUSES = ("specific", "whole_piece", "unspecified")
EDITORIAL_FIELDS = {"review_status", "reviewer", "reviewed_at", "editor_notes"}


def texts(records: DataFrame) -> DataFrame:
    """records with relevance_text (what may admit: topic, the question twice, answer, note, aliases) and retrieval_text (also the sources' names, where there are any)."""
    aliases = F.array_join(F.coalesce("retrieval_aliases", F.array().cast("array<string>")), "\n")
    relevance = X.joined_text(F.col("topic"), F.col("question"), F.col("question"), F.col("answer"), F.col("note"), aliases)
    out = records.withColumn("relevance_text", relevance)
    return out.withColumn("retrieval_text", X.joined_text(F.col("relevance_text"), F.col("source_names")) if "source_names" in records.columns else F.col("relevance_text"))


def offenders(records: DataFrame) -> DataFrame:
    """Records that break a rule, with the rules' names."""
    ranges = F.coalesce("measure_range", F.array().cast(R.RANGES))
    order = F.forall(F.sequence(F.lit(1), F.greatest(F.size(ranges) - 1, F.lit(1))), lambda i: (F.size(ranges) < 2) | (F.get(ranges, i - 1)["end"] < F.get(ranges, i)["start"]))
    named = {c: F.trim(c) != "" for c in ("edition", "measure_system") if c in records.columns}
    placed = {f"{c}_of_ranges": (F.size(ranges) == 0) | F.coalesce(said, F.lit(False)) for c, said in named.items()}  # a range means something in one edition and counting only
    return constraints.breaking(
        records,
        **placed,
        id=F.trim("id") != "",
        answer=F.trim("answer") != "",
        ranges=F.forall(ranges, lambda x: (x["start"] >= 1) & (x["end"] >= x["start"])) & order,
        status=F.col("measure_status").isNull() | F.col("measure_status").isin(*STATUSES),
        scope=(F.col("measure_scope") == "unspecified") | R.scope_is_consistent(ranges, F.col("measure_scope")),
    )


def validate(records: DataFrame) -> None:
    """Stop at any record that breaks a rule, an id that is there twice, or a field that only editing needs."""
    forbidden = constraints.forbidden_paths(records.schema, EDITORIAL_FIELDS)
    if forbidden:
        raise constraints.Violated(f"fields of editing are in the corpus: {forbidden}")
    constraints.require(offenders(records).select("id", "broken"), "records break rules")
    constraints.require(constraints.duplicate_keys(records, ["id"]), "ids are there twice")


def stats(records: DataFrame) -> DataFrame:
    """(dimension, value, n): records by lineage, piece, status and scope, in one pass."""
    dimensions = ["evidence_type", "piece", "measure_status", "measure_scope"]
    counted = records.groupingSets([[d] for d in dimensions], *dimensions).agg(F.grouping_id().alias("__g"), F.count("*").alias("n"))
    name = F.element_at(F.create_map(*(F.lit(x) for k, d in enumerate(dimensions) for x in ((1 << len(dimensions)) - 1 - (1 << len(dimensions) - 1 - k), d))), F.col("__g").cast("int"))
    return counted.select(name.alias("dimension"), F.coalesce(*dimensions).alias("value"), "n")


def build(lineages: list[DataFrame], path: str, inputs: list[str] | None = None) -> DataFrame:
    """Concatenate, check, and put the corpus in place at path; an error if the inputs changed meanwhile."""
    spark = lineages[0].sparkSession
    before = files.input_fingerprint(spark, inputs) if inputs else None
    records = texts(lineage.concatenate(*lineages))
    validate(records)
    if inputs and files.input_fingerprint(spark, inputs) != before:
        raise RuntimeError("the inputs changed while the corpus was built")
    files.replace_atomically(records, path)
    return spark.read.parquet(path)


def load(spark, path: str) -> DataFrame:
    """A built corpus, checked again."""
    records = spark.read.parquet(path)
    validate(records)
    return records


def lyrics(points: DataFrame, selected: DataFrame, limit: int = 24) -> DataFrame:
    """Score context: (piece, measure, voice, lyric_lines) of the measures that ranges (piece, start, end) select, the first limit a piece."""
    from tessera.operators.intervals import expand_lookup

    return expand_lookup(selected, points, ["piece"], "start", "end", "measure", limit)
