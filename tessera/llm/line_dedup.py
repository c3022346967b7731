"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ascii_lower, counted_join, cut, strip_blanks

MIN_CHARS, MIN_DOCS = 10, 2


def line_hash(line: Column, min_chars: int) -> Column:
    """The 16-byte hash of a line's key, null where the key is too short to count."""
    key = ascii_lower(strip_blanks(line))
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash of the text, position from 0) of each line that its document loses: the key is in min_docs documents at least and the document isn't the smallest of them.

    Lines are exploded and hashed once, into a table. A key's documents are counted with partial
    sums, so a line of a third of all documents costs one row per task.
    """
    keys = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: line_hash(x, min_chars))
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__doc"), F.xxhash64(text_col).alias("__body"), keys.alias("__keys"))
    lines = rows.select("__doc", "__body", F.posexplode("__keys").alias("__pos", "__hash"))
    lines = cut(lines.filter(F.col("__hash").isNotNull()), "lines")
    seen = lines if min_docs == 2 else lines.select("__doc", "__hash").distinct()
    spread = seen.groupBy("__hash").agg(F.min("__doc").alias("__first"), F.max("__doc").alias("__last"), F.count("*").alias("__n"))
    spread = spread.filter("__first <> __last" if min_docs == 2 else F.col("__n") >= min_docs).drop("__last")
    if min_docs != 2:  # __n has to count rows of lines
        spread = spread.drop("__n").join(lines.groupBy("__hash").agg(F.count("*").alias("__n")), "__hash")
    return counted_join(lines, spread, ["__hash"], lines.count()).filter("__doc <> __first").select("__doc", "__body", "__pos")


def without(lines: Column, places: Column) -> Column:
    """lines but for those at places, which are sorted. Flags beside the lines say which stay; no expression looks into an array once a line, so the work is linear."""
    starts = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    ends = F.concat(places, F.array(F.size(lines)))
    flags = F.flatten(F.zip_with(starts, ends, lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a), F.array(F.lit(False)))))
    return F.transform(F.filter(F.arrays_zip(lines.alias("line"), flags.alias("stays")), lambda x: x["stays"]), lambda x: x["line"])


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of the text, plus n_lines (before) and n_dropped.

    A null or empty text is one empty line and becomes empty. A document left without lines has
    an empty text. Rows that share an id are one document, each losing its own lines. A row without
    an id keeps all its lines and counts for none. An empty table gives an empty result. The work is
    linear in a text's lines, however many it has. Columns named n_lines or n_dropped are replaced.
    """
    drops = repeated_lines(docs, min_chars, min_docs, id_col, text_col).groupBy("__doc", "__body").agg(F.sort_array(F.collect_set("__pos")).alias("__drops"))
    drops = drops.withColumnRenamed("__body", "__of")
    own = docs.drop("n_lines", "n_dropped").withColumn("__body", F.xxhash64(text_col))
    joined = own.join(drops, (F.col(id_col) == F.col("__doc")) & (F.col("__body") == F.col("__of")), "left")
    out = joined.withColumn("__lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).withColumn("n_lines", F.size("__lines").cast("long"))
    out = out.withColumn("n_dropped", F.coalesce(F.size("__drops"), F.lit(0)).cast("long"))
    kept = F.when(F.col("__drops").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(without(F.col("__lines"), F.col("__drops")), "\n"))
    return out.withColumn(text_col, kept).drop("__doc", "__of", "__body", "__drops", "__lines")


def op10_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
spread AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, spread.first_doc IS NOT NULL AND spread.first_doc <> keyed.doc_id AS gone FROM keyed LEFT JOIN spread ON keyed.k = spread.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
