"""Sources and sinks: JSON documents and lines, file fingerprints, and sinks that don't lose or silently replace what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array of objects as rows. Anything that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


class BadLine(ValueError):
    """A line of a JSON lines file isn't an object."""


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, numbered: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped, a line that isn't an object of the schema is an error. numbered: look for such lines first, so that the error tells file and line."""
    if numbered:
        first = bad_lines(spark, path).orderBy("file", "line").first()
        if first is not None:
            raise BadLine(f"{first['file']}:{first['line']}: not a JSON object: {first['value'][:80]!r}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value) of all lines, from 1: whole-file reads, so lines can be numbered."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return files.withColumn("line", F.col("line") + 1)


def not_objects(lines: DataFrame) -> DataFrame:
    """Those of numbered_lines() that aren't JSON objects, blank ones aside."""
    return lines.filter(F.trim("value") != "").filter(F.json_object_keys("value").isNull())


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value) of lines that aren't JSON objects, blank ones aside."""
    return not_objects(numbered_lines(spark, path))


def fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, size, sha256) of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def input_fingerprint(spark: SparkSession, paths: str | list[str]) -> str:
    """One digest of all files: of their paths and digests in order of path."""
    rows = fingerprints(spark, paths).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat_ws("\0", x["path"], x["sha256"])), "\0").alias("all"))
    return rows.select(F.sha2("all", 256)).first()[0]


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def replace_atomically(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Put a new table at path. It is written aside first; the old one is renamed aside, the new one renamed into place, and only then the old one deleted.

    Between the two renames path is missing, but never half a table; if that is where a run dies,
    the old table is whole beside path and recover() puts it back.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    recover(spark, path)
    df.write.format(format).save(f"{path}.new-{mark}")
    at, fs = _fs(spark, path)
    new, old = _fs(spark, f"{path}.new-{mark}")[0], _fs(spark, f"{path}.old-{mark}")[0]
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"{path} couldn't be set aside")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"{path} couldn't be replaced")
    if had:
        fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """If path is missing because a run died while replacing it, put the table that was there back. Returns whether it did."""
    at, fs = _fs(spark, path)
    if fs.exists(at):
        return False
    left = fs.globStatus(_fs(spark, f"{path}.old-*")[0]) or []
    if not len(left):
        return False
    newest = max(left, key=lambda status: status.getModificationTime())
    return bool(fs.rename(newest.getPath(), at))


def digest(df: DataFrame) -> str:
    """A digest of the rows that doesn't depend on their order; repeated rows count."""
    rows = df.select(F.xxhash64(*(F.col(c).cast("string") for c in df.columns)).cast("decimal(38,0)").alias("h"))
    n, total = rows.agg(F.count("*"), F.sum("h")).first()
    return f"{n}:{total}:{','.join(sorted(df.columns))}"


def freeze(df: DataFrame, path: str) -> str:
    """Write once: nothing happens if path has the same rows, other rows there are an error. Returns written or kept."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
        return "written"
    if digest(spark.read.parquet(path).select(*df.columns)) != digest(df):
        raise FileExistsError(f"{path} holds other rows; a frozen table isn't replaced")
    return "kept"


class OutputLock:
    """A lock file beside a table; taking it twice is an error, whoever tries."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, f"{path}.lock"

    def __enter__(self) -> OutputLock:
        at, fs = _fs(self.spark, self.path)
        if not fs.createNewFile(at):
            raise RuntimeError(f"{self.path} is taken: another run writes here")
        return self

    def __exit__(self, *error: object) -> None:
        at, fs = _fs(self.spark, self.path)
        fs.delete(at, False)


def append_results(df: DataFrame, path: str, key: list[str]) -> int:
    """Append rows as JSON lines; a key that is there already, or twice in df, is an error. Returns the number of rows."""
    from tessera.operators.constraints import duplicate_keys, require

    require(duplicate_keys(df, key), "results are there twice")
    if exists(df.sparkSession, path):
        require(df.join(df.sparkSession.read.json(path).select(*key), key, "left_semi"), "results are there already")
    n = df.count()
    df.write.mode("append").json(path)
    return n


def generate(df: DataFrame, prompt_col: str, model: Callable[[list[str]], list[str]], batch: int = 64) -> DataFrame:
    """df with answer: a model, any callable over a list of prompts, called on a batch of rows at a time."""
    schema = T.StructType([*df.schema, T.StructField("answer", T.StringType())])
    place = df.columns.index(prompt_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                answers = model(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string())], [*part.schema.names, "answer"])

    return df.mapInArrow(run, schema)


def embed(df: DataFrame, text_col: str, embedder: Callable[[list[str]], list[list[float]]], size: int, batch: int = 64) -> DataFrame:
    """df with vector: an embedder called on a batch of texts at a time; a vector of another size is an error."""
    schema = T.StructType([*df.schema, T.StructField("vector", T.ArrayType(T.DoubleType()))])
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                found = embedder(part.column(place).to_pylist())
                if len(found) != part.num_rows or any(len(v) != size for v in found):
                    raise ValueError(f"the embedder gave {len(found)} vectors for {part.num_rows} texts, or some not of size {size}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float64()))], [*part.schema.names, "vector"])

    return df.mapInArrow(run, schema)
