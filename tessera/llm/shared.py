"""What the text operators share: paths, lineage cuts, and the columns of documents."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that the word definition `[^\x20\x09-\x0D]+` leaves out.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: The directory that is used where the session names none, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"
BATCH_ROWS = 2000
#: No more keys than this can each hold a HOT-th of all rows.
HOT = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_ROWS at most for the rest of the session; long documents make even these large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release_memory() -> None:
    """Give freed memory back to the system: workers live on between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What empties the caches that a worker keeps from task to task.
emptiers: list[Callable[[], None]] = []


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep_caches: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back at the end of each task, and at its start the caches of operators that the worker served before."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if not keep_caches and emptiers:
                for empty in emptiers:
                    empty()
                release_memory()
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep_caches: bool = False) -> DataFrame:
    """df.mapInArrow in small batches, tidied."""
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run, keep_caches), schema)


def shipped(query):
    """The query, after making sure that executors can import this package, also where it is on the driver's path only."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = Path(__file__).resolve().parents[2]
        seen = [Path(p or ".").resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd())]
        if root not in seen and not getattr(spark.sparkContext, "_tessera_shipped", False):
            folder = tempfile.mkdtemp()  # the driver serves the archive to executors from here
            atexit.register(shutil.rmtree, folder, True)
            archive = Path(folder) / "tessera_package.zip"
            with zipfile.ZipFile(archive, "w") as z:
                for p in (root / "tessera").rglob("*.py"):
                    z.write(p, p.relative_to(root))
            spark.sparkContext.addPyFile(str(archive))
            spark.sparkContext._tessera_shipped = True
        return query(spark, sf_dir)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It may be unnamed where all run in one process only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return FALLBACK_DIR


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the cluster's shared folder and read it back, so that a lost executor never makes Spark repeat what led to it.

    The table lies in a folder of this application and goes by release(), or when the driver's
    Python ends. If a driver is killed, the folder tells whose tables may be deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if spark.sparkContext not in _contexts:  # before the write, which may fail
        _contexts.append(spark.sparkContext)
        atexit.register(_remove, spark, path.rpartition("/")[0])
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    vars(out)["_cut_path"] = path
    return out


_contexts: list = []


def release(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, vars(df)["_cut_path"])


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, least: int = 1) -> DataFrame:
    """left joined with right, one row a key, whose __n says how many of left's total rows have the key; without __n.

    Keys of at least a HOT-th of left's rows, HOT at most, and of least rows are looked up by broadcast
    where the rows are, so that none of them meets in one task. The others are joined.
    """
    most = max(least, total // HOT + 1)
    hot = F.broadcast(right.filter(F.col("__n") >= most).drop("__n"))
    rare = right.filter(F.col("__n") < most).drop("__n")
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(rare, keys))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; plain lower() where the text is ASCII, which is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_blanks(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def n_words(text: Column) -> Column:
    """The number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
