"""Session helpers shared by tests, the bench and the command line."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table. sf_dir may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that all executors see, for tables that a query writes and reads again."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


_contexts: list = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, under the application's, which goes when the driver's Python ends."""
    folder = f"{scratch_dir(spark)}/tessera-{spark.sparkContext.applicationId}/queries"
    if spark.sparkContext not in _contexts:
        _contexts.append(spark.sparkContext)
        atexit.register(_forget, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        at = context._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that it is computed once and a lost executor repeats nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    vars(out)["_kept_path"] = path
    return out


def release(table: DataFrame) -> None:
    """Delete a table of kept() that nothing will read again."""
    _forget(table.sparkSession, vars(table)["_kept_path"])
