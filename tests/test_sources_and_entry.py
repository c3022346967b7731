import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.plans import catalog
from tessera.sources import files
from tessera.streaming import jobs

DATA = Path("/root/testdata/sf0.001")


def test_json_sources_fail_on_what_doesnt_fit(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert files.read_json(spark, str(tmp_path / "a.json"), "id int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n[3]\n')
    assert [(r["line"], r["value"]) for r in files.bad_lines(spark, str(tmp_path / "b.jsonl")).collect()] == [(4, "[3]")]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id int").collect()


def test_freeze_keeps_or_refuses(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "frozen")
    assert [files.freeze(df, path), files.freeze(df, path)] == ["written", "kept"]
    with pytest.raises(FileExistsError):
        files.freeze(spark.range(4), path)


def test_append_refuses_repeats(spark, tmp_path):
    df, path = spark.range(3).withColumn("v", F.lit("x")), str(tmp_path / "log")
    assert files.append_results(df, path, ["id"]) == 3
    with pytest.raises(ValueError, match="already"):
        files.append_results(df, path, ["id"])


def test_lock_and_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    with files.OutputLock(spark, path):
        with pytest.raises(RuntimeError, match="taken"), files.OutputLock(spark, path):
            pass
        files.replace_atomically(spark.range(2), path)
        files.replace_atomically(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_fingerprint_follows_content(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    before = files.input_fingerprint(spark, str(tmp_path / "a"))
    assert before == files.input_fingerprint(spark, str(tmp_path / "a"))
    (tmp_path / "a").write_text("2")
    assert before != files.input_fingerprint(spark, str(tmp_path / "a"))


def test_models_and_embedders_are_callables(spark):
    df = spark.createDataFrame([("a",), ("bc",)], "p string")
    assert sorted(r["answer"] for r in files.generate(df, "p", lambda xs: [x.upper() for x in xs]).collect()) == ["A", "BC"]
    assert sorted(r["vector"] for r in files.embed(df, "p", lambda xs: [[float(len(x))] for x in xs], 1).collect()) == [[1.0], [2.0]]
    with pytest.raises(Exception, match="vectors"):
        files.embed(df, "p", lambda xs: [[1.0, 2.0] for _ in xs], 1).collect()


def test_streamed_results_are_logged_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "log")
    spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "k int, t int, v string").write.json(str(source))
    start = lambda: jobs.log_results(spark.readStream.schema("k int, t int, v string").json(str(source)), path, str(tmp_path / "cp"), ["k"], "t").awaitTermination()
    start()
    spark.createDataFrame([(2, 9, "again"), (3, 0, "d")], "k int, t int, v string").write.mode("append").json(str(source))
    start()
    log = jobs.read_log(spark, path, spark.createDataFrame([], "k int, t int, v string").schema)
    assert sorted((r["k"], r["v"]) for r in log.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    status = jobs.run_status(spark.createDataFrame([(1,), (2,), (9,)], "k int"), log.withColumn("s", F.lit("completed")), ["k"], "s").first()
    assert (status["completed"], status["pending"], status["status"]) == (2, 1, "running")


def test_every_query_has_a_name_and_every_sql_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) >= 80
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_flagship_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() == 10


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["bm25_topk", "rrf_hybrid_topk", "interval_cover", "cohort_rates", "cluster_bootstrap_hash", "overlay_upsert", "wilson_interval"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    expected = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, str(DATA)).toPandas()
    order = sorted(expected.columns)
    assert sorted(got.columns) == order
    as_rows = lambda df: sorted([tuple(None if v != v else v for v in r) for r in df[order].astype(object).itertuples(index=False)], key=str)
    a, b = as_rows(got), as_rows(expected)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y) if all(isinstance(v, (int, float)) for v in x) else x == y


def test_a_bad_line_is_named(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[2]\n')
    with pytest.raises(files.BadLine, match=r"x\.jsonl:3"):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", numbered=True)


def test_a_table_is_recovered_after_a_broken_replacement(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_atomically(spark.range(3), path)
    files.replace_atomically(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    (tmp_path / "t").rename(tmp_path / "t.old-1")  # as if a run had died between the renames
    assert files.recover(spark, path) and spark.read.parquet(path).count() == 5 and not files.recover(spark, path)
