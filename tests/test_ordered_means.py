"""Means whose last digit hangs on the order of addition."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.plans import metric_queries
from tessera.plans.base import SQL


def test_means_are_added_up_in_order_however_rows_are_dealt(spark):
    values = [0.1, 1e16, -1e16, 0.2, 0.7, 1e15, 3.3, -1e15]
    rows = [(u, k, v) for u in range(5) for k, v in enumerate(values[u:] + values[:u])] + [(9, 0, None)]
    expected = {9: None}
    for u in range(5):
        total = 0.0
        for v in values[u:] + values[:u]:
            total += v
        expected[u] = total / len(values)
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows, "u long, k long, v double").repartition(n)
        assert {r["u"]: r["m"] for r in metrics.ordered_mean(df, ["u"], "v", "k", "m").collect()} == expected


def test_rounding_goes_by_the_double_times_ten(spark):
    values = [0.049999999999999996, 0.25, -0.25, 49.74999999999999, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(metrics.rounded(F.col("v"), 1)).collect()] == [0.1, 0.3, -0.3, 49.7, 0.0, None]


@pytest.mark.parametrize("file_order", [1, -1])
def test_win_tie_loss_and_its_sql_add_in_the_order_of_events(spark, tmp_path, file_order):
    clicks = [(0, 1, "click", 1e16), (2, 1, "click", -1e16), (1, 1, "click", 1.0)]  # 0.0 in the order of events, 0.3 in the file's
    alike = [(7, 2, "click", v) for v in (1.0, 1e16, -1e16)]  # one event_id: 0.0 in the order of values
    others = [(10, 1, "view", 0.0), (11, 2, "view", 0.0), (12, None, "click", 1.0), (13, 3, "view", None)]
    columns = zip(*(clicks + alike + others)[::file_order], strict=True)
    pq.write_table(pa.table(dict(zip(("event_id", "user_id", "event_type", "value"), map(list, columns), strict=True))), tmp_path / "events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in metric_queries.paired_win_tie_loss(spark, str(tmp_path)).collect()]
    assert got == db.execute(SQL["paired_win_tie_loss"]).fetchall() == [(0, 2, 0, 2, 1)]
