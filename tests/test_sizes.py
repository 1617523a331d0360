"""Results that hold at sizes which the driver's smallest tables don't show."""

from datetime import datetime, timedelta

import duckdb

from trailmark.plans import views
from trailmark.queries import ORACLES, QUERIES


def test_gap_seconds_beyond_64_bits(spark, tmp_path):
    start = datetime(1970, 1, 2)
    times = [start + timedelta(seconds=s) for s in range(4)] + [start + timedelta(days=36_500)]
    rows = [(u * 10 + i, t, u, "view", 1.0, "{}") for u in range(4) for i, t in enumerate(times)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(path)
    got = [tuple(r) for r in QUERIES["gap_seconds"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    assert got == con.sql(ORACLES["gap_seconds"]).fetchall() == [("gap:view", 4 * (36_500 * 86_400 - 3.0), 4)]


def test_exported_positions_of_more_rows_than_a_sample_of_ranges(spark, tmp_path):
    count = 20_000
    docs = spark.range(count).selectExpr(f"id * 7919 % {count} AS doc_id", "CAST(id % 3 AS string) AS lang", "id AS n_chars")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["arrow_export"](spark, str(tmp_path)).select("doc_id", "position").collect()
    assert len(got) == count and all(r["doc_id"] == r["position"] for r in got)


def test_ranges_follow_from_values(spark):
    rows = [(k, x, i) for i, (k, x) in enumerate([(None, 1.0), ("a", None), ("a", float("nan")), ("b", -1.0), ("b", 2.0), ("a", 0.5)] * 50)]
    frame = spark.createDataFrame(rows, "k string, x double, i int")
    got = views.shards(frame, ["k", "x", "i"], 3).orderBy("position").collect()
    value = lambda r: (r["k"] is not None, r["k"] or "", r["x"] is not None, float("inf") if r["x"] != r["x"] else r["x"] or 0.0, r["i"])
    assert [r["position"] for r in got] == list(range(300)) and [r["shard"] for r in got] == [p * 3 // 300 for p in range(300)]
    assert [value(r) for r in got] == sorted(map(value, got))
    assert views.shards(frame.where("false"), ["k", "x"], 3).count() == 0


def test_duplicates_list_their_documents(spark, tmp_path):
    rows = [(i, "same") for i in (10, 9, 2, 111)] + [(i, None) for i in (5, 4)] + [(None, "unnamed"), (None, "unnamed"), (1, "own"), (None, "half"), (7, "half")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["n"], r["items"] or "") for r in QUERIES["duplicates"](spark, str(tmp_path)).collect())
    assert got == [(2, ""), (2, "4,5"), (2, "7"), (4, "2,9,10,111")]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted((n, items or "") for n, items in con.sql(f"SELECT n, items FROM ({ORACLES['duplicates']})").fetchall())
