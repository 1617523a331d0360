"""Exports, layouts and their read cost, planning from listings, stages that need a finished one, the command line."""

import hashlib
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.__main__ import main
from trailmark.app import App, load_app
from trailmark.operators import gates, layout
from trailmark.sources import arrow, canonical, files

from .test_datasource import DELTA, KEY, episode
from .test_recordings import recording


def test_export(spark, tmp_path):
    rows = spark.range(0, 1003, 1, 7).select((1003 - F.col("id")).alias("k"), F.col("id").cast("string").alias("text"), F.array(F.col("id").cast("double")).alias("v"), F.struct("id").alias("nested"), F.create_map("id", "id").alias("m"))
    index = arrow.export(rows, f"file://{tmp_path}/out", ["k"], 4)
    assert sorted(index) == [f"shard-{k:06d}.arrow" for k in range(4)] and {x["rows"] for x in index.values()} == {250, 251}
    tables = [arrow.shard_of(f"file://{tmp_path}/out", k) for k in range(4)]
    whole = pa.concat_tables(tables)
    assert whole.column_names == ["k", "text", "v"] and whole["k"].to_pylist() == list(range(1, 1004))
    assert [index[f"shard-{k:06d}.arrow"]["first"] for k in range(4)] == [0, *[sum(len(t) for t in tables[:k]) for k in (1, 2, 3)]]
    for name, told in index.items():
        raw = (tmp_path / "out" / name).read_bytes()
        assert len(raw) == told["bytes"] and hashlib.sha256(raw).hexdigest() == told["sha256"]
    assert arrow.read(spark, f"file://{tmp_path}/out").select("k", "text").exceptAll(rows.select("k", "text")).count() == 0
    with pytest.raises(Exception, match="there already"):
        arrow.export(rows, f"file://{tmp_path}/out", ["k"], 4)
    with pytest.raises(ValueError, match="nested"):
        arrow.export(rows, f"file://{tmp_path}/other", ["nested"], 4)
    with pytest.raises(FileNotFoundError):
        arrow.shard_of(f"file://{tmp_path}/out", 9)
    few = arrow.export(rows.where("k <= 2"), f"file://{tmp_path}/few", ["k"], 5)
    assert sum(x["rows"] for x in few.values()) == 2
    decoded = spark.createDataFrame([(1, (2.0, "x", [1.0], {"a": 1}))], "log_time_ns bigint, decoded struct<p:double,n:string,v:array<double>,m:map<string,int>>")
    assert arrow.channel_table(decoded).columns == ["log_time_ns", "p", "n", "v"]


def test_layouts_and_their_cost(spark, tmp_path):
    """One recording in three layouts: their order is as expected, and each cost is that of a plain count."""
    rng = random.Random(1)
    streams = [KEY[:-3] + rng.randbytes(400).replace(b"\0", b"x") for _ in range(300)]
    (tmp_path / "in.mcap").write_bytes(episode(streams))
    tables = canonical.read(spark, f"file://{tmp_path}/in.mcap")
    cost, scan = {}, {}
    for name in layout.LAYOUTS:
        out = f"file://{tmp_path}/{name}"
        canonical.write(canonical.rows(tables, pipeline_version="p", groups=layout.groups(name, ["/cam", "/state"], ["/cam"])), out, chunk_bytes=4_000)
        chunks = spark.read.format("mcap").option("table", "chunks").load(out)
        ends = chunks.groupBy("path").agg(F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))
        asked = layout.windows(ends.select(F.lit("one").alias("path"), "first_ns", "last_ns"), 20, 2e-7, seed=3)
        own = chunks.withColumn("path", F.lit("one"))
        held, seen = own.collect(), asked.collect()
        assert all(0 <= w["start_ns"] and w["end_ns"] - w["start_ns"] == 200 and w["end_ns"] <= 2991 for w in seen)
        assert asked.orderBy("sample").collect() == asked.orderBy("sample").collect() and len({w["start_ns"] for w in seen}) > 10
        got = {r["sample"]: (r["fetches"], r["bytes"]) for r in layout.read_cost(own, asked, width_ns=64).collect()}
        for w in seen:
            met = [c for c in held if c["first_ns"] <= w["end_ns"] and c["last_ns"] >= w["start_ns"]]
            assert got[w["sample"]] == (len(met), sum(c["compressed_bytes"] for c in met))
        cost[name] = sum(f for f, _ in got.values())
        number = spark.read.format("mcap").option("table", "channels").load(out).where("topic = '/state'").first()["channel_id"]
        state = layout.read_cost(own, asked, wanted=F.array_contains("channel_ids", number), width_ns=64)
        scan[name] = state.agg(F.sum("bytes")).first()[0]
        assert layout.storage(chunks).first()["chunks"] == len(held)
    assert cost["interleaved"] < cost["groups"] <= cost["per-topic"]
    assert scan["per-topic"] == scan["groups"] < scan["interleaved"]
    with pytest.raises(ValueError):
        layout.groups("other", [], [])


def test_planning_from_listings(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k, size in enumerate((900, 850, 500, 400, 300)):
        (tmp_path / f"d/{k}.bin").write_bytes(bytes(size))
    (tmp_path / "d/cam.mcap").write_bytes(recording()[0])
    (tmp_path / "d/plain.mcap").write_bytes(episode([KEY], schema="other"))
    listed = files.listing(spark, f"file://{tmp_path}/d", "*.bin")
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    sized = listed.select(F.lit("all").alias("g"), F.regexp_extract("path", r"(\d)\.bin", 1).alias("item"), "size_bytes")
    known = spark.createDataFrame([("all", str(k), s) for k, s in enumerate((900, 850, 500, 400, 300))], "g string, item string, size_bytes bigint")
    plan = lambda f: sorted(map(str, gates.plan(f, gates.by_count(2), key="g", item="item", size="size_bytes").collect()))
    assert plan(sized) == plan(known)
    every = files.listing(spark, f"file://{tmp_path}/d")
    got = {r["path"].rpartition("/")[2]: r["digest"] for r in files.digests(every, 16).collect()}
    assert got == {n: hashlib.sha256((tmp_path / "d" / n).read_bytes()).hexdigest()[:16] for n in os.listdir(tmp_path / "d")}
    channels = canonical.read(spark, f"file://{tmp_path}/d")["channels"]
    assert [r["path"].rpartition("/")[2] for r in files.with_cameras(every, channels).collect()] == ["cam.mcap"]


PIPELINE = '''
from pyspark.sql import SparkSession
from trailmark.app import App

app = App(SparkSession.builder.getOrCreate(), {root!r})


@app.check("size", version="v1")
def size(messages):
    return messages
'''


def test_stages_need_a_finished_sync(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mcap").write_bytes(episode([KEY, DELTA]))
    app = App(spark, f"file://{tmp_path}/catalog")

    @app.derive("/count", version="c1")
    def count(messages):
        return messages.where("topic = '/state'").select("path", "log_time_ns", F.lit('{"n": 1}').alias("data"))

    out = f"file://{tmp_path}/out"
    with pytest.raises(FileNotFoundError, match="marker"):
        app.synced(out)
    assert len(app.sync(f"file://{tmp_path}/in", out)) == 1
    tables = app.synced(out)
    assert {r["topic"] for r in tables["messages"].select("topic").distinct().collect()} == {"/cam", "/state", "/count"}
    # A sync that fails leaves no marker, though files of the last one are there.
    (tmp_path / "in/b.mcap").write_bytes(episode([DELTA + DELTA]))
    with pytest.raises(Exception, match="multiple-access-units"):
        app.sync(f"file://{tmp_path}/in", out)
    with pytest.raises(FileNotFoundError, match="marker"):
        app.synced(out)
    (tmp_path / "in/b.mcap").unlink()
    app.sync(f"file://{tmp_path}/in", out)
    app.check("more", version="v1")(lambda messages: messages)
    with pytest.raises(ValueError, match="run the sync stage again"):
        app.synced(out)
    app.sync(f"file://{tmp_path}/in", out)
    next((tmp_path / "out").glob("*.mcap")).write_bytes(b"changed")
    with pytest.raises(ValueError, match="isn't whole"):
        app.synced(out)


def test_command_line(spark, tmp_path, capsys):
    from trailmark.plans.catalog import Catalog

    root = f"file://{tmp_path}/catalog"
    Catalog(spark, root).check_format(create=True)
    file = tmp_path / "pipe.py"
    file.write_text(PIPELINE.format(root=root))
    assert main(["manifest", str(file)]) == 0
    told = capsys.readouterr().out
    assert '"size"' in told and load_app(f"{file}:app").pipeline_version == load_app(str(file)).pipeline_version
    for bad in (["manifest", str(tmp_path / "none.py")], ["manifest", f"{file}:other"], ["curate", root], ["stale", root]):
        assert main(bad) == 2
    (tmp_path / "broken.py").write_text("1 / 0")
    assert main(["manifest", str(tmp_path / "broken.py")]) == 2 and "ZeroDivisionError" in capsys.readouterr().err
    (tmp_path / "q.sql").write_text("SELECT count(*) AS n FROM episodes")
    assert main(["curate", root, "--sql-file", str(tmp_path / "q.sql")]) == 0 and "1 rows" in capsys.readouterr().out
    assert main(["curate", root, "SELECT 1", "--sql-file", str(tmp_path / "q.sql")]) == 2
    assert main(["stale", root, "--pipeline", str(file), "--exit-code"]) == 0
    (tmp_path / "good.mcap").write_bytes(episode([KEY]))
    (tmp_path / "bad.mcap").write_bytes(b"nothing")
    assert main(["doctor", str(tmp_path / "good.mcap")]) == 0 and main(["doctor", str(tmp_path / "bad.mcap")]) == 1
