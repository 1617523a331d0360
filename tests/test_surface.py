"""The app's surface: transforms, endpoints, versions, derived series, artifacts, reports; and roots, keys and names."""

import threading
from functools import partial

import pytest
from pyspark.sql import functions as F

from trailmark import app as surface
from trailmark.app import App, derived_messages, endpoint_variable, report, takes_one, version_of
from trailmark.operators import channels, frames, gates, resample
from trailmark.plans import views
from trailmark.sources import files, mcap, storage

from .test_datasource import DELTA, KEY, episode

LIMIT = 3


def helper(x):
    return x + LIMIT


def step(messages):
    return helper(messages)


def test_versions_follow_what_a_step_uses(monkeypatch):
    before = version_of(step)
    assert before == version_of(step) and version_of(step, "v9") == "v9"
    monkeypatch.setattr(step.__globals__["helper"], "__defaults__", (1,))
    assert version_of(step) != before
    monkeypatch.undo()
    monkeypatch.setitem(step.__globals__, "LIMIT", 4)
    assert version_of(step) != before
    monkeypatch.undo()
    assert version_of(step) == before
    made = lambda limit: lambda m, k={"b": 1, "a": [limit]}: (m, limit)
    assert version_of(made(1)) != version_of(made(2)) and version_of(made(1)) == version_of(made(1))
    assert version_of(partial(step, 1)) != version_of(partial(step, 2))
    loop = {}
    loop["self"] = loop
    assert version_of(lambda m: loop)


def test_callables():
    class Callable:
        def __call__(self, messages):
            return messages

    assert all(map(takes_one, (lambda m: m, lambda m, k=1: m, lambda *a: a, Callable(), partial(lambda a, b: a, b=2), len)))
    assert not any(map(takes_one, (lambda: 1, lambda a, b: 1, lambda a, *, k: 1)))


def test_endpoints(spark, tmp_path, monkeypatch):
    app = App(spark, f"file://{tmp_path}", endpoints={"vlm-one": "http://a"})
    app.check("x", uses="vlm-one")(lambda m: m)
    assert app.endpoint("vlm-one") == "http://a" and endpoint_variable("vlm-one") == "TRAILMARK_ENDPOINT_VLM_ONE"
    monkeypatch.setenv("TRAILMARK_ENDPOINT_VLM_ONE", "http://b")
    assert app.endpoint("vlm-one") == "http://b"
    monkeypatch.delenv("TRAILMARK_ENDPOINT_VLM_ONE")
    app.enrich("y", uses="other")(lambda m: m)
    with pytest.raises(ValueError, match="TRAILMARK_ENDPOINT_OTHER"):
        app.resolved()
    monkeypatch.setenv("TRAILMARK_ENDPOINT_OTHER", "http://c")
    assert app.resolved() == {"vlm-one": "http://a", "other": "http://c"} and app.manifest()["endpoints"] == ["other", "vlm-one"]
    app.endpoints["vlm.one"] = "http://d"
    with pytest.raises(ValueError, match="share"):
        app.resolved()


def test_a_transform_is_the_only_one_and_its_files_canonical(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mcap").write_bytes(episode([KEY, DELTA]))
    app = App(spark, f"file://{tmp_path}/catalog")
    plain = app.pipeline_version

    @app.transform
    def without_state(tables):
        return tables | {"messages": tables["messages"].where("topic != '/state'")}

    assert app.pipeline_version != plain
    with pytest.raises(ValueError, match="already"):
        app.transform(without_state)
    app.sync(f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = app.synced(f"file://{tmp_path}/out")["messages"]
    assert [r["topic"] for r in got.select("topic").collect()] == ["/cam", "/cam"]
    with pytest.raises(TypeError):
        App(spark, "file:///x").transform(lambda a, b: a)


def test_derived_series(spark):
    frame = spark.createDataFrame([("p", 5, 1.5, "x", True, [1.0])], "path string, log_time_ns bigint, a double, b string, c boolean, v array<double>")
    assert [tuple(r) for r in derived_messages(frame.drop("v"), "/d").collect()] == [("p", "/d", 5, '{"a":1.5,"b":"x","c":true}')]
    assert derived_messages(frame.select("path", "log_time_ns", F.lit(None).cast("double").alias("a")), "/d").first()["data"] == '{"a":null}'
    for bad, told in ((frame, "v"), (frame.select("path", "log_time_ns"), "no values"), (frame.drop("log_time_ns"), "log_time_ns"), (frame.withColumn("log_time_ns", F.lit(1.5)), "whole")):
        with pytest.raises(ValueError, match=told):
            derived_messages(bad, "/d")
    with pytest.raises(Exception, match="no time"):
        derived_messages(frame.drop("v").withColumn("log_time_ns", F.lit(None).cast("bigint")), "/d").collect()


def test_artifacts(spark, tmp_path):
    for k in ("a", "b"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "sheet.png").write_bytes(k.encode() * 10)
    rows = spark.createDataFrame(
        [("e 1", "media", "v1", {"left/cam": f"{tmp_path}/a/sheet.png", "left cam": f"file://{tmp_path}/b/sheet.png"}), ("e2", "media", "v1", {"gone": f"{tmp_path}/none.png"}), ("e3", "media", "v1", {})],
        "episode_id string, check_name string, check_version string, artifacts map<string,string>",
    )
    got = {(r["episode_id"], r["name"]): r for r in files.published_artifacts(rows, f"file://{tmp_path}/root").collect()}
    assert set(got) == {("e 1", "left/cam"), ("e 1", "left cam"), ("e2", "gone")}
    assert got["e2", "gone"]["uri"] is None and "none.png" in got["e2", "gone"]["error"]
    uris = [got["e 1", n]["uri"] for n in ("left/cam", "left cam")]
    assert len(set(uris)) == 2 and all(u.startswith(f"file://{tmp_path}/root/artifacts/e_1/media-v1/left_cam-") and u.endswith("/sheet.png") for u in uris)
    assert [open(u.removeprefix("file://"), "rb").read() for u in uris] == [b"a" * 10, b"b" * 10]


def test_report(spark):
    rows = [("e1", 0, "size", True, "passed", None), ("e2", 0, "size", True, "failed", None), ("e1", 1, "mean", False, "error", "ValueError: x"), ("e2", 1, "mean", False, "skipped", None)]
    told = report(spark.createDataFrame(rows, "episode_id string, step_order int, check_name string, critical boolean, status string, error string"))
    assert told.split("\n") == ["size (critical): + 1 passed, - 1 failed", "mean: ! 1 error, . 1 skipped", "    ValueError: x"]
    assert set(surface.STAGES) == {"sync", "meta", "labels", "media"}


def test_roots_keys_and_sources(spark, tmp_path, monkeypatch):
    assert storage.root_uri("az://c@x/y") == storage.root_uri("azure://c@x/y") == "abfss://c@x/y"
    assert storage.data_root("s3://b") == "s3a://b" and storage.data_root() == "./data"
    monkeypatch.setenv("TRAILMARK_DATA_ROOT", "gs://b")
    assert storage.data_root() == "gs://b" and storage.data_root("/x") == "/x"
    for bad in ("a/_published.json", "_temporary-1", "x/_staging"):
        with pytest.raises(ValueError, match="reserved"):
            storage.valid_key(bad)
    root = f"file://{tmp_path}/root"
    (tmp_path / "root/d").mkdir(parents=True)
    (tmp_path / "root/d/k.mcap").write_bytes(b"content")
    assert storage.source_uri(spark, "d/k.mcap", root) == f"{root}/d/k.mcap"
    assert storage.source_uri(spark, f"{tmp_path}/root/d/k.mcap", root) == f"file://{tmp_path}/root/d/k.mcap"
    assert storage.source_uri(spark, "s3://b/k", root) == "s3a://b/k"
    for absent in ("d/none.mcap", f"{tmp_path}/none"):
        with pytest.raises(FileNotFoundError):
            storage.source_uri(spark, absent, root)
    assert open(storage.fetched(spark, f"{root}/d/k.mcap", f"{tmp_path}/copy"), "rb").read() == b"content"
    folder = storage.Folder(spark, root)
    folder.create_text("new", "2")
    folder.create_text("old", "1")
    folder.replace("new", "old")
    assert folder.read_text("old") == "2" and [n for n in folder.names() if n.startswith(("old", "new"))] == ["old"]


def test_one_identity_for_all(spark, tmp_path):
    root, got = f"file://{tmp_path}/w", []
    threads = [threading.Thread(target=lambda: got.append(storage.workspace_identity(spark, root)["workspace_id"])) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == 6 and len(set(got)) == 1
    (tmp_path / "w/workspace.json").write_text('{"identity_version": "2"}')
    with pytest.raises(ValueError, match="version 1"):
        storage.workspace_identity(spark, root)


def test_channels_by_topic_and_id(spark):
    rows = [("p", 1, "/a"), ("p", 2, "/b"), ("p", 3, "/b"), ("q", 1, "/a")]
    table = spark.createDataFrame([(p, k, t, "s", "e", "m", {}, b"") for p, k, t in rows], mcap.CHANNELS)
    assert channels.topics(table.where("topic = '/a'")).count() == 2 and channels.channel(table, "/a").count() == 2
    assert [r["topic"] for r in channels.channel(table, 3).collect()] == ["/b"] and channels.channel(table, "/none").count() == 0
    for use in (channels.topics(table), channels.channel(table, "/b")):
        with pytest.raises(Exception, match="several channels have the topic /b: 2, 3"):
            use.collect()


def test_small_rules(spark):
    text = spark.createDataFrame([("bgr8; jpeg compressed bgr8",), ("PNG",), ("jpg",)], "f string")
    assert [r[0] for r in text.select(frames.image_codec(F.col("f"))).collect()] == ["mjpeg", "png", "mjpeg"]
    with pytest.raises(Exception, match="webp"):
        spark.createDataFrame([("webp",)], "f string").select(frames.image_codec(F.col("f"))).collect()
    assert resample.looks_like_rotation("value", 4, "geometry_msgs/msg/Quaternion") and not resample.looks_like_rotation("value", 3, "Quaternion")
    one = spark.createDataFrame([(1, "cam", 5, 0)], "episode_id bigint, topic string, log_time_ns bigint, seq bigint")
    assert resample.fps_estimate(one).first()["fps"] is None
    with pytest.raises(Exception, match="no frame rate can be told of 1, cam"):
        resample.fps_estimate(one, strict=True).collect()
    tallied = spark.createDataFrame([(0, 9, 100)], "error bigint, quarantined bigint, total bigint")
    gates.enforce(tallied)
    with pytest.raises(RuntimeError, match="quarantined"):
        gates.enforce(tallied, quarantine=True)


def test_percent_rank_is_that_of_a_window(spark):
    from pyspark.sql import Window

    rows = [(k % 3, None if k % 11 == 0 else float(k * 7 % 23)) for k in range(400)] + [(9, 1.0)]
    frame = spark.createDataFrame(rows, "g int, x double")
    want = frame.withColumn("percent_rank", F.percent_rank().over(Window.partitionBy("g").orderBy("x")))
    got = views.cohort(frame, "x", "g")
    plain = lambda f: sorted(map(str, f.select("g", "x", F.round("percent_rank", 12)).collect()))
    assert plain(got) == plain(want) and got.columns == ["g", "x", "z", "percent_rank"]


class Offered:
    name, protocol = "one", "p"

    def prepare_video_request(self, path, prompt):
        return {"path": path, "prompt": prompt}


def test_providers(monkeypatch):
    class Entry:
        def __init__(self, name, loaded):
            self.name, self.loaded = name, loaded

        def load(self):
            if isinstance(self.loaded, Exception):
                raise self.loaded
            return self.loaded

    entries = [Entry("one", Offered), Entry("again", Offered()), Entry("broken", ImportError("no")), Entry("odd", object())]
    monkeypatch.setattr(surface, "entry_points", lambda group: entries)
    with pytest.warns(UserWarning) as told:
        found = surface.providers()
    assert list(found) == ["one"] and isinstance(found["one"], Offered)
    assert sorted(str(w.message).split()[0] for w in told) == ["again", "broken", "odd"]


def test_files_of_a_folder(spark, tmp_path):
    folder = storage.Folder(spark, f"file://{tmp_path}")
    folder.write_bytes("d/x", b"\x00\xff" * 3)
    folder.write_bytes("d/x", b"\x00\xfe")
    assert folder.read_bytes("d/x") == b"\x00\xfe" and folder.size("d/x") == 2 and folder.read_bytes("none") is None
    assert folder.names("d") == ["x"] and folder.uri("d/x") == f"file://{tmp_path}/d/x" and folder.child(spark, "d").size("x") == 2
    with pytest.raises(FileNotFoundError):
        folder.size("none")


def test_two_writers_of_one_name(spark, tmp_path):
    """A folder never ends up in another of its name."""
    folder, done = storage.Folder(spark, f"file://{tmp_path}"), []
    for k in range(6):
        folder.write_bytes(f"new{k}/part", bytes([k]))

    def publish(k):
        try:
            folder.move(f"new{k}", "name")
            done.append(k)
        except FileExistsError:
            pass

    threads = [threading.Thread(target=publish, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and folder.names("name") == ["part"] and folder.read_bytes("name/part") == bytes(done)
    assert len([n for n in folder.names() if n.startswith("new")]) == 5


def test_a_failure_of_the_store_is_no_evidence(spark, tmp_path):
    app = App(spark, f"file://{tmp_path}/catalog")
    frame = spark.createDataFrame([("e", "t", 1)], "episode_id string, topic string, log_time_ns bigint")
    lost = tmp_path / "lost"
    frame.write.parquet(f"file://{lost}")
    gone = spark.read.parquet(f"file://{lost}")
    for part in lost.glob("*.parquet"):
        part.unlink()
    app.check("reads", version="v1")(lambda m: gone.select("episode_id", F.lit(True).alias("verdict")))
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        app.process(frame)
    other = App(spark, f"file://{tmp_path}/other")
    other.check("raises", version="v1")(lambda m: m.select("episode_id", F.raise_error(F.lit("mine")).cast("boolean").alias("verdict")))
    assert other.process(frame) == 1
    from trailmark.plans.catalog import Catalog

    assert [(r["status"], "mine" in r["error"]) for r in Catalog(spark, other.root).table("check_runs").collect()] == [("error", True)]
