"""The catalog: idempotent appends, latest and wide views, curation and its limits."""

import pytest
from pyspark.sql import functions as F

from trailmark.app import App, each_episode, stages
from trailmark.plans.catalog import Catalog
from trailmark.plans.curate import curate, shard
from trailmark.schemas import TABLES
from trailmark.sources.storage import Folder, root_uri, valid_key

MESSAGES = "episode_id string, topic string, log_time_ns bigint, seq bigint, value double, data string"


@pytest.fixture
def app(spark, tmp_path):
    app = App(spark, f"file://{tmp_path}/catalog")

    @app.check("size", critical=True, version="v1")
    def size(messages):
        return messages.groupBy("episode_id").agg(F.create_map(F.lit("/arm/count"), F.count("*").cast("double")).alias("measurements"), (F.count("*") >= 2).alias("verdict"))

    @app.check("mean")
    def mean(messages):
        return messages.groupBy("episode_id").agg(
            F.create_map(F.lit("mean"), F.avg("value")).alias("measurements"),
            F.array(F.lit("seen")).alias("tags"),
            F.array(F.struct(F.lit("span").alias("label"), F.min("log_time_ns").alias("start_ns"), F.max("log_time_ns").alias("end_ns"))).alias("intervals"),
            (F.avg("value") < 5).alias("verdict"),
        )

    @app.enrich("label")
    def label(messages):
        return messages.groupBy("episode_id").agg(F.create_map(F.lit("kind"), F.lit("arm")).alias("labels"))

    return app


@pytest.fixture
def messages(spark):
    rows = [("a", "t", 1, 0, 1.0, ""), ("a", "t", 2, 1, 3.0, ""), ("b", "t", 1, 2, 7.0, ""), ("c", "t", 1, 3, 8.0, ""), ("c", "t", 5, 4, 9.0, "")]
    return spark.createDataFrame(rows, MESSAGES)


def test_process_and_views(spark, app, messages, tmp_path):
    root = app.root
    assert app.process(messages) == 3
    assert app.process(messages) == 0  # the same outcomes
    views = Catalog(spark, root).views()
    wide = {r["episode_id"]: r for r in views["episodes"].collect()}
    assert wide["a"]["mean"] == 2.0 and wide["a"]["status"] == "ok" and wide["a"]["/arm/count"] == 2.0
    assert wide["b"]["status"] == "quarantined" and wide["b"]["mean"] is None
    status = {(r["episode_id"], r["check_name"]): r["status"] for r in views["check_runs"].collect()}
    assert status[("b", "size")] == "failed" and status[("b", "mean")] == status[("b", "label")] == "skipped"
    assert status[("c", "mean")] == "failed" and status[("a", "label")] == "measured"
    assert {(r["episode_id"], r["tag"]) for r in views["tags"].collect()} == {("a", "seen"), ("c", "seen"), ("c", "failed:mean")}
    assert {(r["check_name"], r["ran"], r["total"]) for r in Catalog(spark, root).coverage().collect()} == {("size", 3, 3), ("mean", 2, 3), ("label", 2, 3)}
    assert Catalog(spark, root).quarantine("b") == (True, '["quarantined:size"]')
    assert Catalog(spark, root).quarantine("nobody") is None
    assert Catalog(spark, root).drift("measurements").count() == 0
    assert Catalog(spark, root).stale(pipeline_version="other").count() == 3

    report = curate(spark, root, 'SELECT episode_id, "/arm/count" AS n FROM episodes WHERE status != \'quarantined\' AND mean < 5', f"file://{tmp_path}/cut")
    assert report.rows == 1 and "size: ran on 3 of 3 episodes (100.0 %)" in report.summary()
    assert spark.read.parquet(f"file://{tmp_path}/cut").collect()[0]["episode_id"] == "a"
    with pytest.raises(FileExistsError):
        curate(spark, root, "SELECT 1 AS x", f"file://{tmp_path}/cut")


def test_errors_are_rows(spark, messages, tmp_path):
    """A step that raises, at once, in a job or for one episode, is an error there; the other steps go on."""
    app = App(spark, f"file://{tmp_path}/errors")
    ran = spark.sparkContext.accumulator(0)

    @app.check("at_once", version="1")
    def at_once(rows):
        raise KeyError("nothing here")

    @app.check("in_a_job", version="1")
    def in_a_job(rows):
        return rows.groupBy("episode_id").agg(F.raise_error(F.lit("no such field")).cast("boolean").alias("verdict"))

    def one(rows):
        ran.add(1)
        if rows["value"].max() > 8:
            raise ValueError("too large")
        return {"measurements": {"top": float(rows["value"].max())}, "verdict": True, "tags": ["told"]}

    app.check("each", version="1")(each_episode(one, "value"))
    assert app.process(messages) == 3 and ran.value == 3
    runs = {(r["episode_id"], r["check_name"]): (r["status"], r["error"]) for r in Catalog(spark, app.root).table("check_runs").collect()}
    assert {runs[(e, "at_once")][0] for e in "abc"} == {runs[(e, "in_a_job")][0] for e in "abc"} == {"error"}
    assert runs[("a", "each")] == runs[("b", "each")] == ("passed", None)
    assert runs[("c", "each")] == ("error", "ValueError: too large") and "nothing here" in runs[("a", "at_once")][1]
    assert {(r["episode_id"], r["value_double"]) for r in Catalog(spark, app.root).table("measurements").collect()} == {("a", 3.0), ("b", 7.0)}
    assert "_evidence" not in Folder(spark, app.root).names() or not Folder(spark, app.root).names("_evidence")


def test_relabel_keeps_measurements_and_gate(spark, app, messages):
    app.process(messages)
    assert app.process(messages, "relabel") == 3
    views = Catalog(spark, app.root).views()
    latest = {(r["episode_id"], r["key"]) for r in views["measurements_latest"].collect()}
    assert {("a", "mean"), ("a", "kind"), ("b", "/arm/count")} <= latest and ("b", "kind") not in latest
    assert {r["episode_id"]: r["status"] for r in views["episodes"].collect()} == {"a": "ok", "b": "quarantined", "c": "ok"}


def test_uncommitted_rows_are_invisible(spark, app, messages, tmp_path):
    app.process(messages)
    catalog = Catalog(spark, app.root)
    catalog.raw("tags").limit(1).withColumn("run_fingerprint", F.lit("gone")).write.mode("append").parquet(f"{app.root}/tags/batch=debris")
    assert catalog.table("tags").where("run_fingerprint = 'gone'").count() == 0
    with pytest.raises(KeyError):
        catalog.raw("nothing")
    with pytest.raises(KeyError):
        catalog.append(catalog.raw("episodes"), nothing=catalog.raw("tags"))


def test_constrained_sql(spark, app, messages, tmp_path):
    app.process(messages)
    ok = ["SELECT episode_id FROM episodes", "WITH x AS (SELECT * FROM tags) SELECT count(*) AS n FROM x", "SELECT * FROM episodes WHERE episode_id IN (SELECT episode_id FROM tags)"]
    for sql in ok:
        curate(spark, app.root, sql, constrained=True)
    bad = [
        f"SELECT * FROM parquet.`{tmp_path}/catalog/tags`",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x",
        "SET spark.sql.ansi.enabled=false",
        f"INSERT OVERWRITE DIRECTORY '{tmp_path}/x' USING parquet SELECT 1 AS a",
        "SELECT * FROM elsewhere",
        "SELECT episode_id FROM episodes WHERE episode_id IN (SELECT a FROM elsewhere)",
        "CREATE TEMP VIEW v AS SELECT 1 AS a",
    ]
    for sql in bad:
        with pytest.raises(PermissionError):
            curate(spark, app.root, sql, constrained=True)


def test_format_and_empty(spark, tmp_path):
    root = f"file://{tmp_path}/empty"
    assert Catalog(spark, root).raw("episodes").count() == 0 and Catalog(spark, root).coverage().count() == 0
    Folder(spark, root).create_text("format_version", "99")
    with pytest.raises(ValueError):
        Catalog(spark, root).check_format()


def test_app_rules(spark, tmp_path):
    app = App(spark, f"file://{tmp_path}")
    app.check("x")(lambda m: m)
    with pytest.raises(ValueError):
        app.check("x")(lambda m: m)
    with pytest.raises(TypeError):
        app.check("y")(lambda a, b: a)
    assert stages("relabel") == ("labels",) and stages(["media", "meta"]) == ("meta", "media")
    with pytest.raises(ValueError):
        stages("nothing")
    before = app.pipeline_version
    app.check("z", version="1")(lambda m: m)
    assert app.pipeline_version != before


def test_derived(spark, tmp_path, messages):
    app = App(spark, f"file://{tmp_path}")
    app.derive("double")(lambda m: m.withColumn("value", F.col("value") * 2))
    assert app.with_derived(messages).where("topic = 'double'").count() == 5
    app.derive("t")(lambda m: m)
    with pytest.raises(ValueError):
        app.with_derived(messages)


def test_storage(spark, tmp_path):
    assert root_uri("s3://b/x") == "s3a://b/x" and root_uri("/a") == "/a"
    for bad in ("ftp://x", "http://x"):
        with pytest.raises(ValueError):
            root_uri(bad)
    for bad in ("", "/a", "a/../b", "a//b"):
        with pytest.raises(ValueError):
            valid_key(bad)
    folder = Folder(spark, f"file://{tmp_path}")
    assert folder.create_text("k", "one") and not folder.create_text("k", "two") and folder.read_text("k") == "one"
    folder.move("k", "d/e")
    assert folder.names("d") == ["e"] and folder.read_text("k") is None


def test_shards(spark):
    rows = spark.range(10).withColumnRenamed("id", "x").repartition(3)
    parts = [[r["x"] for r in shard(rows, ["x"], k, 3).orderBy("x").collect()] for k in range(3)]
    assert sum(parts, []) == list(range(10)) and max(map(len, parts)) - min(map(len, parts)) <= 1


RUN = "episode_id string, run_fingerprint string, task string"
ROW = "episode_id string, run_fingerprint string, check_name string, tag string"


def filled(spark, names, table_ddl=None):
    frame = spark.createDataFrame([(n, f"f-{n}", "t") for n in names], RUN)
    return frame.select(*[F.col(c) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in TABLES["episodes"].split(", "))])


def tagged(spark, names):
    return spark.createDataFrame([(n, f"f-{n}", "c", f"tag-{n}") for n in names], ROW)


def one_time(catalog, names):
    """Each run once, its tags once, all with one time."""
    rows = catalog.episodes().join(catalog.table("tags").withColumnRenamed("recorded_at", "at"), ["episode_id", "run_fingerprint"]).collect()
    return sorted(r["episode_id"] for r in rows) == sorted(names) and all(r["at"] == r["recorded_at"] for r in rows) and catalog.raw("episodes").count() == len(names)


def test_a_crash_between_any_two_steps_leaves_no_half(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/c"
    steps = []

    def watched(name):
        real = getattr(Catalog, name)

        def f(self, *a, **k):
            steps.append(name)
            if len(steps) == dies:
                raise KeyboardInterrupt
            return real(self, *a, **k)

        return f

    for name in ("_put", "_commit", "_drop"):
        monkeypatch.setattr(Catalog, name, watched(name))
    for dies in range(1, 4):  # the first table, the second table, the commit
        steps.clear()
        with pytest.raises(KeyboardInterrupt):
            Catalog(spark, root).append(filled(spark, "ab"), tags=tagged(spark, "ab"))
        dies_later, dies = dies, 0
        assert Catalog(spark, root).raw("episodes").count() == 0 and Catalog(spark, root).table("tags").count() == 0
        dies = dies_later
    # One that can't even clear up leaves debris that nobody reads.
    dies = 0
    monkeypatch.setattr(Catalog, "_drop", lambda self, batch: None)
    monkeypatch.setattr(Catalog, "_commit", lambda self, *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        Catalog(spark, root).append(filled(spark, "ab"), tags=tagged(spark, "ab"))
    monkeypatch.undo()
    catalog = Catalog(spark, root)
    assert len(catalog.debris()) == 2 and catalog.raw("tags").count() == 0
    assert catalog.append(filled(spark, "ab"), tags=tagged(spark, "ab")) == 2
    assert catalog.append(filled(spark, "ab"), tags=tagged(spark, "ab")) == 0
    assert one_time(catalog, "ab") and len(catalog.debris()) == 2


def test_two_writers_of_one_run(spark, tmp_path, monkeypatch):
    """All are ready to commit at the same time; the runs that they share are there once."""
    import threading

    root = f"file://{tmp_path}/c"
    Catalog(spark, root).check_format(create=True)
    gate = threading.Barrier(3)
    real = Catalog._commit
    first = threading.local()

    def commit(self, *a):
        if not getattr(first, "passed", False):
            first.passed = True
            gate.wait(120)
        return real(self, *a)

    monkeypatch.setattr(Catalog, "_commit", commit)
    added = {}

    def write(k, names):
        added[k] = Catalog(spark, root).append(filled(spark, names), tags=tagged(spark, names))

    threads = [threading.Thread(target=write, args=x) for x in ((0, "ab"), (1, "bc"), (2, "xy"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    catalog = Catalog(spark, root)
    assert sum(added.values()) == 5 and added[2] == 2
    assert one_time(catalog, "abcxy") and catalog.debris() == [] and len(catalog.commits()) == 3


def test_appending_again_heals(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    catalog = Catalog(spark, root)
    catalog.append(filled(spark, "ab"), tags=tagged(spark, "ab"))
    batch = catalog.commits()[0]["batch"]
    # The rows of one run are gone, those of the other have another time.
    path = f"{tmp_path}/c/tags/batch={batch}"
    stale = catalog.raw("tags").where("episode_id = 'a'").withColumn("recorded_at", F.expr("recorded_at - interval 1 hour"))
    stale.write.parquet(f"file://{tmp_path}/stale")
    import shutil

    shutil.rmtree(path)
    shutil.copytree(f"{tmp_path}/stale", path)
    assert catalog.table("tags").count() == 0 and catalog.drift("tags").count() == 1
    assert Catalog(spark, root).append(filled(spark, "ab"), tags=tagged(spark, "ab")) == 0
    assert one_time(Catalog(spark, root), "ab") and len(Catalog(spark, root).commits()) == 2
    assert Catalog(spark, root).append(filled(spark, "abc"), tags=tagged(spark, "abc")) == 1
    assert one_time(Catalog(spark, root), "abc") and len(Catalog(spark, root).commits()) == 3


def test_an_empty_commit_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    Catalog(spark, root).append(filled(spark, "a"))
    (tmp_path / "c/_commits/00000000000000000002.json").write_text("")
    for use in (lambda c: c.episodes(), lambda c: c.append(filled(spark, "b"))):
        with pytest.raises(ValueError, match="empty or damaged"):
            use(Catalog(spark, root))
    (tmp_path / "c/_commits/00000000000000000002.json").unlink()
    assert Catalog(spark, root).append(filled(spark, "b")) == 1
