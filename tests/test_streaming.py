"""Streams give what batches give; landing twice appends once."""

import random

from pyspark.sql import functions as F

from trailmark.plans.catalog import Catalog
from trailmark.streaming import online

SCHEMA = "episode_id bigint, topic string, log_time_ns bigint"


def land(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")


def stream(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def plain(rows):
    """(count, largest gap, span) of each stream, by sorting."""
    by = {}
    for e, t, at in rows:
        by.setdefault((e, t), []).append(at)
    out = {}
    for key, times in by.items():
        times.sort()
        steps = [b - a for a, b in zip(times, times[1:])]
        out[key] = (len(times), max(steps) / 1e9 if steps else None, (times[-1] - times[0]) / 1e9)
    return out


def found(frame):
    return {(r["episode_id"], r["topic"]): (r["message_count"], r["max_gap_s"], r["span_s"]) for r in frame.collect()}


def test_files_out_of_order_give_what_a_batch_gives(spark, tmp_path):
    """Messages of a stream come in any order within the delay, over several triggers and a restart."""
    rng = random.Random(4)
    rows = [(e, t, 1_000_000_000 * (k * k + e + 1)) for e in range(3) for t in ("a", "b") for k in range(12)] + [(7, "lone", 5_000_000_000)]
    rng.shuffle(rows)
    folder = f"file://{tmp_path}/out"
    for part in range(3):
        land(spark, tmp_path, rows[part::5])
    first = online.run_to_table(spark, stream(spark, tmp_path), folder, delay="1 hour")
    assert found(first) == plain([r for part in range(3) for r in rows[part::5]])
    for part in (3, 4):
        land(spark, tmp_path, rows[part::5])
    assert found(online.run_to_table(spark, stream(spark, tmp_path), folder, delay="1 hour")) == plain(rows)
    assert found(online.run_to_table(spark, stream(spark, tmp_path), folder, delay="1 hour")) == plain(rows)


def test_late_messages_and_silent_streams(spark, tmp_path):
    """What is later than the delay is left out; state that the watermark passed is folded by a timer."""
    second = 1_000_000_000
    land(spark, tmp_path, [(1, "a", 10 * second), (1, "a", 5 * second), (2, "b", 7 * second)])
    land(spark, tmp_path, [(1, "a", 1000 * second)])
    land(spark, tmp_path, [(1, "a", 1001 * second)])
    land(spark, tmp_path, [(1, "a", 8 * second)])
    folder = f"file://{tmp_path}/out"
    got = found(online.run_to_table(spark, stream(spark, tmp_path), folder, delay="60 seconds"))
    assert got == {(1, "a"): (4, 990.0, 996.0), (2, "b"): (1, None, 0.0)}


def test_a_trigger_that_runs_again_replaces_its_rows(spark, tmp_path):
    land(spark, tmp_path, [(1, "a", 10_000_000_000), (1, "a", 20_000_000_000)])
    folder = f"file://{tmp_path}/out"
    before = found(online.run_to_table(spark, stream(spark, tmp_path), folder))
    # The last trigger wrote its rows but died before it was noted as done.
    commits = sorted((p for p in (tmp_path / "out/checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    assert found(online.run_to_table(spark, stream(spark, tmp_path), folder)) == before


def test_landing_twice_appends_once(spark, tmp_path):
    schema = "episode_id string, run_fingerprint string, task string"
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    for k in range(2):
        spark.createDataFrame([("a", "f1", "fold"), ("b", f"f{k}", "fold")], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/landed")

    def append(rows):
        own = catalog.raw("episodes").columns
        return catalog.append(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in own]))

    for k in range(2):
        online.append_landed(spark, f"file://{tmp_path}/landed", schema, append, f"file://{tmp_path}/checkpoint{k}").awaitTermination()
    assert sorted((r["episode_id"], r["run_fingerprint"]) for r in catalog.episodes().collect()) == [("a", "f1"), ("b", "f0"), ("b", "f1")]
