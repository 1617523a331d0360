"""Registered queries over the driver's tables, each with its DuckDB counterpart.

A query applies an operator of the library to the driver's tables in the shape of its
adapter; computed doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .adapters import TOPICS, event_measurements, messages, nanoseconds, recordings, run_measurements, runs, table
from .functions import text as texts
from .app import App, measurement_rows
from .operators import channels, checks, doctor, gates, layout, resample
from .operators.series import speed, steps
from .plans import catalog, curate, views
from .schemas import TABLES
from .sources import arrow, canonical, datasource, mcap
from .streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The events as messages, in DuckDB's words; every stream oracle begins with it.
M = """m AS (SELECT user_id AS episode_id, event_type AS topic, CAST(epoch_us(ts) * 1000 AS BIGINT) AS log_time_ns,
  event_id AS seq, value, props AS data FROM events)"""
STEPS = (
    "WITH "
    + M
    + """, d0 AS (SELECT *, lag(log_time_ns) OVER w AS prev_ns, lag(value) OVER w AS prev_value FROM m
  WINDOW w AS (PARTITION BY episode_id, topic ORDER BY log_time_ns, seq)),
d AS (SELECT *, (log_time_ns - prev_ns) / 1e9::DOUBLE AS dt_s FROM d0),
sp AS (SELECT *, CASE WHEN dt_s > 0 THEN abs(value - prev_value) / dt_s END AS speed FROM d WHERE prev_ns IS NOT NULL)
"""
)
HOUR = 3600.0
LIMIT = 0.01
EPSILON = 0.002
#: Seconds of a grid step: a power of two, so that its rate is exact.
GRID_S = 32768
GRID_HZ = 1 / GRID_S


def register(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def r6(name: str, column: Column | None = None) -> Column:
    return F.round(F.col(name) if column is None else column, 6).alias(name)


def islands_sql(mask: str, label: str, least: float = 0.0) -> str:
    return (
        STEPS
        + f""", f AS (SELECT *, coalesce({mask}, false) AS is_on FROM sp),
g AS (SELECT *, CASE WHEN is_on AND NOT coalesce(lag(is_on) OVER w, false) THEN 1 ELSE 0 END AS turn FROM f
  WINDOW w AS (PARTITION BY episode_id, topic ORDER BY log_time_ns, seq)),
h AS (SELECT *, sum(turn) OVER (PARTITION BY episode_id, topic ORDER BY log_time_ns, seq) AS run FROM g)
SELECT episode_id, topic, '{label}:' || topic AS label, min(prev_ns) AS start_ns, max(log_time_ns) AS end_ns
FROM h WHERE is_on GROUP BY episode_id, topic, run HAVING (max(log_time_ns) - min(prev_ns)) / 1e9::DOUBLE >= {least}"""
    )


# --- views over runs ---------------------------------------------------------------

LATEST = """SELECT o_custkey AS episode_id, o_orderkey AS run_fingerprint, o_orderdate AS recorded_at, o_orderstatus AS status,
  o_orderpriority AS pipeline_version, o_totalprice AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders"""


@register(f"SELECT episode_id, run_fingerprint, status, round(total, 6) AS total FROM ({LATEST}) WHERE rn = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's latest run."""
    return views.latest(runs(spark, sf_dir), "episode_id").select("episode_id", "run_fingerprint", "status", r6("total"))


@register(
    """SELECT episode_id, key, run_fingerprint, round(value_double, 6) AS value_double FROM (
  SELECT o_custkey AS episode_id, 'line_' || l_linenumber AS key, o_orderkey AS run_fingerprint, l_extendedprice AS value_double,
    row_number() OVER (PARTITION BY o_custkey, l_linenumber ORDER BY o_orderdate DESC, o_orderkey DESC, l_partkey DESC, l_extendedprice DESC) AS rn
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE rn = 1"""
)
def latest_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's latest value of every key, ranked by its run's recording time."""
    joined = run_measurements(spark, sf_dir).join(runs(spark, sf_dir).select("episode_id", "run_fingerprint", "recorded_at"), "run_fingerprint")
    found = views.latest(joined, "episode_id", "key", then=("run_fingerprint", "part", "value_double"))
    return found.select("episode_id", "key", "run_fingerprint", r6("value_double"))


WIDE = f"""WITH {M}, l AS (SELECT *, row_number() OVER (PARTITION BY episode_id, topic ORDER BY log_time_ns DESC, seq DESC) AS rn FROM m),
e AS (SELECT o_custkey AS episode_id, o_orderstatus = 'F' AS quarantined,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
p AS (SELECT episode_id, {', '.join(f"max(CASE WHEN topic = '{t}' THEN round(value, 6) END) AS \"{t}\"" for t in TOPICS)} FROM l WHERE rn = 1 GROUP BY 1),
w AS (SELECT e.episode_id, CASE WHEN quarantined THEN 'quarantined' ELSE 'ok' END AS status, {', '.join(f'"{t}"' for t in TOPICS)}
  FROM e LEFT JOIN p USING (episode_id) WHERE e.rn = 1)
"""


@register(WIDE + "SELECT * FROM w")
def wide_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per episode with its status and a column per measurement key."""
    episodes = views.latest(runs(spark, sf_dir), "episode_id").select("episode_id", (F.col("status") == "F").alias("quarantined"))
    values = views.latest(event_measurements(spark, sf_dir), "episode_id", "key")
    values = values.withColumn("value_double", F.round("value_double", 6))
    return views.wide(episodes, values, list(TOPICS)).withColumn("status", views.status()).drop("quarantined")


@register(WIDE + "SELECT episode_id, view, purchase FROM w WHERE status <> 'quarantined' AND view < 50")
def curate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that aren't quarantined and whose measurement is below a bound."""
    return wide_view(spark, sf_dir).where("status != 'quarantined' and view < 50").select("episode_id", "view", "purchase")


@register(f"SELECT episode_id, CASE WHEN status = 'F' THEN 'quarantined' ELSE 'ok' END AS state, pipeline_version FROM ({LATEST}) WHERE rn = 1")
def quarantine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(spark, sf_dir).groupBy("episode_id").agg(F.max_by(F.struct("status", "pipeline_version"), F.struct("recorded_at", "run_fingerprint")).alias("l"))
    return found.select("episode_id", F.when(F.col("l.status") == "F", "quarantined").otherwise("ok").alias("state"), "l.pipeline_version")


@register(
    """WITH runs AS (SELECT d.source AS check_name, l.doc_id AS episode_id,
  CASE WHEN l.quality IS NULL THEN 'skipped' WHEN l.quality = 0 THEN 'failed' ELSE 'passed' END AS status FROM labels l JOIN documents d USING (doc_id)),
t AS (SELECT count(DISTINCT doc_id) AS total FROM documents)
SELECT check_name, CAST(count(DISTINCT CASE WHEN status IN ('passed', 'failed', 'measured') THEN episode_id END) AS BIGINT) AS ran, total,
  round(count(DISTINCT CASE WHEN status IN ('passed', 'failed', 'measured') THEN episode_id END) / total::DOUBLE, 6) AS fraction
FROM runs CROSS JOIN t GROUP BY check_name, total"""
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all episodes on which each check ran."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.col("source").alias("check_name"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("episode_id"), "quality")
    ran = labels.join(docs, "episode_id").withColumn("status", F.when(F.col("quality").isNull(), "skipped").when(F.col("quality") == 0, "failed").otherwise("passed"))
    return views.coverage(ran, docs).select("check_name", F.col("ran").cast("bigint").alias("ran"), "total", r6("fraction"))


@register(f"SELECT episode_id, run_fingerprint, pipeline_version FROM ({LATEST}) WHERE rn = 1 AND (pipeline_version IS DISTINCT FROM '1-URGENT')")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose latest run is of another pipeline version."""
    return views.stale(runs(spark, sf_dir), {"pipeline_version": "1-URGENT"}, source=F.col("episode_id")).select("episode_id", "run_fingerprint", "pipeline_version")


@register("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS items FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than one document has, with the list of these documents."""
    found = views.duplicates(table(spark, sf_dir, "documents"), F.sha2(F.col("text").cast("binary"), 256), "doc_id")
    return found.withColumn("items", F.when(F.size("items") > 0, F.array_join(F.col("items").cast("array<string>"), ",")))


@register("SELECT sha256(text) AS digest, doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose text another has too."""
    return views.duplicate_members(table(spark, sf_dir, "documents"), F.sha2(F.col("text").cast("binary"), 256), "doc_id")


@register(
    """SELECT event_id, event_type, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 5) AS z,
  round(percent_rank() OVER (PARTITION BY event_type ORDER BY value), 6) AS percent_rank FROM events WINDOW w AS (PARTITION BY event_type)"""
)
def cohort_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-score and percent rank of each value among its kind."""
    found = views.cohort(table(spark, sf_dir, "events"), "value", "event_type")
    return found.select("event_id", "event_type", F.round("z", 5).alias("z"), r6("percent_rank"))


@register("SELECT 'line_' || l_linenumber AS key, round(avg(l_extendedprice), 4) AS mean, count(*) AS n FROM lineitem GROUP BY 1")
def key_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_measurements(spark, sf_dir).groupBy("key").agg(F.round(F.avg("value_double"), 4).alias("mean"), F.count("*").alias("n"))


@register("SELECT o_orderkey AS run_fingerprint, o_orderpriority AS pipeline_version FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def version_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of pinned versions; versions have no order."""
    return runs(spark, sf_dir).where(F.col("pipeline_version").isin("1-URGENT", "2-HIGH")).select("run_fingerprint", "pipeline_version")


@register("SELECT p_partkey AS item, p_type AS tag FROM part WHERE p_type LIKE 'PROMO%' OR p_type LIKE 'ECONOMY%'")
def tag_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose tag begins with a prefix."""
    tag = F.col("p_type")
    return table(spark, sf_dir, "part").where(tag.startswith("PROMO") | tag.startswith("ECONOMY")).select(F.col("p_partkey").alias("item"), tag.alias("tag"))


# --- checks ------------------------------------------------------------------------

REGULARITY = (
    STEPS
    + """, s AS (SELECT episode_id, topic, count(*) AS message_count, median(dt_s) AS median_dt_s, max(dt_s) AS max_gap_s FROM d GROUP BY 1, 2),
v AS (SELECT d.episode_id, d.topic, avg(CASE WHEN abs(dt_s - median_dt_s) > 3600 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS violation_pct
  FROM d JOIN s USING (episode_id, topic) WHERE dt_s IS NOT NULL GROUP BY 1, 2)
SELECT episode_id, topic, message_count, round(median_dt_s, 7) AS median_dt_s, round(max_gap_s, 6) AS max_gap_s, round(violation_pct, 6) AS violation_pct
FROM s LEFT JOIN v USING (episode_id, topic)"""
)


@register(REGULARITY)
def regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.regularity(messages(spark, sf_dir), tolerance_s=HOUR)
    return found.select("episode_id", "topic", "message_count", F.round("median_dt_s", 7).alias("median_dt_s"), r6("max_gap_s"), r6("violation_pct"))


RATES = {"view": 1 / 86_400, "click": 1 / 43_200}
RATED = """p AS (SELECT *, coalesce(CASE topic WHEN 'view' THEN 86400.0::DOUBLE WHEN 'click' THEN 43200.0::DOUBLE END, median_dt_s) AS period FROM s)
"""


@register(
    STEPS
    + """, s AS (SELECT episode_id, topic, count(*) AS message_count, median(dt_s) AS median_dt_s, max(dt_s) AS max_gap_s FROM d GROUP BY 1, 2), """
    + RATED
    + """, v AS (SELECT d.episode_id, d.topic, avg(CASE WHEN abs(dt_s - period) > 3600 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS violation_pct
  FROM d JOIN p USING (episode_id, topic) WHERE dt_s IS NOT NULL GROUP BY 1, 2)
SELECT episode_id, topic, message_count, round(median_dt_s, 7) AS median_dt_s, round(max_gap_s, 6) AS max_gap_s, round(violation_pct, 6) AS violation_pct FROM p LEFT JOIN v USING (episode_id, topic)"""
)
def regularity_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regularity against the rates that two topics declare, and the median step of the others."""
    found = checks.regularity(messages(spark, sf_dir), expected_hz=RATES, tolerance_s=HOUR)
    return found.select("episode_id", "topic", "message_count", F.round("median_dt_s", 7).alias("median_dt_s"), r6("max_gap_s"), r6("violation_pct"))


@register(
    STEPS
    + """, s AS (SELECT episode_id, topic, median(dt_s) AS median_dt_s FROM d GROUP BY 1, 2), """
    + RATED
    + """SELECT d.episode_id, d.topic, 'gap:' || d.topic AS label, prev_ns AS start_ns, log_time_ns AS end_ns FROM d JOIN p USING (episode_id, topic) WHERE dt_s > 3.0::DOUBLE * period"""
)
def gaps_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.gaps(messages(spark, sf_dir), expected_hz=RATES)


GAPS = (
    STEPS
    + """, s AS (SELECT episode_id, topic, median(dt_s) AS median_dt_s FROM d GROUP BY 1, 2),
gaps AS (SELECT d.episode_id, d.topic, 'gap:' || d.topic AS label, prev_ns AS start_ns, log_time_ns AS end_ns FROM d JOIN s USING (episode_id, topic) WHERE dt_s > 3.0 * median_dt_s)
"""
)


@register(GAPS + "SELECT * FROM gaps")
def gap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.gaps(messages(spark, sf_dir))


@register(GAPS + "SELECT label, round(sum(end_ns - start_ns)::DOUBLE / 1e9::DOUBLE, 6) AS gap_s, count(*) AS n FROM gaps WHERE label LIKE 'gap:%' GROUP BY label")
def gap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds in gaps by label. Nanoseconds of more than 292 years don't fit in 64 bits, so they are summed as decimals."""
    found = checks.gaps(messages(spark, sf_dir)).where(F.col("label").startswith("gap:"))
    total = F.sum((F.col("end_ns") - F.col("start_ns")).cast("decimal(20,0)")).cast("double")
    return found.groupBy("label").agg(F.round(total / F.lit(1e9), 6).alias("gap_s"), F.count("*").alias("n"))


@register(
    f"""WITH {M}, e AS (SELECT episode_id, topic, min(log_time_ns) AS a, max(log_time_ns) AS b, count(*) AS n FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, topic) AS rn FROM e WHERE topic <> 'view')
SELECT e.episode_id, e.topic, r.topic AS reference, round((e.a - r.a) / 1e9::DOUBLE, 6) AS start_offset_s, round((e.b - r.b) / 1e9::DOUBLE, 6) AS end_offset_s
FROM e JOIN r ON r.episode_id = e.episode_id AND r.rn = 1 WHERE e.topic = 'view'"""
)
def sync_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.sync_offsets(messages(spark, sf_dir), F.col("topic") == "view")
    return found.select("episode_id", "topic", "reference", r6("start_offset_s"), r6("end_offset_s"))


@register(
    STEPS
    + f"""SELECT episode_id, topic, round(max(speed), 6) AS max_abs_velocity, CAST(count(*) FILTER (WHERE speed > {LIMIT}) AS BIGINT) AS violation_count,
  round(avg(CASE WHEN speed > {LIMIT} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS violation_pct, CAST(count(*) FILTER (WHERE dt_s <= 0) AS BIGINT) AS nonpositive_dt_count
FROM sp GROUP BY 1, 2"""
)
def discontinuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.discontinuity(messages(spark, sf_dir), velocity_limit=LIMIT)
    return found.select("episode_id", "topic", r6("max_abs_velocity"), "violation_count", r6("violation_pct"), "nonpositive_dt_count")


@register(islands_sql(f"speed > {LIMIT}", "joint_discontinuity"))
def discontinuity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.discontinuity_runs(messages(spark, sf_dir), velocity_limit=LIMIT)


@register(
    STEPS
    + """, s AS (SELECT episode_id, topic, count(*) AS message_count, median(dt_s) AS period, (max(log_time_ns) - min(log_time_ns)) / 1e9::DOUBLE AS span FROM d GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN period > 0 THEN CAST(round_even(span / period, 0) AS BIGINT) + 1 END AS expected_frame_count FROM s)
SELECT episode_id, topic, message_count, expected_frame_count,
  round((expected_frame_count - message_count) * 100.0::DOUBLE / expected_frame_count, 6) AS frame_deficit_pct FROM x WHERE expected_frame_count IS NOT NULL"""
)
def frame_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.frame_deficit(messages(spark, sf_dir)).where("expected_frame_count is not null")
    return found.withColumn("frame_deficit_pct", F.round("frame_deficit_pct", 6))


@register(
    STEPS
    + f""", i AS (SELECT episode_id, topic, sum(CASE WHEN speed < {EPSILON} THEN greatest(0, log_time_ns - prev_ns) ELSE 0 END) AS a, sum(greatest(0, log_time_ns - prev_ns)) AS b FROM sp GROUP BY 1, 2)
SELECT episode_id, topic, round(a::DOUBLE / 1e9::DOUBLE, 7) AS idle_total_s, round(coalesce(a::DOUBLE / nullif(b, 0)::DOUBLE, 0.0::DOUBLE), 6) AS idle_fraction FROM i"""
)
def idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.idle(messages(spark, sf_dir), epsilon=EPSILON).select("episode_id", "topic", F.round("idle_total_s", 7).alias("idle_total_s"), r6("idle_fraction"))


@register(islands_sql(f"speed < {EPSILON}", "idle", HOUR))
def idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.idle_runs(messages(spark, sf_dir), epsilon=EPSILON, least_s=HOUR)


@register(f"WITH {M} SELECT episode_id, round((max(log_time_ns) - min(log_time_ns)) / 1e9::DOUBLE, 6) AS duration_s, count(*) AS message_count_total, count(DISTINCT topic) AS topic_count FROM m GROUP BY 1")
def duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duration(messages(spark, sf_dir)).withColumn("duration_s", F.round("duration_s", 6))


@register(
    f"""WITH {M}, s AS (SELECT episode_id, topic, count(*) AS n, min(log_time_ns) AS a, max(log_time_ns) AS b FROM m GROUP BY 1, 2),
e AS (SELECT episode_id, sum(n) - count(*) AS steps, (max(b) - min(a)) / 1e9::DOUBLE AS span FROM s GROUP BY 1)
SELECT episode_id, round(CASE WHEN span > 0 THEN steps / span ELSE 0.0::DOUBLE END, 9) AS action_rate_hz FROM e"""
)
def action_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.action_rate(messages(spark, sf_dir)).withColumn("action_rate_hz", F.round("action_rate_hz", 9))


@register(
    f"""WITH {M}, c AS (SELECT episode_id, topic, count(*) AS n, string_agg(printf('%016X', log_time_ns) || printf('%016X', octet_length(encode(data))) || hex(encode(data)), '' ORDER BY log_time_ns, seq) AS body FROM m GROUP BY 1, 2)
SELECT episode_id, sha256(unhex(string_agg(hex(encode(topic)) || printf('%016X', n) || body, '' ORDER BY topic))) AS content_digest FROM c GROUP BY 1"""
)
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.digest(messages(spark, sf_dir))


@register(
    """WITH t AS (SELECT DISTINCT role FROM conversations), m AS (SELECT conv_id AS episode_id, role AS topic, turn, coalesce(text, '') AS data FROM conversations),
e AS (SELECT e.episode_id, t.role AS topic FROM (SELECT DISTINCT episode_id FROM m) e, t),
c AS (SELECT episode_id, topic, count(*) AS n, string_agg(printf('%016X', turn) || printf('%016X', octet_length(encode(data))) || hex(encode(data)), '' ORDER BY turn, data) AS body FROM m GROUP BY 1, 2)
SELECT e.episode_id, sha256(unhex(string_agg(hex(encode(e.topic)) || printf('%016X', coalesce(n, 0)) || coalesce(body, ''), '' ORDER BY e.topic))) AS content_digest
FROM e LEFT JOIN c USING (episode_id, topic) GROUP BY 1"""
)
def channel_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each conversation's texts, a role being a channel; one that says nothing takes part too."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id"), F.col("role").alias("topic"), F.col("turn").alias("log_time_ns"), F.xxhash64("text").alias("seq"), F.col("text").alias("data"))
    roles = said.select("topic").distinct()
    # A fixed handful of roles; Spark broadcasts them if its size check says so.
    known = said.select("episode_id").distinct().join(roles, F.lit(True))
    return checks.digest(said, known)


@register(
    """WITH m AS (SELECT l_orderkey AS episode_id, l_returnflag AS topic, CAST(epoch_us(l_shipdate) * 1000 AS BIGINT) AS log_time_ns, CAST(l_linenumber AS BIGINT) AS seq FROM lineitem),
l AS (SELECT *, lag(log_time_ns) OVER (PARTITION BY episode_id, topic ORDER BY seq, log_time_ns) AS previous_ns FROM m)
SELECT episode_id, topic, seq, log_time_ns, previous_ns FROM l WHERE log_time_ns < previous_ns"""
)
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as messages in the order of the file, where the date of shipping goes back."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_returnflag").alias("topic"), nanoseconds("l_shipdate").alias("log_time_ns"), F.col("l_linenumber").cast("bigint").alias("seq"))
    return checks.order_violations(lines)


# --- resampling --------------------------------------------------------------------


def _grid_sql(value: str) -> str:
    step = GRID_S * 1_000_000_000
    return f"""WITH {M}, t AS (SELECT episode_id, topic, log_time_ns, arg_min(value, seq) AS f, arg_max(value, seq) AS l FROM m GROUP BY 1, 2, 3),
s AS (SELECT *, lead(log_time_ns) OVER w AS nt, lead(f) OVER w AS nf FROM t WINDOW w AS (PARTITION BY episode_id, topic ORDER BY log_time_ns)),
g AS (SELECT *, unnest(range((log_time_ns + {step} - 1) // {step}, CASE WHEN nt IS NULL THEN log_time_ns // {step} + 1 ELSE (nt + {step} - 1) // {step} END)) * {step} AS grid_ns FROM s)
SELECT episode_id, topic, grid_ns, round({value}, 6) AS value FROM g"""


@register(_grid_sql("CASE WHEN grid_ns = log_time_ns OR nt IS NULL THEN l ELSE (nf - l) / (nt - log_time_ns) * (grid_ns - log_time_ns) + l END"))
def grid_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.to_grid(messages(spark, sf_dir), GRID_HZ).withColumn("value", F.round("value", 6))


@register(_grid_sql("CASE WHEN grid_ns = log_time_ns THEN f WHEN nt IS NULL OR grid_ns - log_time_ns <= nt - grid_ns THEN l ELSE nf END"))
def grid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.to_grid(messages(spark, sf_dir), GRID_HZ, policy="nearest").withColumn("value", F.round("value", 6))


@register(_grid_sql("CASE WHEN grid_ns = log_time_ns THEN f WHEN nt IS NULL OR grid_ns - log_time_ns <= nt - grid_ns THEN l ELSE nf END").replace("SELECT episode_id, topic, grid_ns, round(", "SELECT episode_id, topic, grid_ns, '{\"centi\":' || CAST(floor(100 * (").replace("END, 6) AS value FROM g", "END)) AS BIGINT) || '}' AS payload FROM g"))
def derived_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived channel's payload for each grid point."""
    grid = resample.to_grid(messages(spark, sf_dir), GRID_HZ, policy="nearest")
    return grid.select("episode_id", "topic", "grid_ns", F.to_json(F.struct(F.floor(100 * F.col("value")).alias("centi"))).alias("payload"))


#: Components of the table's vectors.
VECTOR_WIDTH = 64


@register("SELECT vec_id, " + ", ".join(f"round(embedding[{k + 1}]::DOUBLE, 6) AS embedding_{k}" for k in range(VECTOR_WIDTH)) + ", len(embedding) AS width FROM embeddings")
def vector_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector field as columns, one for each of its components."""
    vectors = table(spark, sf_dir, "embeddings")
    part = lambda k: F.round(F.get("embedding", F.lit(k)).cast("double"), 6).alias(f"embedding_{k}")
    return vectors.select("vec_id", *map(part, range(VECTOR_WIDTH)), F.size("embedding").cast("bigint").alias("width"))


@register(
    """WITH v AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM embeddings)
SELECT label, vec_id, round(list_max(list_transform(list_zip(embedding, p), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / (vec_id - q), 6) AS speed FROM v WHERE p IS NOT NULL"""
)
def vector_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest change per step of any component of a vector stream."""
    found = speed(steps(_vectors(spark, sf_dir))).where("prev_ns is not null")
    return found.select(F.col("episode_id").alias("label"), F.col("seq").alias("vec_id"), F.round("speed", 6).alias("speed"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as messages with a vector, a second apart: a label is an episode."""
    second = (F.col("vec_id") * 1_000_000_000).alias("log_time_ns")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("episode_id"), F.lit("/vector").alias("topic"), second, F.col("vec_id").alias("seq"), F.col("embedding").alias("value"))


VECTORS = """WITH m AS (SELECT label AS episode_id, '/vector' AS topic, vec_id * 1000000000 AS log_time_ns, vec_id AS seq, embedding AS value FROM embeddings),
d AS (SELECT *, lag(log_time_ns) OVER w AS prev_ns, lag(value) OVER w AS prev_value FROM m WINDOW w AS (PARTITION BY episode_id, topic ORDER BY log_time_ns, seq)),
sp AS (SELECT *, list_max(list_transform(list_zip(value, prev_value), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / ((log_time_ns - prev_ns) / 1e9::DOUBLE) AS speed FROM d WHERE prev_ns IS NOT NULL)
"""


@register(
    VECTORS
    + """SELECT episode_id, topic, round(max(speed), 6) AS max_abs_velocity, CAST(count(*) FILTER (WHERE speed > 0.05) AS BIGINT) AS violation_count,
  round(avg(CASE WHEN speed > 0.05 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS violation_pct, CAST(count(*) FILTER (WHERE log_time_ns <= prev_ns) AS BIGINT) AS nonpositive_dt_count FROM sp GROUP BY 1, 2"""
)
def vector_discontinuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps on which some component of a vector changes too fast."""
    found = checks.discontinuity(_vectors(spark, sf_dir), velocity_limit=0.05)
    return found.select("episode_id", "topic", r6("max_abs_velocity"), "violation_count", r6("violation_pct"), "nonpositive_dt_count")


@register(
    VECTORS
    + """, i AS (SELECT episode_id, topic, sum(CASE WHEN speed < 0.02 THEN log_time_ns - prev_ns ELSE 0 END) AS a, sum(log_time_ns - prev_ns) AS b FROM sp GROUP BY 1, 2)
SELECT episode_id, topic, round(a::DOUBLE / 1e9::DOUBLE, 6) AS idle_total_s, round(a::DOUBLE / b::DOUBLE, 6) AS idle_fraction FROM i"""
)
def vector_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of time on which no component of a vector moves fast."""
    return checks.idle(_vectors(spark, sf_dir), epsilon=0.02).select("episode_id", "topic", r6("idle_total_s"), r6("idle_fraction"))


FPS = STEPS + ", s AS (SELECT episode_id, topic, median(log_time_ns - prev_ns) AS p FROM d GROUP BY 1, 2), fps AS (SELECT episode_id, topic, CASE WHEN p > 0 THEN 1e9::DOUBLE / p END AS fps FROM s)\n"


@register(FPS + "SELECT episode_id, topic, round(fps, 12) AS fps, greatest(1, CAST(round_even(fps * 864000.0::DOUBLE, 0) AS INTEGER)) AS gop FROM fps WHERE fps IS NOT NULL")
def fps_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.fps_estimate(messages(spark, sf_dir)).where("fps is not null")
    return found.select("episode_id", "topic", F.round("fps", 12).alias("fps"), resample.gop_frames(F.col("fps"), 864000.0).alias("gop"))


@register(f"WITH {M} SELECT episode_id, topic, seq, CAST((row_number() OVER (PARTITION BY episode_id, topic ORDER BY log_time_ns, seq) - 1) % 4 = 0 AS BOOLEAN) AS is_keyframe FROM m WHERE topic = 'view'")
def gop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames of a camera stream begin a group of four pictures."""
    return steps(messages(spark, sf_dir).where("topic = 'view'")).select("episode_id", "topic", "seq", (F.col("step") % 4 == 0).alias("is_keyframe"))


@register(
    STEPS
    + """, n AS (SELECT episode_id, topic, seq, row_number() OVER (PARTITION BY episode_id, topic ORDER BY log_time_ns, seq) - 1 AS i, count(*) OVER (PARTITION BY episode_id, topic) AS n FROM m WHERE topic = 'view'),
k AS (SELECT DISTINCT episode_id, topic, n, unnest(range(0, 8)) AS j FROM n),
t AS (SELECT DISTINCT episode_id, topic, CASE WHEN n <= 8 THEN j ELSE CAST(round_even(j * (n - 1) / 7.0::DOUBLE, 0) AS BIGINT) END AS i FROM k WHERE j < n)
SELECT n.episode_id, n.topic, n.i AS frame, n.seq FROM n JOIN t USING (episode_id, topic, i)"""
)
def tile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames of each camera stream, evenly spread with both ends."""
    frames = steps(messages(spark, sf_dir).where("topic = 'view'"))
    counted = frames.groupBy("episode_id", "topic").agg(F.count("*").alias("n"))
    chosen = counted.select("episode_id", "topic", F.explode(F.array_distinct(gates.spread(F.col("n"), 8))).alias("frame"))
    return frames.select("episode_id", "topic", F.col("step").cast("bigint").alias("frame"), "seq").join(chosen, ["episode_id", "topic", "frame"])


@register(
    f"""WITH {M}, n AS (SELECT episode_id, seq, log_time_ns, row_number() OVER (PARTITION BY episode_id ORDER BY log_time_ns, seq) - 1 AS i,
  count(*) OVER (PARTITION BY episode_id) AS n, min(log_time_ns) OVER (PARTITION BY episode_id) AS a, max(log_time_ns) OVER (PARTITION BY episode_id) AS b FROM m WHERE topic = 'view'),
s AS (SELECT DISTINCT episode_id, n, a, b, unnest(range(0, (b - a) // 864000000000000 + 1)) AS k FROM n),
j AS (SELECT episode_id, k, least(CAST(floor(k * 864000.0::DOUBLE * ((n - 1) / nullif((b - a) / 1e9::DOUBLE, 0)) + 0.000001::DOUBLE) AS BIGINT), n - 1) AS i FROM s)
SELECT j.episode_id, j.k AS sample, n.seq FROM j JOIN n USING (episode_id, i)"""
)
def frame_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame shown at each of a fixed rate of sampling times."""
    frames = steps(messages(spark, sf_dir).where("topic = 'view'"), keys=("episode_id",)).select("episode_id", "seq", "log_time_ns", F.col("step").cast("bigint").alias("frame"))
    span = frames.groupBy("episode_id").agg(F.count("*").alias("n"), F.min("log_time_ns").alias("a"), F.max("log_time_ns").alias("b"))
    every = 864_000_000_000_000
    times = span.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("b") - F.col("a")) / every))).alias("sample"))
    fps = (F.col("n") - 1) / F.nullif((F.col("b") - F.col("a")) / F.lit(1e9), F.lit(0.0))
    shown = F.least(F.floor(F.col("sample") * F.lit(every / 1e9) * fps + F.lit(1e-6)).cast("bigint"), F.col("n") - 1)
    return times.select("episode_id", "sample", shown.alias("frame")).join(frames, ["episode_id", "frame"]).select("episode_id", "sample", "seq")


# --- layout, gates, planning --------------------------------------------------------


@register("SELECT source AS topic, count(*) AS n, round(avg(n_chars), 4) AS mean_bytes, CASE WHEN avg(n_chars) > 3200 THEN 'bulk' ELSE 'state' END AS kind FROM documents GROUP BY 1")
def topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics grouped by the mean size of their messages."""
    found = channels.sizes(table(spark, sf_dir, "documents").withColumnRenamed("source", "topic"), bulk_bytes=3200, size=F.col("n_chars"))
    return found.select("topic", "n", F.round("mean_bytes", 4).alias("mean_bytes"), "kind")


@register(
    f"""WITH RECURSIVE {M}, n AS (SELECT episode_id, seq, length(data) AS s, row_number() OVER (PARTITION BY episode_id ORDER BY log_time_ns, seq) AS i FROM m),
r AS (SELECT episode_id, seq, i, 0 AS chunk, s AS held FROM n WHERE i = 1
  UNION ALL SELECT n.episode_id, n.seq, n.i, CASE WHEN r.held > 60 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.held > 60 THEN n.s ELSE r.held + n.s END
  FROM r JOIN n ON n.episode_id = r.episode_id AND n.i = r.i + 1)
SELECT episode_id, seq, CAST(chunk AS INTEGER) AS chunk FROM r"""
)
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk of each message: a chunk is closed once it exceeds 60 bytes."""
    sized = messages(spark, sf_dir).withColumn("size", F.length("data"))
    return gates.chunks(sized, "size", 60, keys=("episode_id",), order=("log_time_ns", "seq")).select("episode_id", "seq", "chunk")


@register(
    f"""WITH {M}, c AS (SELECT episode_id, log_time_ns // 86400000000000 AS day, min(log_time_ns) AS a, max(log_time_ns) AS b, sum(length(data)) AS bytes FROM m GROUP BY 1, 2),
w AS (SELECT episode_id, log_time_ns AS x, log_time_ns + 172800000000000 AS y FROM m WHERE topic = 'signup')
SELECT w.episode_id, w.x AS start_ns, count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes FROM w JOIN c ON c.episode_id = w.episode_id AND c.a <= w.y AND c.b >= w.x GROUP BY 1, 2"""
)
def chunk_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily chunks, and bytes, that a two-day read window touches.

    A range join made an equi-join: a window names the days that it overlaps.
    """
    day = 86_400_000_000_000
    m = messages(spark, sf_dir)
    at = lambda c: F.floor(F.col(c) / day).cast("bigint")
    chunks = m.groupBy("episode_id", at("log_time_ns").alias("day")).agg(F.min("log_time_ns").alias("a"), F.max("log_time_ns").alias("b"), F.sum(F.length("data")).alias("bytes"))
    windows = m.where("topic = 'signup'").select("episode_id", F.col("log_time_ns").alias("x"), (F.col("log_time_ns") + 2 * day).alias("y"), "seq")
    days = windows.withColumn("day", F.explode(F.sequence(at("x"), at("y"))))
    met = days.join(chunks, ["episode_id", "day"]).where("a <= y and b >= x")
    return met.groupBy("episode_id", F.col("x").alias("start_ns")).agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"))


WINDOWS = f"""WITH {M}, e AS (SELECT episode_id, min(log_time_ns) AS a, max(log_time_ns) AS b FROM m GROUP BY 1),
k AS (SELECT *, unnest(range(0, 3)) AS sample FROM e),
w AS (SELECT episode_id, CAST(sample AS INTEGER) AS sample, a + CAST(floor(CAST('0x' || substr(md5('7:' || episode_id || ':' || sample), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * (greatest(0, b - a - 432000000000000) + 1)) AS BIGINT) AS start_ns FROM k)
"""
WINDOW_S = 432_000.0


@register(WINDOWS + "SELECT episode_id, sample, start_ns, start_ns + 432000000000000 AS end_ns FROM w")
def seeded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows of five days in each episode, the same in every run."""
    return _windows(messages(spark, sf_dir))


def _windows(m: DataFrame) -> DataFrame:
    ends = m.groupBy("episode_id").agg(F.min("log_time_ns").alias("first_ns"), F.max("log_time_ns").alias("last_ns"))
    return layout.windows(ends, 3, WINDOW_S, seed=7, key="episode_id")


@register(
    WINDOWS
    + """, l AS (SELECT unnest(['per-topic', 'interleaved', 'groups']) AS layout),
c AS (SELECT layout, episode_id, CASE layout WHEN 'per-topic' THEN topic WHEN 'interleaved' THEN 'all' WHEN 'groups' THEN CASE WHEN topic = 'view' THEN 'cameras' ELSE 'state' END END AS grp, log_time_ns // 864000000000000 AS part,
  min(log_time_ns) AS a, max(log_time_ns) AS b, sum(length(data)) AS bytes, bool_or(topic IN ('view', 'click')) AS used FROM m, l GROUP BY ALL),
x AS (SELECT w.layout, w.episode_id, w.sample, count(c.a) AS fetches, coalesce(sum(c.bytes), 0) AS bytes FROM (SELECT * FROM w, l) w LEFT JOIN c ON c.layout = w.layout AND c.episode_id = w.episode_id AND c.used AND c.a <= w.start_ns + 432000000000000 AND c.b >= w.start_ns GROUP BY 1, 2, 3)
SELECT layout, CAST(sum(fetches) AS BIGINT) AS fetches, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS samples FROM x GROUP BY 1"""
)
def layout_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and bytes that seeded windows over two topics touch, in three layouts with chunks of ten days."""
    m = messages(spark, sf_dir)
    asked = _windows(m)
    found = None
    for name in layout.LAYOUTS:
        named = layout.groups(name, TOPICS, ["view"])
        group = F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.col("topic"))
        part = F.floor(F.col("log_time_ns") / 864_000_000_000_000)
        chunks = m.groupBy("episode_id", group.alias("grp"), part.alias("part")).agg(F.min("log_time_ns").alias("first_ns"), F.max("log_time_ns").alias("last_ns"), F.sum(F.length("data")).alias("compressed_bytes"), F.max(F.col("topic").isin("view", "click")).alias("used"))
        cost = layout.read_cost(chunks, asked, key="episode_id", wanted=F.col("used"), width_ns=432_000_000_000_000)
        told = cost.agg(F.sum("fetches").alias("fetches"), F.sum("bytes").alias("bytes"), F.count("*").alias("samples")).select(F.lit(name).alias("layout"), "*")
        found = told if found is None else found.unionByName(told)
    return found


@register(
    """WITH m AS (SELECT l_orderkey AS episode_id, l_linenumber % 2 = 0 AS is_text, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_discount END AS value_double, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN l_returnflag = 'N' END AS value_bool FROM lineitem)
SELECT episode_id, count(*) AS n, count(v) AS known, round(avg(v), 6) AS mean FROM (SELECT *, coalesce(value_double, CASE WHEN value_bool THEN 1.0::DOUBLE WHEN value_bool IS NOT NULL THEN 0.0::DOUBLE END) AS v FROM m) GROUP BY 1"""
)
def bool_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements as numbers, of which some are truth values and some neither."""
    line = F.col("l_linenumber")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.when(line % 2 != 0, F.col("l_discount")).alias("value_double"), F.when((line % 2 == 0) & (line % 4 != 0), F.col("l_returnflag") == "N").alias("value_bool"))
    return m.withColumn("v", views.number()).groupBy("episode_id").agg(F.count("*").alias("n"), F.count("v").alias("known"), F.round(F.avg("v"), 6).alias("mean"))


STEP_ROWS = """g AS (SELECT d.source AS episode_id, row_number() OVER (PARTITION BY d.source ORDER BY l.doc_id) AS step_order, l.doc_id,
  l.doc_id % 7 = 0 AS critical, CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE l.quality = 1 END AS verdict, CASE WHEN l.doc_id % 11 = 0 THEN 'boom' END AS error FROM labels l JOIN documents d USING (doc_id)),
h AS (SELECT *, min(CASE WHEN critical AND verdict = false THEN step_order END) OVER (PARTITION BY episode_id) AS stop FROM g),
st AS (SELECT episode_id, doc_id, CASE WHEN step_order > stop THEN 'skipped' WHEN error IS NOT NULL THEN 'error' WHEN verdict = false THEN 'failed' WHEN verdict = true THEN 'passed' ELSE 'measured' END AS status FROM h)
"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("episode_id"))
    w = Window.partitionBy("episode_id").orderBy("doc_id")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("step_order", F.row_number().over(w))
    verdict = F.when(F.col("doc_id") % 3 != 0, F.col("quality") == 1)
    return gates.gate(joined.select("episode_id", "doc_id", "step_order", (F.col("doc_id") % 7 == 0).alias("critical"), verdict.alias("verdict"), F.when(F.col("doc_id") % 11 == 0, "boom").alias("error")))


@register("WITH " + STEP_ROWS + "SELECT * FROM st")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each step, with the steps after a critical failure skipped."""
    return _steps(spark, sf_dir).select("episode_id", "doc_id", "status")


TALLY = (
    "WITH "
    + STEP_ROWS
    + """, o AS (SELECT episode_id, doc_id % 5 AS batch, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS errors, bool_or(status = 'failed') AS quarantined FROM st GROUP BY 1, 2),
ta AS (SELECT batch, CAST(count(*) FILTER (WHERE errors = 0 AND NOT quarantined) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE errors = 0 AND quarantined) AS BIGINT) AS quarantined,
  CAST(count(*) FILTER (WHERE errors > 0) AS BIGINT) AS error, count(*) AS total FROM o GROUP BY batch)
"""
)


@register(TALLY + "SELECT * FROM ta")
def stage_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each batch's episodes."""
    outcomes = _steps(spark, sf_dir).groupBy("episode_id", (F.col("doc_id") % 5).alias("batch")).agg(F.sum((F.col("status") == "error").cast("int")).alias("errors"), F.max(F.col("status") == "failed").alias("quarantined"))
    return gates.tally(outcomes, "batch")


@register(TALLY + "SELECT batch, total, error, CAST(greatest(8, ceil(0.01::DOUBLE * total)) AS BIGINT) AS allowed, error > greatest(8, ceil(0.01::DOUBLE * total)) AS over_budget FROM ta")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each batch against its budget."""
    allowed = gates.budget(F.col("total"))
    return stage_tally(spark, sf_dir).select("batch", "total", "error", allowed.alias("allowed"), (F.col("error") > allowed).alias("over_budget"))


def _plan_sql(state: str, first: str, pick: str, put: str) -> str:
    return f"""WITH RECURSIVE n AS (SELECT source, doc_id, n_chars AS s, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
r AS (SELECT source, doc_id, s, i, CAST(1 AS BIGINT) AS lane, {first} AS loads FROM n WHERE i = 1
  UNION ALL SELECT source, doc_id, s, i, lane, {put} FROM (SELECT n.source, n.doc_id, n.s, n.i, r.loads, {pick} AS lane FROM r JOIN n ON n.source = r.source AND n.i = r.i + 1) x),
b AS (SELECT source, lane, list(doc_id ORDER BY doc_id) AS items, CAST(sum(s) AS BIGINT) AS total_bytes FROM r GROUP BY 1, 2)
SELECT source, CAST(row_number() OVER w - 1 AS INTEGER) AS batch, array_to_string(items, ',') AS items, total_bytes, (row_number() OVER w - 1) * 2.0::DOUBLE AS start_delay_s FROM b WINDOW w AS (PARTITION BY source ORDER BY total_bytes DESC, items)"""


@register(
    _plan_sql(
        "",
        "list_concat([CAST(s AS BIGINT)], list_resize([]::BIGINT[], CAST(least(4, n) - 1 AS BIGINT), 0::BIGINT))",
        "list_position(r.loads, list_min(r.loads))",
        "list_transform(loads, lambda v, k: CASE WHEN k = lane THEN v + s ELSE v END)",
    )
)
def plan_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches of each source's documents, balanced by size."""
    found = gates.plan(table(spark, sf_dir, "documents"), gates.by_count(4), key="source", item="doc_id", size="n_chars")
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@register(
    _plan_sql(
        "",
        "[CAST(s AS BIGINT)]",
        "coalesce(list_position(list_transform(r.loads, lambda v: v + n.s <= 20000), true), len(r.loads) + 1)",
        "CASE WHEN lane > len(loads) THEN list_append(loads, s) ELSE list_transform(loads, lambda v, k: CASE WHEN k = lane THEN v + s ELSE v END) END",
    )
)
def plan_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of each source's documents of up to 20,000 characters."""
    found = gates.plan(table(spark, sf_dir, "documents"), gates.by_bytes(20_000), key="source", item="doc_id", size="n_chars")
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@register(
    """SELECT event_id, unnest(['k', 'value', 'kind']) AS key, unnest([CAST(json_extract_string(props, '$.k') AS DOUBLE), round(value, 6), NULL]) AS value_double, unnest([NULL, NULL, event_type]) AS value_text FROM events"""
)
def check_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check's evidence as measurement rows: numbers and texts in columns of their own."""
    numbers = F.create_map(F.lit("k"), texts.json_number(F.col("props"), "k"), F.lit("value"), F.round("value", 6))
    evidence = table(spark, sf_dir, "events").select("event_id", numbers.alias("measurements"), F.create_map(F.lit("kind"), "event_type").alias("labels"))
    return measurement_rows(evidence, "event_id").drop("value_bool")


@register("SELECT e.event_id, e.user_id, e.event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_id % 2 = 0 AND p.user_id = e.user_id AND p.event_type = e.event_type)")
def append_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append adds: rows whose key isn't there yet."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return views.new_rows(events, events.where("event_id % 2 = 0"), "user_id", "event_type")


@register(
    """SELECT l_orderkey AS run_fingerprint, l_linenumber AS line, CAST(l_shipdate AS DATE) AS recorded_on, CAST(o_orderdate AS DATE) AS committed_on
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) IS DISTINCT FROM CAST(o_orderdate AS DATE)"""
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependent rows whose time isn't that of their committed run."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_fingerprint"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("recorded_on"))
    committed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_fingerprint"), F.to_date("o_orderdate").alias("recorded_on"))
    return views.drift(lines, committed, ("run_fingerprint",), "recorded_on").withColumnRenamed("committed_at", "committed_on")


@register("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, CAST((row_number() OVER (ORDER BY doc_id) - 1) * 8 // count(*) OVER () AS INTEGER) AS shard FROM documents")
def manifest_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of a manifest in order of id."""
    return views.shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 8)


@register(
    """WITH f AS (SELECT user_id, event_type AS code, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT user_id, code, event_id, CAST(greatest(0, n - 3) AS BIGINT) AS suppressed FROM f WHERE rn <= 3"""
)
def findings_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three findings of each code, and how many more there are."""
    found = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("code"), "event_id")
    return doctor.capped(found, "user_id", "code", order=("event_id",))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", texts.json_number(F.col("props"), "k").alias("k"))


@register("SELECT doc_id, lang AS task, source AS operator, '{\"n_chars\":\"' || n_chars || '\"}' AS metadata_json FROM documents")
def metadata_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted metadata keys as columns, the others as JSON."""
    metadata = F.create_map(F.lit("task"), "lang", F.lit("operator"), "source", F.lit("n_chars"), F.col("n_chars").cast("string"))
    columns, rest = texts.split_metadata(metadata, ("task", "operator"))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in columns.items()], rest.alias("metadata_json"))


@register(
    r"""SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE url END AS identity,
  coalesce(nullif(regexp_replace(regexp_replace(url, '^/+|/+$', '', 'g'), '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'root') AS file_name,
  CAST(page_id AS VARCHAR) || '-' || substr(sha256(url), 1, 12) AS folder FROM pages"""
)
def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that files of a source get."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", texts.source_identity(url, "https:").alias("identity"), texts.safe_topic(url).alias("file_name"), texts.artifact_folder(F.col("page_id").cast("string"), url).alias("folder"))


@register(
    STEPS
    + """SELECT episode_id, topic, count(*) AS message_count, round(max(dt_s), 6) AS max_gap_s, round(coalesce(sum(log_time_ns - prev_ns), 0)::DOUBLE / 1e9::DOUBLE, 6) AS span_s FROM d GROUP BY 1, 2"""
)
def streaming_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, largest gap and span of each stream, kept as state over a stream of files."""
    found = online.stream_gaps(spark, f"{sf_dir}/events.parquet")
    return found.select("episode_id", "topic", "message_count", r6("max_gap_s"), r6("span_s"))


# --- recordings and the catalog, written from the tables and read back -----------------------


def _episode(path: str = "path") -> Column:
    return F.regexp_extract(path, r"user-(\d+)", 1).cast("bigint").alias("episode_id")


def _recorded(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a canonical file for each user."""
    folder = online.work_folder(spark)
    canonical.write(canonical.rows(recordings(spark, sf_dir), pipeline_version="p1", groups={"view": "cameras"}), folder, chunk_bytes=400)
    return folder


SPAN = (1_704_067_200_000_000_000, 1_711_929_600_000_000_000)


@register(
    f"""WITH {M} SELECT episode_id, topic, log_time_ns, CAST(seq AS BIGINT) AS sequence, data FROM m
WHERE topic IN ('view', 'click') AND log_time_ns >= {SPAN[0]} AND log_time_ns < {SPAN[1]}"""
)
def recorded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of two topics within a quarter of a year, from files by byte ranges."""
    found = datasource.scan(spark, _recorded(spark, sf_dir), topics=["view", "click"], start_ns=SPAN[0], end_ns=SPAN[1])
    return found.select(_episode(), "topic", "log_time_ns", "sequence", F.col("data").cast("string").alias("data"))


@register(f"WITH {M} SELECT episode_id, topic, count(*) AS message_count, false AS has_schema, 'k' AS unit FROM m GROUP BY 1, 2")
def recorded_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel catalog of files, from their summaries; by topic, which only one channel of each has."""
    found = channels.topics(datasource.scan(spark, _recorded(spark, sf_dir), "channels"))
    return found.select(_episode(), "topic", "message_count", "has_schema", F.element_at("channel_metadata", "unit").alias("unit"))


@register(
    f"""WITH {M} SELECT DISTINCT episode_id, CASE WHEN episode_id % 2 = 0 THEN 'even' ELSE 'odd' END AS task, CAST(episode_id AS VARCHAR) AS operator, '1' AS schema_version, 'p1' AS pipeline_version,
  'user-' || episode_id || '.mcap' AS source_uri FROM m"""
)
def recorded_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's own metadata overlaid with its provenance."""
    found = canonical.merged(datasource.scan(spark, _recorded(spark, sf_dir), "metadata"))
    return found.select(_episode(), *[F.element_at("metadata", k).alias(k) for k in ("task", "operator", "schema_version", "pipeline_version", "source_uri")])


@register(f"WITH {M} SELECT episode_id, 'first_signup' AS name, min(log_time_ns) AS log_time_ns, CAST(min(seq) AS VARCHAR) AS data FROM m WHERE topic = 'signup' GROUP BY 1")
def recorded_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = datasource.scan(spark, _recorded(spark, sf_dir), "attachments")
    return found.select(_episode(), "name", "log_time_ns", F.col("data").cast("string").alias("data"))


@register(
    f"""WITH {M}, c AS (SELECT episode_id, count(*) AS n, sum(31 + octet_length(encode(data))) AS bytes FROM m GROUP BY 1)
SELECT episode_id, CAST(bytes AS BIGINT) AS bytes, n FROM c"""
)
def recorded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each file's chunks by its index, beside its messages by its statistics."""
    folder = _recorded(spark, sf_dir)
    chunks = layout.storage(datasource.scan(spark, folder, "chunks")).select("path", "bytes")
    counts = datasource.scan(spark, folder, "channels").groupBy("path").agg(F.sum("message_count").alias("n"))
    return chunks.join(counts, "path").select(_episode(), "bytes", "n")


@register(
    f"""WITH {M}, e AS (SELECT DISTINCT episode_id FROM m)
SELECT episode_id, level, code FROM (SELECT episode_id, 'error' AS level, 'missing-provenance' AS code FROM e UNION ALL SELECT episode_id, 'warning', 'missing-episode-record' FROM e WHERE episode_id % 2 = 1)"""
)
def doctor_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with files that were written without provenance, and some without their own record."""
    tables = recordings(spark, sf_dir)
    records = tables["metadata"].where(F.element_at("entries", "task") == "even").select("path", "record", "entries")
    packed = mcap.to_files(tables["messages"], channels=tables["channels"], metadata=records, limit=400)
    found = doctor.findings_of(packed)
    return found.select(_episode(), "level", "code")


def _runs_catalog(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    """A catalog of the orders' runs and lines, appended in two parts that overlap and then once more."""
    made = catalog.Catalog(spark, online.work_folder(spark))
    orders = table(spark, sf_dir, "orders").where("o_custkey % 4 = 0")
    named = {"episode_id": F.col("o_custkey").cast("string"), "run_fingerprint": F.col("o_orderkey").cast("string"), "task": F.col("o_orderpriority"), "quarantined": F.col("o_orderstatus") == "F"}
    columns = [x.split() for x in TABLES["episodes"].split(", ")]
    episodes = orders.select(*[(named[c] if c in named else F.lit(None)).cast(t).alias(c) for c, t in columns])
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    run = [F.col("o_custkey").cast("string").alias("episode_id"), F.col("l_orderkey").cast("string").alias("run_fingerprint")]
    key = F.concat(F.lit("line_"), F.col("l_linenumber").cast("string"))
    values = lines.groupBy(*run, key.alias("key")).agg(F.max("l_extendedprice").alias("value_double"))
    none = lambda t: F.lit(None).cast(t)
    values = values.select("*", F.lit("lines").alias("check_name"), F.lit("v1").alias("check_version"), none("string").alias("value_text"), none("boolean").alias("value_bool"))
    for part in ("o_orderkey % 3 != 0", "o_orderkey % 3 != 1", "true"):
        own = orders.where(part).select(F.col("o_orderkey").cast("string").alias("run_fingerprint"))
        made.append(episodes.join(own, "run_fingerprint", "left_semi"), measurements=values)
    return made


RUNS = """WITH o AS (SELECT * FROM orders WHERE o_custkey % 4 = 0),
v AS (SELECT CAST(o_custkey AS VARCHAR) AS episode_id, CAST(o_orderkey AS VARCHAR) AS run_fingerprint, 'line_' || l_linenumber AS key, round(max(l_extendedprice), 6) AS value FROM lineitem JOIN o ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)
"""


@register(RUNS + "SELECT * FROM v")
def catalog_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of a catalog to which overlapping runs were appended: each is there once, with its run's time."""
    return _runs_catalog(spark, sf_dir).table("measurements").select("episode_id", "run_fingerprint", "key", F.round("value_double", 6).alias("value"))


@register(RUNS + "SELECT CAST(o_custkey AS VARCHAR) AS episode_id, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS held FROM o GROUP BY 1 HAVING count(*) > 1")
def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constrained curation SQL over that catalog's views."""
    root = _runs_catalog(spark, sf_dir).root
    sql = "SELECT episode_id, count(*) AS runs, count_if(quarantined) AS held FROM episodes_raw GROUP BY episode_id HAVING count(*) > 1"
    session, names = curate.open_catalog(spark, root, constrained=True)
    curate.refuse_unless_query(session, sql, names)
    return session.sql(sql)


@register(
    f"""WITH {M}, s AS (SELECT episode_id, count(*) AS n, avg(value) AS mean, count(*) % 2 = 1 AS err FROM m GROUP BY 1)
SELECT CAST(episode_id AS VARCHAR) AS episode_id, key, value_double, value_text FROM (
  SELECT episode_id, 'count' AS key, CAST(n AS DOUBLE) AS value_double, NULL AS value_text FROM s
  UNION ALL SELECT episode_id, 'mean', round(mean, 6), NULL FROM s WHERE NOT err UNION ALL SELECT episode_id, 'kind', NULL, CASE WHEN n > 60 THEN 'long' ELSE 'short' END FROM s WHERE NOT err)"""
)
def app_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an app records: a critical check gates an enrichment, so that failed episodes have the check's evidence alone."""
    app = App(spark, online.work_folder(spark))

    @app.check("size", critical=True, version="v1")
    def size(m):
        return m.groupBy("episode_id").agg(F.create_map(F.lit("count"), F.count("*").cast("double")).alias("measurements"), (F.count("*") % 2 == 0).alias("verdict"))

    @app.enrich("kind", version="v1")
    def kind(m):
        return m.groupBy("episode_id").agg(F.create_map(F.lit("mean"), F.round(F.avg("value"), 6)).alias("measurements"), F.create_map(F.lit("kind"), F.when(F.count("*") > 60, "long").otherwise("short")).alias("labels"))

    app.process(messages(spark, sf_dir))
    return catalog.Catalog(spark, app.root).table("measurements").select("episode_id", "key", "value_double", "value_text")


@register("SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents")
def arrow_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table exported as Arrow shards in order and read back; positions are those of the index."""
    folder = online.work_folder(spark)
    arrow.export(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), folder, ["doc_id"], 6)
    return arrow.read(spark, folder, positions=True).select("doc_id", "lang", "n_chars", "position")
