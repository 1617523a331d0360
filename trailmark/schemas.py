"""Columns of the catalog's tables: the one place that knows them."""

from __future__ import annotations

FORMAT_VERSION = "1"
RUN = "episode_id STRING, run_fingerprint STRING"

TABLES: dict[str, str] = {
    "episodes": f"{RUN}, uri STRING, source_uri STRING, schema_version STRING, pipeline_version STRING, robot_software_version STRING, ffmpeg_version STRING, task STRING, operator STRING, success STRING, embodiment STRING, metadata_json STRING, quarantined BOOLEAN, quarantine_tags_json STRING, recorded_at TIMESTAMP",
    "check_runs": f"{RUN}, check_name STRING, check_version STRING, critical BOOLEAN, status STRING, duration_s DOUBLE, error STRING, recorded_at TIMESTAMP",
    "measurements": f"{RUN}, check_name STRING, check_version STRING, key STRING, value_double DOUBLE, value_text STRING, value_bool BOOLEAN, recorded_at TIMESTAMP",
    "tags": f"{RUN}, check_name STRING, tag STRING, recorded_at TIMESTAMP",
    "intervals": f"{RUN}, check_name STRING, label STRING, start_ns BIGINT, end_ns BIGINT, recorded_at TIMESTAMP",
}
DEPENDENTS = tuple(t for t in TABLES if t != "episodes")
#: Metadata keys with a column of their own; the others are in ``metadata_json``.
PROMOTED = ("task", "operator", "success", "embodiment")
