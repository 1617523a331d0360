"""Small expressions over strings, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_topic(topic: Column) -> Column:
    """A topic as a file name: slashes at the ends go, other odd characters become ``_``."""
    trimmed = F.regexp_replace(topic, r"^/+|/+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(trimmed, r"[^A-Za-z0-9_.-]+", "_"), F.lit("")), F.lit("root"))


def artifact_folder(stem: Column, identity: Column) -> Column:
    return F.concat_ws("-", stem, F.substring(F.sha2(identity.cast("binary"), 256), 1, 12))


def source_identity(uri: Column, root: str) -> Column:
    """The key relative to a root, or the whole URI if it lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(uri, F.lit(prefix)), F.substring(uri, len(prefix) + 1, 1 << 30)).otherwise(uri)


def json_number(data: Column, field: str) -> Column:
    return F.get_json_object(data, f"$.{field}").try_cast("double")


def split_metadata(metadata: Column, promoted: tuple[str, ...]) -> tuple[dict[str, Column], Column]:
    """The promoted keys' columns, and the rest as JSON with sorted keys."""
    rest = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(metadata, lambda k, _: ~k.isin(*promoted)))))
    return {k: F.try_element_at(metadata, F.lit(k)) for k in promoted}, F.to_json(rest)


def fingerprint(parts: Column, digits: int = 12) -> Column:
    """Hex digits of the SHA-256 of a struct or array as JSON."""
    return F.substring(F.sha2(F.to_json(parts).cast("binary"), 256), 1, digits)
