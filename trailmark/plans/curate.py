"""Curation: SQL over the catalog's views, and manifests published whole."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Folder
from .catalog import Catalog

#: Parsed statements of these kinds are queries; every other one is refused.
QUERY_NODES = re.compile(r"^(Project|Filter|UnresolvedHaving|Aggregate|Sort|GlobalLimit|LocalLimit|Offset|Distinct|Union|Except|Intersect|Join|Pivot|Unpivot|UnresolvedWith|WithWindowDefinition|SubqueryAlias|UnresolvedSubqueryColumnAliases|UnresolvedRelation|UnresolvedInlineTable|OneRowRelation|Generate|LateralJoin|Window)$")
REFUSED_CALLS = re.compile(r"'?(reflect|java_method|try_reflect|read_files|input_file_name)\(", re.I)


@dataclass(frozen=True)
class CurationReport:
    """What a curation selected, and how far the evidence behind it goes."""

    rows: int
    output: str | None
    coverage: tuple[tuple[str, int, int, float], ...]

    def summary(self) -> str:
        lines = [f"{self.rows} rows" + (f" in {self.output}" if self.output else "")]
        lines += [f"  {name}: ran on {ran} of {total} episodes ({100 * share:.1f} %)" for name, ran, total, share in self.coverage]
        return "\n".join(lines)


def open_catalog(spark: SparkSession, root: str, *, constrained: bool = False) -> tuple[SparkSession, list[str]]:
    """A session of its own with the catalog's views, and their names.

    Double quotes name columns there, as measurement keys need quoting. A constrained
    session reads no files by path.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.ansi.enabled", "true")
    session.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    if constrained:
        session.conf.set("spark.sql.runSQLOnFiles", "false")
    catalog = Catalog(session, root)
    catalog.check_format()
    views = catalog.views()
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return session, list(views)


def refuse_unless_query(session: SparkSession, sql: str, names: list[str]) -> None:
    """Raises unless ``sql`` is one query over the named views alone.

    The check is on Spark's own parse of the text. It is a second line of defence and
    no sandbox.
    """
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    text = plan.toString()
    ctes = {m.lower() for m in re.findall(r"(?im)(?:with|,)\s+\"?(\w+)\"?\s+as\s*\(", sql)}
    known = {n.lower() for n in names} | ctes
    stack = [plan]
    while stack:
        node = stack.pop()
        if not QUERY_NODES.match(node.getClass().getSimpleName()):
            raise PermissionError(f"{node.nodeName()} isn't allowed in constrained SQL")
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    for relation in re.findall(r"UnresolvedRelation \[([^\]]*)\]", text):
        if relation.lower() not in known:
            raise PermissionError(f"{relation!r} isn't a view of the catalog")
    if m := REFUSED_CALLS.search(text):
        raise PermissionError(f"{m[1]} isn't allowed in constrained SQL")


def publish(spark: SparkSession, rows: DataFrame, output: str) -> int:
    """Writes a manifest to a private folder, then moves it into place; returns its rows."""
    parent, _, name = output.rstrip("/").rpartition("/")
    folder, staged = Folder(spark, parent), f".staging-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(f"{parent}/{staged}")
        count = spark.read.schema(rows.schema).parquet(f"{parent}/{staged}").count()
        folder.move(staged, name)
    finally:
        folder.delete(staged)
    return count


def curate(spark: SparkSession, root: str, sql: str, output: str | None = None, constrained: bool = False) -> CurationReport:
    """Runs a query over the catalog's views; with ``output`` its result is published there.

    A manifest never replaces another, and readers see all of it or nothing.
    """
    session, names = open_catalog(spark, root, constrained=constrained)
    if constrained:
        refuse_unless_query(session, sql, names)
    rows = session.sql(sql)
    count = publish(session, rows, output) if output else rows.count()
    coverage = Catalog(session, root).coverage().orderBy("check_name").collect()
    return CurationReport(count, output, tuple(tuple(r) for r in coverage))


def shard(manifest: DataFrame, order: list[str], rank: int, world: int) -> DataFrame:
    """One of ``world`` contiguous shards of a manifest."""
    from .views import shards

    return shards(manifest, order, world).where(F.col("shard") == rank).drop("shard", "position")
