"""The append-only, content-addressed Parquet catalog.

An append writes its rows as a batch, a folder in each table, and then commits by creating
the next file of a log, which names the batch. Only one writer can create that file; the
others look at what was committed since, leave out what is there now, and try again. Readers
see the batches that the log names and nothing else, so an append that dies at any moment
leaves no half of a run.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEPENDENTS, FORMAT_VERSION, TABLES
from ..sources.storage import Folder
from .views import coverage, drift, keys_of, latest, new_rows, stale, status, wide


COMMITS = "_commits"
KEY = ["episode_id", "run_fingerprint"]


class Catalog:
    """Tables under a root that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)
        self._read: dict[str, dict] = {}  # commits never change

    def commits(self) -> list[dict]:
        """All commits in order: ``batch`` and its ``tables``. One that is empty or damaged is an error.

        A writer that dies while it creates a commit can leave an empty file. What it was to name
        isn't known, so it is for a person to delete; until then nothing is read past it.
        """
        for name in self.folder.names(COMMITS) if self.folder.exists(COMMITS) else []:
            if name in self._read or name.startswith(".") or not name.endswith(".json"):
                continue
            try:
                told = json.loads(self.folder.read_text(f"{COMMITS}/{name}") or "")
                self._read[name] = {"batch": told["batch"], "tables": list(told["tables"])}
            except (ValueError, KeyError, TypeError):
                raise ValueError(f"the commit {self.root}/{COMMITS}/{name} holds no batch: it is empty or damaged. Delete it, and append again what it was to add") from None
        return [self._read[name] for name in sorted(self._read)]

    def _commit(self, version: int, batch: str, tables: list[str]) -> bool:
        """Creates commit ``version``; False if another writer did."""
        return self.folder.create_text(f"{COMMITS}/{version:020d}.json", json.dumps({"batch": batch, "tables": sorted(tables)}))

    def check_format(self, create: bool = False) -> None:
        """Refuses another format version; makes the marker if asked to and there is none."""
        found = self.folder.read_text("format_version")
        if found is None and create:
            self.folder.create_text("format_version", FORMAT_VERSION)
        elif found is not None and found.strip() != FORMAT_VERSION:
            raise ValueError(f"catalog format {found.strip()!r} isn't {FORMAT_VERSION!r}")

    def raw(self, table: str) -> DataFrame:
        """All rows of the committed batches of a table; an unknown name is a KeyError.

        The schema is explicit: columns that old files lack are null, and a table
        without files is empty.
        """
        schema = TABLES[table]
        paths = [f"{self.root}/{table}/batch={c['batch']}" for c in self.commits() if table in c["tables"]]
        paths = [p for p in paths if self.folder.exists(p.removeprefix(f"{self.root}/"))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def episodes(self) -> DataFrame:
        """Committed runs, each once."""
        first = F.min_by(F.struct(*[c for c in self.raw("episodes").columns]), F.struct("recorded_at", "uri"))
        return self.raw("episodes").groupBy(*KEY).agg(first.alias("e")).select("e.*")

    def table(self, name: str) -> DataFrame:
        """Rows of a table; of a dependent one those that have the time of their run."""
        if name == "episodes":
            return self.episodes()
        rows = self.raw(name)
        return rows.join(self.episodes().select(*KEY, "recorded_at"), [*KEY, "recorded_at"], "left_semi").distinct().select(*rows.columns)

    def append(self, episodes: DataFrame, **dependents: DataFrame) -> int:
        """Adds runs that aren't there yet with all their rows; returns how many.

        A run is (``episode_id``, ``run_fingerprint``). Appending again changes nothing, but
        heals: runs that are there and lack rows of a dependent table, or have rows of another
        time than their own, get their rows anew. One ``recorded_at`` holds for a batch.
        """
        if unknown := set(dependents) - set(DEPENDENTS):
            raise KeyError(f"no such tables: {sorted(unknown)}")
        self.check_format(create=True)
        self._heal(episodes, dependents)
        while True:
            version = len(self.commits())
            now = F.lit(dt.datetime.now(dt.timezone.utc))
            new = new_rows(episodes.dropDuplicates(KEY), self.raw("episodes"), *KEY).withColumn("recorded_at", now)
            batch = uuid.uuid4().hex
            try:
                runs = self._put(batch, "episodes", new)
                count = runs.count()
                if count:
                    for table, rows in dependents.items():
                        self._put(batch, table, rows.join(runs.select(*KEY), KEY, "left_semi").withColumn("recorded_at", now))
                    while not self._commit(version + 1, batch, ["episodes", *dependents]):
                        version = len(self.commits())
                        if not runs.join(self.raw("episodes").select(*KEY), KEY, "left_semi").isEmpty():
                            break  # another writer has some of these runs now
                    else:
                        return count
                self._drop(batch)
                if not count:
                    return 0
            except BaseException:
                self._drop(batch)
                raise

    def _put(self, batch: str, table: str, rows: DataFrame) -> DataFrame:
        """Writes a batch's rows of a table in the table's columns, and reads them back."""
        path = f"{self.root}/{table}/batch={batch}"
        rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in TABLES[table].split(", ")]).write.parquet(path)
        return self.spark.read.schema(TABLES[table]).parquet(path)

    def _drop(self, batch: str) -> None:
        for table in TABLES:
            self.folder.delete(f"{table}/batch={batch}")

    def _heal(self, episodes: DataFrame, dependents: dict[str, DataFrame]) -> None:
        """Gives runs that are there the rows of ``dependents`` that they lack, with the time of the run."""
        if not self.commits():
            return
        runs = self.episodes().join(episodes.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "recorded_at")
        for table, rows in dependents.items():
            while True:
                version = len(self.commits())
                there = self.raw(table).join(runs, [*KEY, "recorded_at"], "left_semi").select(*KEY).distinct()
                lacking = rows.drop("recorded_at").join(runs, KEY).join(there, KEY, "left_anti")
                if lacking.isEmpty():
                    break
                batch = uuid.uuid4().hex
                try:
                    self._put(batch, table, lacking)
                    if self._commit(version + 1, batch, [table]):
                        break
                except BaseException:
                    self._drop(batch)
                    raise
                self._drop(batch)  # another writer was first and may have healed them

    def debris(self) -> list[str]:
        """Folders of batches that no commit names: of appends that died, or that are still going on."""
        named = {c["batch"] for c in self.commits()}
        return [f"{t}/{n}" for t in TABLES for n in self.folder.names(t) if n.removeprefix("batch=") not in named]

    def drift(self, table: str) -> DataFrame:
        """Rows whose ``recorded_at`` isn't that of their committed run."""
        return drift(self.raw(table), self.episodes())

    def views(self) -> dict[str, DataFrame]:
        """All views that curation SQL may name."""
        episodes = self.episodes()
        out = {"episodes_raw": episodes} | {t: self.table(t) for t in DEPENDENTS}
        out["episodes_latest"] = latest(episodes, "episode_id")
        out["measurements_latest"] = latest(out["measurements"], "episode_id", "key", then=("run_fingerprint", "check_name"))
        keys = keys_of(out["measurements_latest"])
        out["episodes"] = wide(out["episodes_latest"], out["measurements_latest"], keys).withColumn("status", status())
        return out

    def coverage(self) -> DataFrame:
        return coverage(self.table("check_runs"), self.episodes())

    def stale(self, **versions: str) -> DataFrame:
        return stale(self.episodes(), versions)

    def quarantine(self, episode_id: str) -> tuple[bool, str] | None:
        """Whether the episode's latest run is quarantined, and its tags; None if unknown."""
        row = latest(self.episodes().where(F.col("episode_id") == episode_id), "episode_id").select("quarantined", "quarantine_tags_json").first()
        return None if row is None else (bool(row[0]), row[1])
