"""A pipeline of checks, enrichments and derived signals over a corpus of episodes.

Steps are functions from a messages DataFrame to a DataFrame, so a whole corpus goes
through a step as one Spark job; gates and statuses are joins and windows.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import importlib.util
import inspect
import json
import os
import re
import uuid
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from importlib.metadata import entry_points
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.gates import STATUSES, gate
from .plans.catalog import Catalog
from .plans.views import latest
from .schemas import TABLES
from .sources import canonical

Step = Callable[[DataFrame], DataFrame]
STAGES = ("sync", "meta", "labels", "media")
PROFILES = {"full": STAGES, "metadata_backfill": ("meta",), "relabel": ("labels",)}
#: What a check or an enrichment gives for an episode; columns that it leaves out are null.
EVIDENCE = {
    "measurements": "map<string,double>",
    "labels": "map<string,string>",
    "tags": "array<string>",
    "intervals": "array<struct<label:string,start_ns:bigint,end_ns:bigint>>",
    "verdict": "boolean",
    "error": "string",
}


def each_episode(f: Callable[[object], dict], *columns: str) -> Step:
    """A step from a function of one episode's rows (pandas, by ``log_time_ns``) to its evidence as a dictionary.

    Only ``columns`` are read; an episode is one task's work. Where the function raises, that
    episode has an error and the others their evidence.
    """

    def step(messages: DataFrame) -> DataFrame:
        types = dict(messages.dtypes)
        kept = list(dict.fromkeys(("episode_id", "log_time_ns", *columns)))

        def over(rows):
            import pandas as pd

            out = {"episode_id": rows["episode_id"].iloc[0], **dict.fromkeys(EVIDENCE)}
            try:
                out |= f(rows.sort_values("log_time_ns", kind="stable"))
            except Exception as e:  # whatever a caller's function may raise
                out["error"] = f"{type(e).__name__}: {e}".split("\n")[0][:500]
            return pd.DataFrame([out])

        ddl = ", ".join([f"episode_id {types['episode_id']}", *(f"{c} {t}" for c, t in EVIDENCE.items())])
        return messages.select(*kept).groupBy("episode_id").applyInPandas(over, ddl)

    return step


def endpoint_variable(alias: str) -> str:
    """The environment variable that gives an endpoint's address."""
    return "TRAILMARK_ENDPOINT_" + re.sub(r"[^A-Za-z0-9]", "_", alias).upper()


def derived_messages(series: DataFrame, topic: str, *, key: str = "path") -> DataFrame:
    """``(key, topic, log_time_ns, data)`` from a derived signal: times, and a column per value or ``data`` already in JSON.

    Each value is one number, text or truth value; lists and nested values, a series without
    values and times that aren't whole numbers are refused, and a null time when it is read.
    """
    kinds = dict(series.dtypes)
    if key not in kinds or kinds.get("log_time_ns") not in ("bigint", "int"):
        raise ValueError(f"the derived signal {topic!r} needs the columns {key} and log_time_ns, the latter in whole nanoseconds")
    time = F.coalesce(F.col("log_time_ns").cast("bigint"), F.raise_error(F.lit(f"a point of the derived signal {topic!r} has no time")).cast("bigint"))
    values = sorted(set(kinds) - {key, "topic", "log_time_ns", "seq", "episode_id", "data"})
    if kinds.get("data") == "string":
        data = F.col("data")
    elif not values:
        raise ValueError(f"the derived signal {topic!r} has no values")
    elif nested := [c for c in values if kinds[c].startswith(("array", "map", "struct", "binary"))]:
        raise ValueError(f"values of the derived signal {topic!r} must be one for each point: {nested} aren't")
    else:
        data = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    return series.select(key, F.lit(topic).alias("topic"), time.alias("log_time_ns"), data.alias("data"))


def report(evidence: DataFrame) -> str:
    """A text of each step's outcomes, with the first error of those that have any. One row a step reaches the driver."""
    count = lambda s: F.sum((F.col("status") == s).cast("bigint")).alias(s)
    rows = evidence.groupBy("step_order", "check_name", "critical").agg(*map(count, STATUSES), F.min("error").alias("first_error")).orderBy("step_order").collect()
    marks = {"passed": "+", "failed": "-", "error": "!", "skipped": ".", "measured": "="}
    lines = []
    for r in rows:
        told = ", ".join(f"{marks[s]} {r[s]} {s}" for s in reversed(STATUSES) if r[s])
        lines.append(f"{r['check_name']}{' (critical)' if r['critical'] else ''}: {told}" + (f"\n    {r['first_error']}" if r["first_error"] else ""))
    return "\n".join(lines)


PROVIDERS = "trailmark.video_providers"


def providers(group: str = PROVIDERS) -> dict[str, object]:
    """What installed packages offer to attach video to a model's request, by name.

    An entry point is a class, called without arguments, or an object, with ``name``,
    ``protocol`` and ``prepare_video_request(path, prompt)``. One that can't be loaded or lacks
    these is left out with a warning; of two with one name the first stays.
    """
    found: dict[str, object] = {}
    for entry in entry_points(group=group):
        try:
            loaded = entry.load()
            offered = loaded() if inspect.isclass(loaded) else loaded
            if not (isinstance(offered.name, str) and isinstance(offered.protocol, str) and callable(offered.prepare_video_request)):
                raise TypeError("not a provider")
        except Exception as e:  # whatever another package may raise
            warnings.warn(f"{entry.name} is left out: {type(e).__name__}: {e}", stacklevel=2)
            continue
        if offered.name in found:
            warnings.warn(f"{entry.name} is left out: there is a provider {offered.name!r} already", stacklevel=2)
            continue
        found[offered.name] = offered
    return found


def load_app(named: str, root: str | None = None) -> App:
    """The app of a pipeline file, ``FILE.py`` or ``FILE.py:NAME`` (``app`` if no name is given); with ``root`` it must be that of the app."""
    path, _, variable = named.partition(".py:")
    file = Path(path + ".py" if variable else path)
    variable = variable or "app"
    if not file.is_file():
        raise FileNotFoundError(f"no pipeline file {file}")
    spec = importlib.util.spec_from_file_location(f"_pipeline_{file.stem}", file)
    module = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(module)
    except Exception as e:  # whatever a caller's file may raise
        raise ValueError(f"{file} can't be imported: {type(e).__name__}: {e}") from e
    app = getattr(module, variable, None)
    if not isinstance(app, App):
        raise ValueError(f"{file} has no App named {variable!r}")
    if root is not None and app.root.rstrip("/") != root.rstrip("/"):
        raise ValueError(f"the app of {file} has the root {app.root}, not {root}")
    return app


def measurement_rows(evidence: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, key, value_double, value_text, value_bool)``: a row for each entry of the maps ``measurements`` and ``labels``."""
    null = lambda t: F.lit(None).cast(t)
    row = lambda e, number, text: F.struct(e["key"].alias("key"), number.alias("value_double"), text.alias("value_text"), null("boolean").alias("value_bool"))
    entries = lambda c: F.coalesce(F.map_entries(c), F.array())
    numbers = F.transform(entries("measurements"), lambda e: row(e, e["value"], null("string")))
    labels = F.transform(entries("labels"), lambda e: row(e, null("double"), e["value"]))
    return evidence.select(*keys, F.inline(F.concat(numbers, labels)))


def stages(named: str | Iterable[str] | None) -> tuple[str, ...]:
    """Stages of a profile's name, of a list, or all of them; unknown ones are refused."""
    if named is None:
        return STAGES
    if isinstance(named, str):
        if named not in PROFILES:
            raise ValueError(f"no profile {named!r}; there are {sorted(PROFILES)}")
        return PROFILES[named]
    asked = tuple(named)
    if unknown := set(asked) - set(STAGES):
        raise ValueError(f"no stages {sorted(unknown)}")
    return tuple(s for s in STAGES if s in asked)


def version_of(f: Step, declared: str | None = None) -> str:
    """The declared version, or a hash of the step's source and the values that it closes over."""
    if declared:
        return declared
    return hashlib.sha256(_identity(f, set()).encode()).hexdigest()[:12]


def _identity(value, seen: set[int]) -> str:
    """What makes a value one or another, as text that is the same in every process.

    Of a function its source, defaults, closed-over values and the globals that it names, functions
    among them likewise; of modules and of what other packages define the name alone.
    """
    if value is None or isinstance(value, (bool, int, float, complex, str, bytes)):
        return repr(value)
    if id(value) in seen:
        return f"again:{type(value).__name__}"
    seen = seen | {id(value)}
    each = lambda items: ",".join(_identity(x, seen) for x in items)
    if isinstance(value, (list, tuple)):
        return f"{type(value).__name__}[{each(value)}]"
    if isinstance(value, (set, frozenset)):
        return f"set[{','.join(sorted(_identity(x, seen) for x in value))}]"
    if isinstance(value, dict):
        return f"dict[{','.join(sorted(_identity(k, seen) + ':' + _identity(v, seen) for k, v in value.items()))}]"
    if inspect.ismodule(value):
        return f"module:{value.__name__}"
    if isinstance(value, functools.partial):
        return f"partial[{_identity(value.func, seen)};{each(value.args)};{_identity(value.keywords, seen)}]"
    named = f"{getattr(value, '__module__', '')}.{getattr(value, '__qualname__', type(value).__qualname__)}"
    if inspect.isfunction(value) or inspect.isclass(value):
        if str(value.__module__).partition(".")[0] in ("pyspark", "trailmark", "numpy", "pandas", "builtins"):
            return named
        try:
            source = inspect.getsource(value)
        except (OSError, TypeError):
            source = repr(value.__code__.co_code) if inspect.isfunction(value) else named
        if inspect.isclass(value):
            return f"class[{source}]"
        names = inspect.getclosurevars(value)
        return f"function[{source};{_identity(value.__defaults__, seen)};{_identity(value.__kwdefaults__, seen)};{_identity(dict(names.nonlocals), seen)};{_identity(dict(names.globals), seen)}]"
    if dataclasses.is_dataclass(value):
        return f"{named}{_identity({f.name: getattr(value, f.name) for f in dataclasses.fields(value)}, seen)}"
    return named


#: What Spark says when a job was stopped, or its files couldn't be read or written.
STORE = re.compile(r"java\.io\.(IOException|FileNotFoundException|EOFException)|org\.apache\.hadoop\.|No space left on device|SparkContext was (?:shut|stopped)|Job \d+ cancelled|FAILED_READ_FILE|TASK_WRITE_FAILED")


def of_the_store(e: BaseException) -> bool:
    """Whether an exception is of the store or the cluster and not of a step: that isn't evidence about episodes.

    What was raised in Python, in the step itself or in a task's function, is the step's.
    """
    if type(e).__module__.partition(".")[0] not in ("pyspark", "py4j") or "PythonException" in type(e).__name__:
        return False
    return bool(STORE.search(str(e)))


def takes_one(f: Callable) -> bool:
    """Whether a callable can be called with one argument; what can't be inspected is left to the call."""
    try:
        signature = inspect.signature(f)
    except ValueError:
        return True
    try:
        signature.bind(None)
    except TypeError:
        return False
    return True


@dataclass(frozen=True)
class Registered:
    name: str
    run: Step
    version: str
    critical: bool = False
    stage: str = "meta"
    cost: int = 0


@dataclass
class App:
    """Registered steps and the catalog that their evidence goes to."""

    spark: SparkSession
    root: str
    steps: list[Registered] = field(default_factory=list)
    derived: dict[str, Registered] = field(default_factory=dict)
    endpoints: dict[str, str] = field(default_factory=dict)
    uses: dict[str, str] = field(default_factory=dict)
    override: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None

    def _add(self, f: Step, name: str | None, version: str | None, uses: str | None = None, **how) -> Step:
        if not callable(f) or not takes_one(f):
            raise TypeError("a step is called with the messages and nothing else")
        if uses is not None:
            self.uses[name or f.__name__] = uses
        step = Registered(name or f.__name__, f, version_of(f, version), **how)
        if any(s.name == step.name for s in self.steps):
            raise ValueError(f"there is a step {step.name!r} already")
        self.steps.append(step)
        return f

    def check(self, name: str | None = None, *, critical: bool = False, version: str | None = None, cost: int = 0, uses: str | None = None):
        """Registers a check; a false verdict of a critical one quarantines the episode. ``uses`` names an endpoint."""
        return lambda f: self._add(f, name, version, uses, critical=critical, cost=cost)

    def enrich(self, name: str | None = None, *, version: str | None = None, cost: int = 0, uses: str | None = None):
        """Registers an enrichment: it never runs on a quarantined episode. ``uses`` names an endpoint."""
        return lambda f: self._add(f, name, version, uses, stage="labels", cost=cost)

    def transform(self, f: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]):
        """Registers what ``sync`` does to the recordings' tables before it writes them; there is one at most.

        The tables that it returns go through the same writer, so what comes out is canonical.
        """
        if self.override is not None:
            raise ValueError("there is a transform already")
        if not callable(f) or not takes_one(f):
            raise TypeError("a transform is called with the tables and nothing else")
        self.override = f
        return f

    def endpoint(self, alias: str) -> str:
        """The address of an endpoint: that of the environment, else the one given to the app."""
        return self.resolved()[alias]

    def resolved(self) -> dict[str, str]:
        """All endpoints, the environment's before the app's; an alias that only steps name may come from there.

        Refuses aliases that share a variable, and those of steps that have no address.
        """
        aliases = sorted({*self.endpoints, *self.uses.values()})
        shared: dict[str, list[str]] = {}
        for alias in aliases:
            shared.setdefault(endpoint_variable(alias), []).append(alias)
        if clash := {v: names for v, names in shared.items() if len(names) > 1}:
            raise ValueError(f"endpoints that share an environment variable: {clash}")
        found = self.endpoints | {a: os.environ[v] for v, (a,) in shared.items() if os.environ.get(v)}
        if absent := sorted(set(self.uses.values()) - set(found)):
            raise ValueError(f"steps use endpoints without an address: {absent}; set {', '.join(map(endpoint_variable, absent))}")
        return found

    def derive(self, topic: str, *, version: str | None = None):
        """Registers a derived signal: messages to rows of a new topic."""

        def add(f: Step) -> Step:
            if topic in self.derived:
                raise ValueError(f"there is a derived topic {topic!r} already")
            self.derived[topic] = Registered(topic, f, version_of(f, version), stage="sync")
            return f

        return add

    def manifest(self) -> dict:
        steps = [{"name": s.name, "version": s.version, "critical": s.critical, "stage": s.stage} for s in self.ordered()]
        return {"manifest_version": 1, "steps": steps, "derived": {t: s.version for t, s in sorted(self.derived.items())}, "transform": version_of(self.override) if self.override else None, "endpoints": sorted(set(self.uses.values()))}

    @property
    def pipeline_version(self) -> str:
        return hashlib.sha256(json.dumps(self.manifest(), sort_keys=True).encode()).hexdigest()[:12]

    def ordered(self) -> list[Registered]:
        """Checks before enrichments, the cheap ones first, else as registered."""
        return sorted(self.steps, key=lambda s: (s.stage != "meta", s.cost))

    def with_derived(self, messages: DataFrame) -> DataFrame:
        """Messages with those of the derived topics; an existing topic is refused."""
        if not self.derived:
            return messages
        if clash := [r["topic"] for r in messages.where(F.col("topic").isin(*self.derived)).select("topic").distinct().collect()]:
            raise ValueError(f"derived topics are in the recordings already: {sorted(clash)}")
        parts = [s.run(messages).withColumn("topic", F.lit(t)) for t, s in self.derived.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, messages)

    def _found(self, step: Registered, messages: DataFrame, episodes: DataFrame, store: Callable[[DataFrame, str], DataFrame] | None) -> DataFrame:
        """What a step gives; where it raises, an error for each episode, and the other steps go on."""
        try:
            found = step.run(messages)
            return store(found.select("episode_id", *[c for c in EVIDENCE if c in found.columns]), step.name) if store else found
        except Exception as e:  # whatever a caller's step may raise
            if of_the_store(e):
                raise
            told = f"{type(e).__name__}: {e}".split("\n")[0][:500]
            return episodes.withColumn("error", F.lit(told))

    def evidence(self, messages: DataFrame, named: str | Iterable[str] | None = None, *, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
        """A row per episode and step with its evidence and status.

        A step that raises has the status error. Its own work is only done when the
        evidence is read, unless ``store`` writes it: then that counts as well.

        An enrichment is gated like a check that comes after all checks; on a run without
        checks, by the quarantine that the catalog holds.
        """
        run = stages(named)
        self.resolved()
        episodes = messages.select("episode_id").distinct()
        rows = []
        for k, s in enumerate(self.ordered()):
            if s.stage not in run:
                continue
            found = self._found(s, messages, episodes, store)
            columns = [(F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in EVIDENCE.items()]
            rows.append(episodes.join(found.select("episode_id", *columns), "episode_id", "left").select("episode_id", F.lit(k).alias("step_order"), F.lit(s.name).alias("check_name"), F.lit(s.version).alias("check_version"), F.lit(s.critical).alias("critical"), F.lit(s.stage).alias("stage"), *EVIDENCE))
        if not rows:
            raise ValueError("no registered step belongs to these stages")
        gated = gate(reduce(DataFrame.unionByName, rows))
        if "meta" not in run:
            columns = [F.when(F.col("_held"), "skipped").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in gated.columns]
            held = self._held().select(F.col("episode_id").alias("_id"), F.lit(True).alias("_held"))
            gated = gated.join(held, F.col("episode_id").cast("string") == F.col("_id"), "left").select(*columns)
        return gated

    def _held(self) -> DataFrame:
        """Episodes whose latest run in the catalog is quarantined, with its tags."""
        return latest(Catalog(self.spark, self.root).episodes(), "episode_id").where("quarantined").select("episode_id", "quarantine_tags_json")

    def sync(self, sources: str | list[str], path: str, **how) -> dict:
        """Rewrites recordings as canonical episodes below ``path``, derived topics included; returns the files published.

        From the start of the write until its end ``path`` has no marker, so that other stages
        refuse it if this one fails.
        """
        tables = canonical.read(self.spark, sources)
        tables = tables | self.override(dict(tables)) if self.override else tables
        derived, versions = None, {t: s.version for t, s in sorted(self.derived.items())}
        if self.derived:
            parts = [derived_messages(s.run(tables["messages"]), t) for t, s in self.derived.items()]
            derived = reduce(DataFrame.unionByName, parts)
        rows = canonical.rows(tables, pipeline_version=self.pipeline_version, derived=derived, derived_versions=versions, groups=how.pop("groups", None))
        canonical.unpublish(path)
        canonical.write(rows, path, overwrite=True, **how)
        return canonical.published(path)

    def synced(self, path: str) -> dict[str, DataFrame]:
        """Tables of what ``sync`` wrote, for the other stages.

        Refused without a finished write, with files that are absent or changed, and with
        episodes of another pipeline's version.
        """
        canonical.published(path)
        tables = canonical.read(self.spark, path)
        told = canonical.stamp_columns(canonical.merged(tables["metadata"]))
        if other := told.where(F.col("pipeline_version") != self.pipeline_version).limit(1).collect():
            raise ValueError(f"{other[0][0]} is of pipeline {other[0]['pipeline_version']}, not {self.pipeline_version}: run the sync stage again")
        return tables

    def process(self, messages: DataFrame, named: str | Iterable[str] | None = None, *, metadata: DataFrame | None = None) -> int:
        """Runs the stages over all episodes and appends their evidence; returns new runs.

        ``metadata`` adds columns to the ``episodes`` rows, by ``episode_id``. The run's
        fingerprint is a hash of its outcomes, so the same outcome is recorded once.
        """
        source = self.with_derived(messages) if "sync" in stages(named) else messages
        # Each step's evidence is written once: the fingerprint and all tables are of the same rows.
        catalog = Catalog(self.spark, self.root)
        scratch = f"_evidence/{uuid.uuid4().hex}"

        def store(found: DataFrame, name: str) -> DataFrame:
            path = f"{catalog.root}/{scratch}/{hashlib.sha256(name.encode()).hexdigest()[:12]}"
            found.write.parquet(path)
            return self.spark.read.schema(found.schema).parquet(path)

        try:
            return self._recorded(catalog, self.evidence(source, named, store=store), named, metadata)
        finally:
            catalog.folder.delete(scratch)

    def _recorded(self, catalog: Catalog, evidence: DataFrame, named: str | Iterable[str] | None, metadata: DataFrame | None) -> int:
        rows = evidence.withColumn("episode_id", F.col("episode_id").cast("string"))
        kept = F.when(F.col("status") != "skipped", F.struct("measurements", "labels", "tags", "intervals", "verdict", "error"))
        sort = lambda m: F.array_sort(F.map_entries(m))
        outcome = F.struct("check_name", "check_version", "status", sort(kept["measurements"]).alias("m"), sort(kept["labels"]).alias("l"), kept["tags"].alias("t"), kept["intervals"].alias("i"))
        quarantine = F.when((F.col("status") == "failed") & F.col("critical"), F.concat(F.lit("quarantined:"), F.col("check_name")))
        runs = rows.groupBy("episode_id").agg(
            F.substring(F.sha2(F.to_json(F.array_sort(F.collect_list(outcome))).cast("binary"), 256), 1, 12).alias("run_fingerprint"),
            F.array_sort(F.collect_set(quarantine)).alias("q"),
        )
        runs = runs.withColumns({"quarantined": F.size("q") > 0, "quarantine_tags_json": F.to_json("q"), "pipeline_version": F.lit(self.pipeline_version), "schema_version": F.lit("1")}).drop("q")
        if "meta" not in stages(named):  # without checks, the quarantine of the latest run goes on
            runs = runs.drop("quarantined", "quarantine_tags_json").join(self._held(), "episode_id", "left")
            runs = runs.withColumns({"quarantined": F.col("quarantine_tags_json").isNotNull(), "quarantine_tags_json": F.coalesce("quarantine_tags_json", F.lit("[]"))})
        if metadata is not None:
            runs = runs.join(metadata.withColumn("episode_id", F.col("episode_id").cast("string")), "episode_id", "left")
        episodes = runs.select(*[F.col(c) if c in runs.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in TABLES["episodes"].split(", "))])
        told = rows.join(runs.select("episode_id", "run_fingerprint"), "episode_id")
        live = told.where("status != 'skipped'")
        key = ["episode_id", "run_fingerprint", "check_name"]
        none = lambda t: F.lit(None).cast(t)
        failed = live.where("status = 'failed' and not critical").select(*key, F.concat(F.lit("failed:"), F.col("check_name")).alias("tag"))
        return catalog.append(
            episodes,
            check_runs=told.select(*key, "check_version", "critical", "status", none("double").alias("duration_s"), "error"),
            measurements=measurement_rows(live, *key, "check_version"),
            tags=live.select(*key, F.explode("tags").alias("tag")).unionByName(failed),
            intervals=live.select(*key, F.inline("intervals")),
        )
