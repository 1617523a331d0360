"""Command line: curate, stale, doctor and manifest. Exit codes: 2 bad input, 1 findings or failure."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .app import load_app
from .operators.doctor import findings
from .plans.catalog import Catalog
from .plans.curate import curate


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trailmark")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("curate", help="run SQL over a catalog")
    c.add_argument("root"), c.add_argument("sql", nargs="?"), c.add_argument("--sql-file"), c.add_argument("--output"), c.add_argument("--constrained", action="store_true")
    s = commands.add_parser("stale", help="list sources whose latest run is of another version")
    s.add_argument("root"), s.add_argument("--pipeline-version"), s.add_argument("--pipeline", help="FILE.py[:NAME], for its version"), s.add_argument("--exit-code", action="store_true")
    d = commands.add_parser("doctor", help="check recordings")
    d.add_argument("paths", nargs="+")
    m = commands.add_parser("manifest", help="print a pipeline's steps and versions as JSON")
    m.add_argument("pipeline", help="FILE.py[:NAME]")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if a.command == "curate":
            if (a.sql is None) == (a.sql_file is None):
                raise ValueError("give either SQL or --sql-file")
            sql = a.sql if a.sql is not None else Path(a.sql_file).read_text()
            print(curate(spark, a.root, sql, a.output, a.constrained).summary())
            return 0
        if a.command == "stale":
            if (a.pipeline is None) == (a.pipeline_version is None):
                raise ValueError("give either --pipeline or --pipeline-version")
            # A pipeline is the whole target, the format's version included.
            target = {"pipeline_version": a.pipeline_version} if a.pipeline is None else {"pipeline_version": load_app(a.pipeline).pipeline_version, "schema_version": "1"}
            rows = Catalog(spark, a.root).stale(**target).select("episode_id", "source_uri", "pipeline_version").toLocalIterator()
            found = [print(*r) for r in rows]
            return int(bool(found) and a.exit_code)
        if a.command == "manifest":
            print(json.dumps(load_app(a.pipeline).manifest(), indent=2))
            return 0
        found = [print(r["level"], r["path"], r["code"], r["message"]) or r["level"] for r in findings(spark, a.paths).orderBy("path", "code").toLocalIterator()]
        return int("error" in found)
    except (ValueError, PermissionError, FileExistsError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
