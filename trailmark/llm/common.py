"""Helpers that several corpus operators share.

Texts travel to Python tasks as UTF-8 bytes (Arrow binary): ``bytes.split()``
cuts at exactly the characters ``\\x20\\x09-\\x0D``, which is how every operator
here defines a word.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset on one machine (tests), one made here.

    On a cluster without that setting there is no folder that all machines share, which is
    an error. Also makes ``DataFrame.checkpoint`` usable in a session that names no folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='trailmark-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


class _Written(threading.local):
    """Paths that this thread's operators have written: runs side by side in one driver don't see each other's."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()


def noted(path: str) -> str:
    """Keeps ``path`` in mind for ``release`` in this thread."""
    _written.paths.append(path)
    return path


def unused(frame: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as keep it apart from the columns of ``frame``."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(frame: DataFrame, label: str) -> DataFrame:
    """Writes ``frame`` as Parquet in the shared folder and reads it back.

    Cuts the lineage where a result is used more than once, so that a lost
    executor costs the re-read of a file and not the work before it. The files stay
    until ``release``, as lazy results read them.
    """
    spark = frame.sparkSession
    path = noted(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def mark() -> int:
    """How much this thread has written so far, for ``release``."""
    return len(_written.paths)


def release(spark: SparkSession, since: int, *, keep_last: bool = False) -> None:
    """Deletes what this thread's operators have written since ``mark()``, or all of it but the last: for when a result is stored."""
    paths = _written.paths
    gone = paths[since : len(paths) - keep_last]
    del paths[since : len(paths) - keep_last]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def short_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches have at most ``BATCH_ROWS`` rows and ``BATCH_BYTES``.

    The default of 10,000 rows is meant for numbers. With whole texts it holds tens of
    megabytes several times over, in the JVM and in each Python worker. Spark reads these
    settings when a result is asked for, so they have to stay in the session; lower ones of the
    caller's are kept.
    """
    conf = docs.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(name))
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))
    return docs


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")
