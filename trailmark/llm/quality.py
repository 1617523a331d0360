"""Operator 1, quality rules: document statistics, base rules and boosted trees.

The trees are fitted on a bounded, deterministic sample of the labelled
documents (``max_train``), flattened into numpy arrays and applied to every
document. The model falls with the share of symbols, repeated lines and repeated
words, whatever the sample says (monotonic constraints).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .common import short_batches, text_bytes, unused

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words",
    "mean_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "digit_share",
    "punctuation_share",
    "distinct_share",
    "top_word_share",
    "mean_line",
    "bang_share",
    "lower_start_share",
]
#: The score never rises with these.
MONOTONE = {FEATURES.index(x): -1 for x in ("symbol_share", "dup_line_share", "repeat_share", "top_word_share", "bang_share")}
MAX_TRAIN = 8192
KEEP_AT = 0.5


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """``COUNTS`` and ``FEATURES`` of one whole text (UTF-8)."""
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text, np.uint8)
    spaces = int(np.count_nonzero((raw == 32) | ((raw >= 9) & (raw <= 13))))
    chars = int(np.count_nonzero((raw & 0xC0) != 0x80)) - spaces
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    repeat = 0
    if n >= 3:
        v = len(ids)
        pair = np.unique(seq[:-1] * v + seq[1:], return_inverse=True)[1].reshape(-1)[:-1]
        _, inverse, times = np.unique(pair * v + seq[2:], return_inverse=True, return_counts=True)
        again = times[inverse.reshape(-1)] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeat = int(covered.sum())
    some, letters = max(n, 1), max(chars, 1)
    top = int(np.bincount(seq).max()) if n else 0
    features = [
        float(np.log1p(n)),
        chars / some,
        symbols / letters,
        dup_lines / max(len(lines), 1),
        repeat / some,
        int(np.count_nonzero((raw >= 65) & (raw <= 90))) / letters,
        int(np.count_nonzero((raw >= 48) & (raw <= 57))) / letters,
        (text.count(b".") + text.count(b",")) / some,
        len(ids) / some,
        top / some,
        n / max(len(lines), 1),
        text.count(b"!") / some,
        sum(97 <= w[0] <= 122 for w in words) / some,
    ]
    return [n, chars, symbols, dup_lines, repeat], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _scored(model: Forest | None, keep_at: float):
    kind = pa.struct([(x, pa.int64()) for x in COUNTS] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def over(texts: pa.Array) -> pa.Array:
        found = [statistics(x if x is not None else b"") for x in texts.to_pylist()]
        counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
        failed = np.array([base_failed(c[0], c[4]) for c, _ in found], bool)
        if model is None:
            score = np.full(len(found), np.nan)
            good = np.ones(len(found), bool)
        else:
            score = 1 / (1 + np.exp(-model.margin(np.array([f for _, f in found]).reshape(-1, len(FEATURES)))))
            good = score >= keep_at
        columns = [pa.array(counts[:, k]) for k in range(len(COUNTS))]
        columns += [pa.array(failed), pa.array(good & ~failed), pa.array(score, from_pandas=True)]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    ddl = "struct<" + ",".join(f"{x}:bigint" for x in COUNTS) + ",base_failed:boolean,kept:boolean,score:double>"
    return F.arrow_udf(over, ddl)


def _features(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(x if x is not None else b"")[1] for x in texts.to_pylist()], pa.list_(pa.float64()))


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest | None:
    """Fits the trees on at most ``max_train`` labelled documents.

    The sample is the labelled ids with the smallest hashes, so it is the same on
    every run; its size is the only bound on what reaches the driver. Rows with a
    null id or label are not used; without two classes there is no model.
    """
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_train)
    )
    # At most max_train rows of two numbers: the broadcast has a fixed bound.
    sample = short_batches(docs).select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    rows = sample.select("_id", "_y", F.arrow_udf(_features, "array<double>")("_text").alias("_x")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_train).collect()
    if not rows:
        return None
    order = sorted(rows, key=lambda r: (r["_id"], r["_x"]))
    return fit(np.array([r["_x"] for r in order]), np.array([r["_y"] for r in order]), MONOTONE)


def score(docs: DataFrame, model: Forest | None, *, keep_at: float = KEEP_AT, text_col: str = "text", out: str = "quality_stats") -> DataFrame:
    """Adds a struct of the counts, ``base_failed``, ``kept`` and ``score`` to each row.

    A null text counts as empty (no words: it fails the base). Without a model
    every document that passes the base is kept and its score is null. Texts of any length
    are read whole; repeated rows get equal results; a score of just ``keep_at`` is kept; an
    empty table gives an empty result. A column named ``out`` is replaced; all others stay.
    """
    return short_batches(docs).withColumn(out, _scored(model, keep_at)(text_bytes(text_col)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document: fails the base under 50 words or with over half in repeated windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", "quality_stats.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops the documents that the rules or the trees reject.

    Null and empty texts fail the rules; texts of any length are judged whole, repeated rows
    alike. All columns stay as they are, whatever their names; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = unused(docs, "quality_stats")
    return score(docs, train(docs, labels), out=out).where(F.col(f"{out}.kept")).drop(out)
