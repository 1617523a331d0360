"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trailmark.llm import ann, backoff, bpe, licences, linededup, mixing, quality, secrets, simhash, wordpiece

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, fp string, key string, lines string, ids string, score string, n int"
LONG = "alpha beta gamma delta " * 30_000
LINES = "\n".join(f"line {i} " + "word " * 60 for i in range(4))
TEXTS = [None, "", "   \n\t ", "one", LONG, LINES, LINES, "É ▁ 😀 \x00 ﬁ", LINES, None, "tie", "tie"]


@pytest.fixture(scope="module")
def odd(spark):
    ids = [1, 2, 3, 4, 5, 6, 7, 8, None, None, 11, 11]
    rows = [(i, t, None, None if k % 3 == 0 else "s", None, 1, "f", "k", "l", "i", "s", 2) for k, (i, t) in enumerate(zip(ids, TEXTS))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def test_quality(spark, odd, none):
    model = quality.train(odd, labels(spark, [(4, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)]))
    got = {r["doc_id"]: r["quality_stats"] for r in quality.score(odd, model).where("doc_id is not null").collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[5]["n_repeat_words"] == got[5]["n_words"] == 120_000 and got[5]["base_failed"]
    assert got[6]["n_words"] == 4 * 62 and got[6]["n_dup_lines"] == 0
    assert quality.train(none, labels(spark)) is None
    assert quality.train(odd, labels(spark, [(4, 1, 0), (5, 1, 0)])) is None
    assert quality.score(odd, None).count() == odd.count()
    assert quality.score(none, model).count() == 0


def test_backoff(odd, none):
    got = backoff.score(odd).collect()
    assert len(got) == len(TEXTS)
    assert {r["mean_score"] for r in got if r["doc_id"] in (1, 2, 3)} == {None}
    assert [r["n_words"] for r in got if r["doc_id"] == 5] == [120_000]
    assert len({r["log_score"] for r in got if r["doc_id"] == 11}) == 1
    lone = backoff.score(odd.where("doc_id = 4")).first()
    assert (lone["n_words"], lone["log_score"]) == (1, 0.0)
    assert backoff.score(none).count() == 0


def test_sentencepiece(odd, none):
    got = {r["doc_id"]: r for r in bpe.digests(odd).where("doc_id is not null").collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 1 and got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[5]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.decode(bpe.encode(odd)).where("doc_id = 8").first()["decoded"] == TEXTS[7].replace("▁", " ")
    assert bpe.digests(none).count() == 0


def test_licences(odd, none):
    got = licences.scan(odd)
    assert got.count() == len(TEXTS) and got.where("licence is not null or size(notices) > 0 or notices is null").count() == 0
    assert licences.scan(none).count() == 0


def test_token_counts(odd, none):
    got = {r["doc_id"]: r for r in wordpiece.token_counts(odd).where("doc_id is not null").collect()}
    assert got[1]["n_words"] == got[1]["n_tokens"] == got[2]["n_tokens"] == 0
    assert got[5]["n_words"] == 120_000 and got[5]["n_tokens"] >= 120_000
    assert wordpiece.token_counts(none).count() == 0


def test_simhash(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["fingerprint"] == "0" * 16 and {by[k]["component_id"] for k in (1, 2, 3)} == {1}
    assert by[7]["component_id"] == 6 and by[11]["component_id"] == 11
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [6, 1] or {r["component_id"] for r in got if r["doc_id"] is None} == {1, 6}
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(none, size=5, similarity=0.8).count() == 0
    left = simhash.stage(odd.sparkSession, odd, "")
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 4, 5, 6, 8, 11]


def test_simhash_decides_per_row(spark):
    text = lambda k: " ".join(f"w{k}_{j}" for j in range(100))
    near = text(1).replace("w1_50 ", "other ")
    alone = text(6).replace("w6_50 ", "other ")
    rows = [(1, text(1)), (None, text(1)), (None, near), (None, text(2)), (3, text(3)), (3, text(4)), (2, text(4)), (5, text(5)), (5, text(5)), (None, text(6)), (None, alone)]
    got = simhash.stage(spark, spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got if r["text"] not in (text(6), alone)) == sorted([(1, text(1)), (0, text(2)), (3, text(3)), (2, text(4)), (5, text(5))])
    assert len([r for r in got if r["text"] in (text(6), alone)]) == 1


def test_mixing(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(TEXTS) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert all(r["size"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert mixing.mix(none).count() == 0 and mixing.repeat(none).count() == 0
    repeated = mixing.repeat(odd)
    assert repeated.columns == odd.columns
    assert repeated.groupBy("doc_id").count().where("doc_id is not null and doc_id != 11 and count > 2").count() == 0
    blank = odd.where("doc_id <= 3")
    assert {(r["target"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_line_dedup(odd, none):
    got = linededup.dedup(odd)
    assert got.count() == len(TEXTS)
    by = {r["doc_id"]: r["lines"] for r in got.where("doc_id is not null and doc_id != 11").collect()}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[3]["text"] == TEXTS[2]
    assert by[6]["n_deleted"] == 0 and by[7]["n_deleted"] == by[7]["n_lines"] == 4
    assert by[5]["text"] == LONG
    assert [r["lines"]["n_deleted"] for r in got.where("doc_id = 11").collect()] == [0, 0]
    assert sorted(r["lines"]["n_deleted"] for r in got.where("doc_id is null").collect()) == [0, 4]
    assert linededup.dedup(none).count() == 0
    assert linededup.stage(odd.sparkSession, odd, "").columns == odd.columns


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1)]
    rows += [(5, [None, 1.0], 1), (6, [], 1), (7, [1.0, 0.0, 0.0], 1), (8, [2.0, 0.0], 1), (None, [3.0, 0.0], 1), (40, [0.0, 0.0], 1), (9, [1.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    graphs, shards = ann.index(vectors)
    got = ann.search(graphs, shards, vectors.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (0, 1, 8, 2.0), (0, 2, 9, 1.0), (0, 3, 20, 1.0), (20, 1, 8, 2.0), (20, 2, 0, 1.0), (20, 3, 9, 1.0),
    ]
    empty = vectors.where("vec_id = -1")
    graphs, shards = ann.index(empty)
    assert ann.search(graphs, shards, empty).count() == 0


def test_secrets(spark, odd, none):
    model = secrets.train(secrets.labelled_samples(spark))
    got = secrets.scan(odd, model)
    assert got.count() == len(TEXTS)
    assert got.where(F.size("secrets.base") + F.size("secrets.added") > 0).count() == 0
    assert secrets.scan(none, model).count() == 0
