"""Sharding, hard-negative mining and whitening against plain versions, and on odd inputs."""

import collections
import hashlib
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import bpe, common, linededup, mining, mixing, quality, sharding, simhash, whitening

DOCS = "doc_id bigint, text string, source string, size string, place int, id string"
NAN, INF = float("nan"), float("inf")


def plain_places(rows, shards, seed=11):
    """rows: (id, text, source). Places by sorting lists."""
    digits = lambda x, n: int(hashlib.md5(x.encode()).hexdigest()[:n], 16)
    by = collections.defaultdict(list)
    for i, t, s in rows:
        raw = (t or "").encode()
        size, crc = len(raw) + 8, zlib.crc32(raw)
        by[s].append((digits(f"{seed}:{'' if i is None else i}:{size}:{crc}", 15), i is None, i or 0, size, crc))
    out = []
    for s, held in by.items():
        start = digits(str(seed) if s is None else f"{seed}:{s}", 13) / 2**52
        out += [((k + start) / len(held), s is None, (s or "").encode(), k, None if null else i, size, crc) for k, (_, null, i, size, crc) in enumerate(sorted(held))]
    out.sort(key=lambda x: x[:4])
    n = len(out)
    first = {}
    for place in range(n):
        first.setdefault(place * shards // n, place)
    return sorted(((i is None, i or 0, size, crc, place * shards // n, place - first[place * shards // n]) for place, (*_, i, size, crc) in enumerate(out)))


def told(frame):
    return sorted((r["id"] is None, r["id"] or 0, r["size"], r["crc"], r["shard"], r["slot"]) for r in frame.collect())


def narrow(docs):
    return docs.select(*sharding._told("doc_id", "text", "source"))


def odd_docs(spark):
    long = "alpha beta " * 50_000
    rows = [(1, None, None), (2, "", "a"), (3, long, "a"), (None, "x", None), (None, "x", None), (5, "é😀", ""), (6, "tie", "b"), (6, "tie", "b"), (6, "tie", "b"), (7, "tie", "c")]
    rows += [(k, f"text {k % 13}", "hot") for k in range(100, 160)]
    rows += [(9, "again", "hot")] * 40
    return rows, spark.createDataFrame([(*r, "s", 1, "i") for r in rows], DOCS)


@pytest.mark.parametrize("bucket, copies", [(512, 4096), (3, 7), (1, 1)])
def test_places(spark, monkeypatch, bucket, copies):
    monkeypatch.setattr(sharding, "BUCKET", bucket)
    monkeypatch.setattr(sharding, "BLOCK", max(1, bucket // 2))
    monkeypatch.setattr(sharding, "COPIES", copies)
    rows, docs = odd_docs(spark)
    for shards in (1, 7, 24, 500):
        got = sharding.places(narrow(docs), shards=shards)
        assert told(got) == plain_places(rows, shards)


def test_places_keep_the_mixture(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.op11_sharding(spark, "/root/testdata/sf0.01").collect()
    count = collections.Counter(r["shard"] for r in got)
    assert set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    for shard in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(count[shard]))
    each = collections.Counter((r["source"], r["shard"]) for r in got)
    for source, n in docs.groupBy("source").count().collect():
        assert all(abs(each[source, shard] - n / 24) < 2 for shard in range(24))
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_interleave_keeps_rows_and_columns(spark, tmp_path):
    rows, docs = odd_docs(spark)
    got = sharding.interleave(docs, shards=5)
    assert got.columns == [*docs.columns, "placement"]
    held = got.collect()
    key = lambda r: tuple(map(repr, r[:3]))
    assert sorted(map(key, held)) == sorted(map(key, rows))
    assert sorted(r["placement"]["place"] for r in held) == list(range(len(rows)))
    want = collections.Counter((x[0], x[1], x[2], x[4], x[5]) for x in plain_places(rows, 5))
    assert collections.Counter((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 8, r["placement"]["shard"], r["placement"]["slot"]) for r in held) == want
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 5
    with pytest.raises(ValueError):
        sharding.interleave(docs.withColumn("placement", F.lit(1)))
    none = docs.where("doc_id = -1")
    assert sharding.interleave(none).count() == 0 and sharding.places(narrow(none)).count() == 0


def plain_mined(rows, positives=5, negatives=5):
    """rows: (id, label, integers, is anchor), different and of one length."""
    out = []
    for a, label, x, asked in rows:
        if not asked:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, other, y, _ in rows if i != a)
        for s, i, _ in [v for v in scored if v[2] == label][:positives]:
            near = [(n, -t) for t, n, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a, i, k, n, -s, t) for k, (n, t) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [None, 1, 17])
def test_mining(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), [int(v) for v in rng.integers(-3, 9, 4)]) for i in range(120)]  # many ties
    frame = spark.createDataFrame([(i, label, [v / 256 for v in x]) for i, label, x in rows], "vec_id bigint, label int, embedding array<float>")
    got = mining.mine(frame, F.col("vec_id") % 9 == 0, block_rows=block)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain_mined([(*r, r[0] % 9 == 0) for r in rows])


def test_mining_query(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = mining.op12_hard_negatives(spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(mining.ORACLE).fetchall())
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_mining_odd(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.0]), (3, None, [1.0, 0.0]), (4, 2, None), (5, 2, [NAN, 1.0]), (6, 2, [None, 1.0]), (7, 2, [INF, 1.0])]
    rows += [(None, 2, [1.0, 0.0]), (0, 2, [1.0, 0.0]), (8, 2, [1.0, 0.0, 0.0]), (100, 1, []), (101, 1, []), (102, 2, []), (9, 2, [0.9, 7.0]), (200, 3, [5.0, 5.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, label int, embedding array<float>, rank int, lot string")
    got = sorted(tuple(r) for r in mining.mine(frame, F.col("vec_id") % 100 == 0).collect())
    # 0 as label 1: its positive is row 1; as label 2: 2 and 9 are its positives, 1 is other than label 2 but scores above them.
    assert (0, 1, 1, 2, 256 * 256, 230 * 256) in got and (0, 1, 2, 9, 256 * 256, 230 * 256) in got
    assert [r for r in got if r[0] == 100] == [(100, 101, 1, 102, 0, 0)]
    assert not [r for r in got if r[0] == 200 or r[3] in (3, 4, 5, 6, 7, 8)]
    assert mining.mine(frame.where("vec_id = -1"), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        mining.scores(np.array([[2.0**40]]), np.array([[2.0**40]]))
    assert mining.scores(np.array([[2.0**30]]), np.array([[2.0**30 + 1]])).tolist() == [[2**60 + 2**30]]


def test_residues_are_exact():
    moduli = whitening.primes(100)
    assert all(pow(2, p - 1, p) == 1 for p in moduli) and len(set(moduli)) == len(moduli)
    for x in (0, 1, -1, 2**99, -(2**99), 12345678901234567890):
        assert whitening.remaindered([x % p for p in moduli], moduli) == x


def plain_whitening(rows):
    """Exact covariance by Python's fractions; rows: lists of integers."""
    once = [list(x) for x in {tuple(r) for r in rows}]
    n, dim = len(once), len(once[0])
    s = [sum(r[d] for r in once) for d in range(dim)]
    y = [[n * r[d] - s[d] for d in range(dim)] for r in once]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(v)
    return n, s, values[::-1], vectors[:, ::-1], np.trace(v)


def test_whitening(spark, sf):
    got = whitening.op13_whitening(spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    x = {i: [int(np.floor(64 * c)) + 1_000_000 for c in e] for i, e in rows.items()}
    n, s, values, vectors, trace = plain_whitening(x.values())
    held = got.collect()
    assert len(held) == 16 * len(rows)
    own = collections.defaultdict(dict)
    for r in held:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["deviation"] == sum((n * v - t) ** 2 for v, t in zip(x[r["vec_id"]], s))
        assert abs(r["explained"] - values[r["component"] - 1] / trace) < 1e-9
        own[r["component"]][r["vec_id"]] = r["whitened"]
    for k in range(1, 17):
        want = {i: float(np.dot([float(Fraction(n * v - t, n)) for v, t in zip(x[i], s)], vectors[:, k - 1])) / values[k - 1] ** 0.5 for i in x}
        sign = np.sign(own[k][0] * want[0])
        assert max(abs(own[k][i] * sign - want[i]) for i in x) < 1e-7


def test_whitening_far_from_zero(spark):
    """Large entries, whose products doubles can't hold, beside the same entries near zero."""
    rng = np.random.default_rng(3)
    near = rng.integers(-20, 20, (60, 5))
    frames = [spark.createDataFrame([(i, [float(v) / 64 for v in r + at]) for i, r in enumerate(near)], "vec_id bigint, embedding array<double>") for at in (0, 1 << 38)]
    a, b = ([tuple(r) for r in whitening.whiten(f, components=5).orderBy("vec_id", "component").collect()] for f in frames)
    assert len(a) == 300 and all(x[:4] == y[:4] and abs(x[4] - y[4]) < 1e-9 for x, y in zip(a, b))


def test_whitening_odd(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.5, 1.0]), (None, [3.0, -1.0]), (4, None), (5, [None, 1.0]), (6, [NAN, 1.0]), (7, [-INF, 1.0]), (8, []), (9, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, 1, "y") for r in rows], "vec_id bigint, embedding array<float>, n int, x string")
    got = whitening.whiten(frame).collect()
    assert collections.Counter((r["vec_id"], r["component"]) for r in got) == {(1, 1): 1, (1, 2): 1, (2, 1): 2, (2, 2): 2, (3, 1): 1, (3, 2): 1, (None, 1): 1, (None, 2): 1}
    assert {r["n"] for r in got} == {3}  # 9 is alone at its length, so nothing varies there
    wide = whitening.whiten(frame, wide=True).where("vec_id = 1").first()
    assert int(wide["deviation"]) == next(r["deviation"] for r in got if r["vec_id"] == 1)
    none = whitening.whiten(frame.where("vec_id = -1"))
    assert none.count() == 0 and none.columns[0] == "vec_id"
    flat = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    with pytest.raises(Exception, match="exceed"):
        whitening.whiten(spark.createDataFrame([(1, [3e38])], "vec_id bigint, embedding array<float>")).count()


def thue_morse(a, b, n):
    return [a if bin(k).count("1") % 2 == 0 else b for k in range(n)]


def plain_extend(own, other, pairs):
    """Lines of ``own`` that are covered by walking from each pair both ways."""
    covered = set()
    for p, q in pairs:
        i, j = p, q
        while i > 0 and j > 0 and own[i - 1] == other[j - 1]:
            i, j = i - 1, j - 1
        while i < len(own) and j < len(other) and own[i] == other[j]:
            covered.add(i)
            i, j = i + 1, j + 1
    return covered


def test_runs_are_compared_exactly():
    """Orders that sums modulo a power of two take for equal, whatever the base."""
    assert all(pow(7, p - 1, p) == 1 and p < 1 << 31 for p, _ in linededup.MODULI)
    rng = np.random.default_rng(2)
    x, a, b, *rest = (int(v) for v in rng.integers(-(1 << 62), 1 << 62, 3003))
    for n in (1024, 2048):
        own, other = [x, *thue_morse(a, b, n), *rest[:n]], [x, *thue_morse(b, a, n), *rest[n : 2 * n]]
        assert linededup.extend(own, other, [(0, 0)]) == [(0, 1)]
    for _ in range(200):
        own, other = (rng.integers(0, 3, rng.integers(1, 40)).tolist() for _ in range(2))
        pairs = [(i, j) for i in range(len(own)) for j in range(len(other)) if own[i] == other[j]][:6]
        found = linededup.extend(own, other, pairs)
        assert {k for s, e in found for k in range(s, e)} == plain_extend(own, other, pairs)


def test_thue_morse_texts_keep_their_lines(spark):
    """The query's own columns on a planted run of 2,048 lines that repeats nothing but its first three."""
    name = lambda k, n=60: " ".join(f"w{k}_{j}" for j in range(n))
    head = [name(f"h{k}") for k in range(3)]
    a, b = name("a", 3), name("b", 3)
    texts = ["\n".join(head + thue_morse(*pair, 2048)) for pair in ((a, b), (b, a))]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["lines"] for r in linededup.dedup(docs).collect()}
    left = got[2]["text"].split("\n") if got[2]["text"] else []
    earlier, lines = texts[0].split("\n"), texts[1].split("\n")
    # Plain: a line goes if it is in a run of three lines or more that an earlier place has.
    triples = {tuple(earlier[k : k + 3]) for k in range(len(earlier) - 2)}
    cover = set()
    for k in range(len(lines) - 2):
        if tuple(lines[k : k + 3]) in triples or tuple(lines[k : k + 3]) in {tuple(lines[j : j + 3]) for j in range(max(0, k - 400), k)}:
            cover |= {k, k + 1, k + 2}
    assert set(range(3)) <= cover and left == [x for k, x in enumerate(lines) if k not in cover]
    assert got[2]["deleted_words"] == sum(len(lines[k].split()) for k in cover)


CLASHES = ("_lines", "_tag", "_cut_own", "_cut_ranges", "quality_stats", "_both", "_gone_id", "_mix_source", "_mix_copy", "views")


def test_stages_leave_other_columns_alone(spark, sf):
    rows = [(k, " ".join(f"word{k}_{j}" for j in range(80)), "en", "s", 1, *[f"{c}{k}" for c in CLASHES]) for k in range(4)]
    rows += [(9, rows[0][1], "en", "s", 1, *CLASHES), (None, None, None, None, None, *CLASHES), (10, "", "en", "s", 0, *CLASHES)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES))
    for stage in (quality.stage, linededup.stage, simhash.stage, mixing.stage):
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        held = {r["doc_id"]: r for r in got.collect()}
        for k in range(4):
            assert [held[k][c] for c in CLASHES] == [f"{c}{k}" for c in CLASHES] or stage is mixing.stage and k not in held
        assert stage(spark, docs.where("doc_id = -1"), sf).count() == 0
    assert bpe.stage(spark, docs, sf).count() == len(rows) and bpe.stage(spark, docs.where("doc_id = -1"), sf).count() == 0


def test_intermediates_belong_to_their_thread(spark):
    import threading

    since = common.mark()
    mine = common.written(spark.range(3), "mine")

    def other():
        at = common.mark()
        common.written(spark.range(2), "other").count()
        common.release(spark, at)

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert mine.count() == 3
    common.release(spark, since)
    with pytest.raises(Exception):
        mine.count()
