"""Operator 2, stupid-backoff scores of documents under the n-grams of all other documents.

Texts become chunks of about ``CHUNK_WORDS`` words: the hashes of the chunk's words with
their counts, in one array for each hash partition, and the word numbers in their order. For
each longer n-gram in turn every chunk gives its distinct ones likewise (the single words it
has given by then). There the arrays are exploded, the
rows of an n-gram are added up to its entry in the count table, each row gets its
entry, and the totals go back to their chunks: those of n-grams that several chunks have,
as any other n-gram's total is its chunk's own count. At last each word is scored at the
highest order that other documents have, and the scores are summed per document.

An n-gram that other documents have is made of two shorter ones that they have, so only
such n-grams are asked for: nothing is lost, as those left out have no count to give.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import noted, shared_folder, short_batches, text_bytes

ORDER = 3
ALPHA = 0.4
#: Words of a chunk and distinct n-grams of a partition's array: less than 2^21.
CHUNK_WORDS = 1_000_000
PART_WORDS = 1_000_000
BUCKET_BYTES = 8_000_000
#: ``words`` has the bytes of 32-bit numbers: Spark moves them whole, an array it takes apart and puts together value by value.
CHUNKS = "chunk bigint, ids array<bigint>, sizes array<int>, hashes array<array<bigint>>, counts array<array<int>>, words binary"
#: Low bits of a number that holds a place and a total.
TOTAL_BITS = 42
#: Chunks whose totals one task collects at once; beyond, Spark sorts them, which can spill.
COLLECTED = 4096


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in their order, and how many each text has; null has none."""
    # The same bytes: Arrow splits at the characters of a word's definition, whatever the others are.
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    lists = pc.ascii_split_whitespace(texts.view(kind).fill_null(""))
    parts = lists.flatten()
    # Space at the ends of a text leaves empty parts.
    some = pc.not_equal(parts, "")
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return parts.filter(some), np.diff(before[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])])


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys``, which aren't negative, in their order, and the keys in it; equal ones in order of place.

    Where a key and its place fit 64 bits, both are sorted as one number, which takes a fifth of the time.
    """
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()) >> (64 - bits):
        by = np.argsort(keys, kind="stable")
        return by, keys[by]
    both = keys.astype(np.uint64)
    both <<= np.uint64(bits)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    by = (both & np.uint64((1 << bits) - 1)).view(np.int64)
    both >>= np.uint64(bits)
    return by, both.view(np.int64)


def _ordered(keys: np.ndarray) -> np.ndarray:
    """Places of ``keys``, which aren't negative, in their order; equal ones in order of place."""
    return _sorted(keys)[0]


def _often(counts: np.ndarray) -> np.ndarray:
    """Places of ``counts``, the largest first; a chunk numbers its words so, as small numbers compress best."""
    return _ordered(counts.max(initial=0) - counts)


def _ends(grams: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash partition begins among ``grams``, which are in order of their hashes, and where the last one ends."""
    part = (grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)).astype(np.int32)


def _chunked(limit: int, parts: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        ids: list = []
        sizes: list[int] = []
        words: list[pa.Array] = []
        held = 0

        def done() -> pa.RecordBatch:
            coded = pa.concat_arrays(words).dictionary_encode()
            known = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
            hashes = np.fromiter(map(xxh64_intdigest, known), np.uint64, len(known))
            place = coded.indices.to_numpy()
            by = np.argsort(hashes)
            hashes, count = hashes[by], np.bincount(place, minlength=len(by))[by].astype(np.int32)
            number = np.empty(len(by), np.int32)
            number[by[_often(count)]] = np.arange(len(by), dtype=np.int32)
            cut = pa.array(_ends(hashes, parts))
            nested = [pa.ListArray.from_arrays(pa.array([0, parts], pa.int32()), pa.ListArray.from_arrays(cut, pa.array(x))) for x in (hashes.view(np.int64), count)]
            values = [pa.array([at]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), *nested, pa.array([number[place].tobytes()])]
            return pa.RecordBatch.from_arrays(values, names=["chunk", "ids", "sizes", "hashes", "counts", "words"])

        for batch in batches:
            own, counts = _words(batch.column(1))
            begin = end = 0
            for i, count in zip(batch.column(0).to_pylist(), counts.tolist()):
                # A text of more words than a chunk holds is a chunk of its own.
                if held and held + count > limit or len(ids) >= limit:
                    words.append(own.slice(begin, end - begin))
                    yield done()
                    at, ids, sizes, words, held, begin = at + 1, [], [], [], 0, end
                ids.append(i), sizes.append(count)
                held, end = held + count, end + count
            words.append(own.slice(begin))
        if ids:
            yield done()

    return over


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """A chunk's words, and for the orders whose totals are known the counts that other documents have."""

    def __init__(self, row: pa.Table, orders: int, parts: tuple[int, int]):
        flat = lambda name: row[name].combine_chunks().flatten()
        self.number, self.sizes = row["chunk"][0].as_py(), flat("sizes").to_numpy().astype(np.int64)
        self.ids = row["ids"][0].as_py()
        self.hashes, self.counts = flat("hashes").flatten().to_numpy().view(np.uint64), flat("counts").flatten().to_numpy()
        # Words are told by the places of their hashes.
        self.words = _often(self.counts)[np.frombuffer(row["words"][0].as_buffer(), np.int32)]
        self.word = self.hashes[self.words]
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.gram = np.zeros(0, np.uint64)
        self.order, self.parts = 0, parts
        self.others: list[np.ndarray] = []  # by order: for the n-gram that ends at each word
        for n in range(1, orders + 1):
            self.next()
            self.learn(row[f"totals_{n}"].combine_chunks().flatten())

    def whole(self, n: int) -> np.ndarray:
        """Whether the n-gram that ends at each word begins in the same document."""
        out = np.zeros(len(self.doc), bool)
        out[n - 1 :] = self.doc[n - 1 :] == self.doc[: max(0, len(self.doc) - n + 1)]
        return out

    def next(self) -> None:
        """Goes to the next order: its distinct n-grams of which other documents have the parts."""
        self.order += 1
        n = self.order
        if n == 1 or not len(self.word):
            self.gram, at, key = self.word, None, self.words
        else:
            self.gram = _mixed(self.gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.word[n - 1 :])
            seen = self.others[-1] > 0
            at = np.nonzero(self.whole(n)[n - 1 :] & seen[n - 1 :] & seen[n - 2 : -1])[0] + (n - 1)
            # Inside the chunk an n-gram is told by the numbers of the one before and of its word.
            key = (self.numbers[at - 1] << len(self.word).bit_length()) | self.words[at]
        by, key = _sorted(key)  # then by place, and so by document
        self.at = by if at is None else at[by]
        del at, by
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        own = first.copy()
        doc = self.doc[self.at]
        own[1:] |= doc[1:] != doc[:-1]
        runs = lambda starts: np.diff(np.append(np.nonzero(starts)[0], len(key)))
        mine = runs(own)
        self.own = np.repeat(mine.astype(np.int32), mine)
        if n == 1:
            self.distinct, self.count, self.place, self.numbers = self.hashes, self.counts, key, self.words
            return
        count = runs(first)
        # In order of all bits that can tell a partition.
        grams = self.gram[self.at[first] - (n - 1)]
        by = _ordered(grams >> np.uint64(len(grams).bit_length()))
        self.distinct, self.count = grams[by], count[by]
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        self.place = np.repeat(place, count)
        self.numbers = np.zeros(len(self.word), np.int64)
        self.numbers[self.at] = self.place

    def ends(self) -> np.ndarray:
        """Where each hash partition begins among this order's distinct n-grams, and where the last one ends."""
        return _ends(self.distinct, self.parts[self.order > 1])

    def learn(self, found: pa.StructArray) -> None:
        """Takes the totals of this order's distinct n-grams: those found, and the chunk's counts of the rest."""
        totals = self.count.astype(np.int64)
        if len(found):
            part, lists = found.field("part").to_numpy(), found.field("t")
            both = lists.flatten().to_numpy().view(np.uint64)
            begin = np.repeat(self.ends()[part], lists.value_lengths().to_numpy())
            totals[begin + (both >> np.uint64(TOTAL_BITS)).astype(np.int64)] = both & np.uint64((1 << TOTAL_BITS) - 1)
        other = np.zeros(len(self.word), np.int64)
        other[self.at] = totals[self.place] - self.own
        self.others.append(other)

    def scores(self, alpha: float, total: int) -> np.ndarray:
        """Log score of each document."""
        rest = np.maximum(total - self.sizes, 1)[self.doc]
        score = np.log(np.maximum(self.others[0], 1) / rest)
        for n in range(1, len(self.others)):
            context = np.concatenate([[1], self.others[n - 1][:-1]]) if len(score) else score
            here = np.log(np.maximum(self.others[n], 1) / np.maximum(context, 1))
            # A word with fewer than n words before it has no such n-gram to back off from.
            score = np.where(self.others[n] > 0, here, score + np.where(self.whole(n + 1), np.log(alpha), 0.0))
        return np.bincount(self.doc, score, len(self.sizes))


def _asked(order: int, parts: tuple[int, int]):
    def over(row: pa.Table) -> pa.Table:
        chunk = Chunk(row, order - 1, parts)
        chunk.next()
        ends = chunk.ends()
        some = np.nonzero(np.diff(ends))[0]
        cut = pa.array(np.append(ends[some], ends[-1:]), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (chunk.distinct.view(np.int64), chunk.count.astype(np.int32))]
        number = pa.array(np.full(len(some), chunk.number), pa.int64())
        return pa.table([pa.array(some, pa.int32()), number, *lists], names=["part", "chunk", "grams", "counts"])

    return over


def _scored(order: int, alpha: float, total: int, parts: tuple[int, int]):
    def over(row: pa.Table) -> pa.Table:
        chunk = Chunk(row, order, parts)
        columns = [pa.array(chunk.ids, pa.int64()), pa.array(chunk.sizes), pa.array(chunk.scores(alpha, total), pa.float64())]
        return pa.table(columns, names=["id", "n_words", "log_score"])

    return over


@contextmanager
def _collecting(spark: SparkSession) -> Iterator[None]:
    """Lets what is written meanwhile collect up to ``COLLECTED`` groups a task without a sort."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, COLLECTED)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bucketed(frame: DataFrame, label: str, buckets: int) -> DataFrame:
    """Writes rows in buckets by chunk in the shared folder: their later joins need no shuffle.

    The catalog's entry is dropped at once; the files stay, and the frame reads them.
    """
    spark = frame.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = noted(f"{shared_folder(spark)}/{name}")
    frame.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    # What is written needs its shuffles no more. Spark deletes their files once the driver's
    # collector finds that nothing refers to them, which it may not look for until much later.
    spark._jvm.System.gc()
    return out


def totals(asked: DataFrame, parts: int, order: int) -> DataFrame:
    """``(chunk, totals_n)``: for n-grams of ``asked(part, chunk, grams, counts)`` in several chunks, their place and count in all.

    Partitions are of n-grams by hash, so after the one shuffle by ``part`` all rows of
    an n-gram are together: a chunk has one at most, however common it is. A window puts an
    n-gram's entry of the partition's count table beside each of its rows: the same as a join
    of the rows with their sums, by one sort, which can spill, of rows that are exploded once.
    """
    dealt = asked.repartitionById(parts, "part")
    # The counts are read by place: zipped with the n-grams, each pair would be an object.
    rows = dealt.select("part", "chunk", "counts", F.posexplode("grams").alias("pos", "gram"))
    rows = rows.select("part", "chunk", "pos", "gram", F.col("counts")[F.col("pos")].alias("n"))
    # The n-gram first: by it rows are told apart in the sort, while ``part`` is one in a task.
    joined = rows.withColumn("total", F.sum("n").over(Window.partitionBy("gram", "part"))).where("total > n")
    both = F.shiftleft(F.col("pos").cast("long"), TOTAL_BITS).bitwiseOR(F.col("total"))
    back = joined.select("part", "chunk", both.alias("both")).groupBy("part", "chunk").agg(F.collect_list("both").alias("t"))
    return back.groupBy("chunk").agg(F.collect_list(F.struct("part", "t")).alias(f"totals_{order}"))


def score(docs: DataFrame, *, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``(id, n_words, log_score, mean_score)`` for each row of ``docs``.

    The score of a word is count(n-gram) / count(n-gram without the word) at the highest
    order, up to ``order``, that has a count, times ``alpha`` for each order given up;
    the last resort is its share of all words, where a word that no other document has counts
    as one. Counts are over all rows but the document itself: what it says is no
    evidence for it. N-grams are told apart by 64-bit hashes at every size.

    A null text counts as empty: no words, log score 0, mean null; so does one of space alone.
    Texts of any length are read whole. Rows that repeat an id or a text are documents of
    their own, and each is evidence for the other; equal texts get equal scores. An empty
    table gives an empty result. Ids are integers; other columns are left out.
    """
    read = short_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), text_bytes(text_col).alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    chunks = _bucketed(read.mapInArrow(_chunked(chunk_words, buckets), CHUNKS), "chunks", buckets)
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    #: Hash partitions of words, and of longer n-grams, of which a chunk has more.
    parts = buckets, max(1, -(-total // PART_WORDS))
    known = chunks
    for n in range(1, order + 1):
        if n == 1:
            asked = chunks.select("chunk", "counts", F.posexplode("hashes").alias("part", "grams")).withColumn("counts", F.col("counts")[F.col("part")])
        else:
            asked = known.groupBy("chunk").applyInArrow(_asked(n, parts), "part int, chunk bigint, grams array<bigint>, counts array<int>")
        with _collecting(docs.sparkSession):
            found = _bucketed(totals(asked, parts[n > 1], n), f"totals_{n}", buckets)
        known = known.join(found.hint("merge"), "chunk", "left")
    scored = known.groupBy("chunk").applyInArrow(_scored(order, alpha, total, parts), "id bigint, n_words bigint, log_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score", (F.col("log_score") / F.nullif("n_words", F.lit(0))).alias("mean_score"))


def op2_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the trigrams of all others, rounded to 6 digits."""
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_score", 6).alias("mean_score"))


ORACLE = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS c, generate_subscripts(ws, 1) AS p FROM rows),
g AS (SELECT r, p, c, lag(c, 1) OVER (PARTITION BY r ORDER BY p) AS b, lag(c, 2) OVER (PARTITION BY r ORDER BY p) AS a FROM w),
o1 AS (SELECT r, c, count(*) AS k FROM g GROUP BY r, c),
o2 AS (SELECT r, b, c, count(*) AS k FROM g WHERE b IS NOT NULL GROUP BY r, b, c),
o3 AS (SELECT r, a, b, c, count(*) AS k FROM g WHERE a IS NOT NULL GROUP BY r, a, b, c),
n1 AS (SELECT r, c, sum(k) OVER (PARTITION BY c) - k AS k FROM o1),
n2 AS (SELECT r, b, c, sum(k) OVER (PARTITION BY b, c) - k AS k FROM o2),
n3 AS (SELECT r, a, b, c, sum(k) OVER (PARTITION BY a, b, c) - k AS k FROM o3),
t AS (SELECT r, greatest(count(*) OVER () - count(*) OVER (PARTITION BY r), 1) AS n, p FROM g),
s AS (
  SELECT g.r,
    CASE WHEN n3.k > 0 THEN ln(n3.k / x2.k::DOUBLE)
         ELSE CASE WHEN g.a IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END
              + CASE WHEN n2.k > 0 THEN ln(n2.k / x1.k::DOUBLE)
                     ELSE CASE WHEN g.b IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END + ln(greatest(n1.k, 1) / t.n::DOUBLE) END END AS v
  FROM g JOIN t USING (r, p) JOIN n1 ON n1.r = g.r AND n1.c = g.c
  LEFT JOIN n2 ON n2.r = g.r AND n2.b = g.b AND n2.c = g.c LEFT JOIN n1 x1 ON x1.r = g.r AND x1.c = g.b
  LEFT JOIN n3 ON n3.r = g.r AND n3.a = g.a AND n3.b = g.b AND n3.c = g.c LEFT JOIN n2 x2 ON x2.r = g.r AND x2.b = g.a AND x2.c = g.b
), d AS (SELECT r, sum(v) AS v FROM s GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(v, 0.0::DOUBLE), 6) AS log_score, round(v / len(ws), 6) AS mean_score
FROM rows LEFT JOIN d USING (r)
"""
