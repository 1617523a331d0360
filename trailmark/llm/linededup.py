"""Operator 8, line dedup by winnowing over line hashes.

A document is the sequence of its lines that have a word. Hashes of every
``GRAM`` lines in a row go through windows of ``WINDOW``, whose minima (the rightmost
of equal ones) are the document's fingerprints; so is each gram whose lines have
``LONG`` words or more in all, and a line of ``LONG`` words or more by itself. Two runs
of ``GRAM + WINDOW - 1`` equal lines always share a fingerprint. Each later occurrence
of a fingerprint is joined to its first one, by document id and position; from there the
match is extended both ways, and the later run is deleted. The grams that cross the ends
of a deleted run are looked up among all grams, as a run can go on in another document
than the one that has its fingerprint first.

So every line of a repeated run of three lines goes, of two lines of 50 words in all,
and a repeated line of 50 words. Lone short lines stay: they are as often "Yes." as
boilerplate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import short_batches, text_bytes, unused, written

GRAM = 2
WINDOW = 2
LONG = 50
SEED = 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hashes(text: bytes, long: int = LONG, gram: int = GRAM) -> tuple[list[int], list[int], list[int]]:
    """Hash of each line with a word, and the places of the long ones and of the long grams among them."""
    lines = [x for line in text.split(b"\n") if (x := line.strip())]
    hashes = [_signed(xxh64_intdigest(x, SEED)) for x in lines]
    # n words take 2n - 1 bytes at least, so few lines are split.
    places = [k for k, x in enumerate(lines) if len(x) >= 2 * long - 1 and len(x.split()) >= long]
    sizes = [len(x) for x in lines]
    wide = [k for k in range(len(lines) - gram + 1) if sum(sizes[k : k + gram]) >= 2 * long - gram and sum(len(x.split()) for x in lines[k : k + gram]) >= long]
    return hashes, places, wide


def winnow(hashes: list[int], places: list[int], gram: int = GRAM, window: int = WINDOW, wide: list[int] | None = None) -> list[tuple[int, int]]:
    """``(key, position)`` of each fingerprint, in order of position.

    ``places`` of lines and ``wide`` places of grams are fingerprints in any case.
    """
    raw = np.array(hashes, np.int64).astype(">i8").tobytes()
    grams = [_signed(xxh64_intdigest(raw[8 * k : 8 * (k + gram)], SEED)) for k in range(len(hashes) - gram + 1)]
    found = {(_signed(xxh64_intdigest(raw[8 * k : 8 * k + 8], SEED + 1)), k) for k in places}
    found.update((grams[k], k) for k in wide or ())
    width = min(window, len(grams))
    for at in range(len(grams) - width + 1 if grams else 0):
        part = grams[at : at + width]
        least = min(part)
        found.add((least, at + max(k for k, x in enumerate(part) if x == least)))
    return sorted(found, key=lambda x: (x[1], x[0]))


#: (prime, base): runs count as equal where their sums agree modulo all three, of 93 bits in all.
#: Sums modulo a power of two won't do: for any base they agree on Thue-Morse orders of two lines.
MODULI = ((2147483647, 1103515245), (2147483629, 1812433253), (2147483587, 1566083941))


def _rolled(hashes: np.ndarray, length: int, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the sum of the hashes before it, each times a power of ``base``; and ``length`` such powers."""
    p = np.uint64(prime)
    powers = np.ones(length, np.uint64)
    done = 1
    while done < length:
        step = min(done, length - done)
        powers[done : done + step] = powers[:step] * np.uint64(pow(base, done, prime)) % p
        done += step
    sums = np.zeros(len(hashes) + 1, np.uint64)
    # Terms are below 2^31, so the sums of 2^32 lines fit.
    np.add.accumulate(hashes.view(np.uint64) % p * powers[: len(hashes)] % p, out=sums[1:])
    return sums % p, powers


def extend(own: list[int], other: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges ``[start, end)`` of ``own`` that repeat ``other`` around each pair of places, put together.

    Both may be one document: the place in ``other`` comes first in each pair, so
    the first line of a run that repeats itself is never in a range. All pairs are
    extended at once by halving, on sums that tell runs of hashes apart: a text of many equal
    lines has a diagonal for each of them, and walking along each would take their square.
    """
    if not pairs:
        return []
    a, b = np.array(own, np.int64), np.array(other, np.int64)
    length = max(len(a), len(b)) + 1
    rolled = [(np.uint64(prime), *(x for h in (a, b) for x in _rolled(h, length, prime, base))) for prime, base in MODULI]
    p, q = np.array(sorted(set(pairs)), np.int64).T

    def equal(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether ``n`` lines from ``i`` of own and from ``j`` of other are the same."""
        right, left = np.maximum(j - i, 0), np.maximum(i - j, 0)
        same = np.ones(len(n), bool)
        for prime, one, powers, two, _ in rolled:
            x, y = (one[i + n] + prime - one[i]) % prime, (two[j + n] + prime - two[j]) % prime
            same &= x * powers[right] % prime == y * powers[left] % prime
        return same

    def longest(most: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros_like(most), most
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = same(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    before = longest(np.minimum(p, q), lambda n: equal(p - n, q - n, n))
    behind = longest(np.minimum(len(a) - p, len(b) - q), lambda n: equal(p, q, n))
    ranges: list[tuple[int, int]] = []
    for start, end in sorted(set(zip((p - before).tolist(), (p + behind).tolist()))):
        if start == end:
            continue
        if ranges and start < ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
        else:
            ranges.append((start, end))
    return ranges


def _lines(long: int, gram: int, window: int):
    def over(texts: pa.Array) -> pa.Array:
        hashes, prints = [], []
        for text in texts.to_pylist():
            own, places, wide = line_hashes(text or b"", long, gram)
            hashes.append(own)
            prints.append([{"key": k, "at": p} for k, p in winnow(own, places, gram, window, wide)])
        kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(hashes, pa.list_(pa.int64())), pa.array(prints, kind)], names=["hashes", "prints"])

    # Held to be indeterminate, so that a filter on its result doesn't hash every text a second time.
    return F.arrow_udf(over, "struct<hashes:array<bigint>,prints:array<struct<key:bigint,at:int>>>").asNondeterministic()


def _ranges(own: pa.Array, other: pa.Array, pairs: pa.Array) -> pa.Array:
    out = []
    for a, b, p in zip(own.to_pylist(), other.to_pylist(), pairs.to_pylist()):
        found = extend(a, b, [(x["at"], x["first"]) for x in p])
        out.append([{"start": x, "end": y} for x, y in found])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def _crossing(single: DataFrame, ranged: DataFrame, gram: int) -> DataFrame:
    """``(who, r)``: grams over an end of a range in ``ranged(who, ends)`` that came earlier anywhere."""
    ends = ranged.select("who", F.inline("ends"))
    every = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda k: k + gram <= F.size("hashes"))
    grams = single.where("size(hashes) > 0").select("who", "hashes", F.explode(every).alias("at")).select("who", "at", _gram(F.col("at"), gram).alias("key"))
    # First by key, which tasks do before they deal: common grams then don't meet in one task. Written,
    # so that the next join is one of plain sides, and Spark can split the rows of a common end.
    asked = ends.select(F.col("key").alias("asked")).distinct()
    firsts = grams.groupBy("key").agg(F.min(F.struct("who", "at")).alias("f")).join(asked, F.col("key") == F.col("asked")).select("key", "f")
    firsts = written(firsts, "end_firsts").hint("merge")
    later = ends.join(firsts, "key").where("not (f.who <=> who and f.at = at)")
    return later.groupBy("who").agg(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + gram).alias("end"))).alias("r"))


def _gram(at: Column, gram: int) -> Column:
    return F.xxhash64(F.slice("hashes", at + 1, gram))


def _ends(gram: int, window: int) -> Column:
    """``(at, key)`` of the grams over the ends of the ranges ``r``.

    Of a run of ``gram + window - 1`` lines, at most ``window - 1`` grams at either end
    have no fingerprint.
    """
    steps = F.array(*[F.lit(k) for k in range(1, window)]).cast("array<int>")
    around = F.transform("r", lambda r: F.concat(F.transform(steps, lambda k: r["start"] - k), F.transform(steps, lambda k: r["end"] - gram + k)))
    inside = F.filter(F.array_distinct(F.flatten(around)), lambda at: (at >= 0) & (at + gram <= F.size("hashes")))
    return F.transform(inside, lambda at: F.struct(at.alias("at"), _gram(at, gram).alias("key")))


def _cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """Text without the lines in the ranges, number of lines, deleted lines, deleted words."""
    rows = []
    for text, cut in zip(texts.to_pylist(), ranges.to_pylist()):
        lines = (text or b"").split(b"\n")
        worded = [bool(x.strip()) for x in lines]
        # Places where ranges begin and end, summed up: in any, however they overlap.
        steps = np.zeros(sum(worded) + 1, np.int64)
        for r in cut or []:
            steps[r["start"]] += 1
            steps[r["end"]] -= 1
        drop = set(np.nonzero(np.cumsum(steps) > 0)[0].tolist())
        kept, at, words = [], 0, 0
        for line, some in zip(lines, worded):
            if some and at in drop:
                words += len(line.split())
            else:
                kept.append(line)
            at += some
        rows.append((None if text is None else b"\n".join(kept).decode() if drop else text.decode(), sum(worded), len(drop), words))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["text", "n_lines", "n_deleted", "deleted_words"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out: str = "lines", long: int = LONG, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds a struct: the text that is left, its former lines, deleted lines and deleted words.

    "Earlier" is by id (nulls last), then by the text's hash, then by position. Rows
    with the same id and text are one document: none of them loses a line to another.
    A null text stays null and an empty one empty, with no lines; a text of any number of
    lines is read whole, equal lines in a row are a run that repeats itself. An empty table gives an
    empty result. A column named ``out`` is replaced; all others stay as they are.
    """
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # Nulls of the id last: the smallest struct is then the first occurrence.
    who = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), tag.alias("tag"))
    read = short_batches(docs).select(who.alias("who"), text_bytes(text_col).alias("_text")).where("_text is not null")
    lines = written(read.select("who", _lines(long, gram, window)("_text").alias("l")).select("who", "l.*").where("size(prints) > 0"), "lines")
    prints = lines.select("who", F.inline("prints"))
    firsts = prints.groupBy("key").agg(F.min(F.struct("who", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").select("key", "f")
    # Written for the same reason as below: very many documents may share a fingerprint.
    firsts = written(firsts, "firsts").hint("merge")
    later = prints.join(firsts, "key").where("not (f.who <=> who and f.at = at)")
    pairs = later.groupBy("who", F.col("f.who").alias("other")).agg(F.collect_set(F.struct("at", F.col("f.at").alias("first"))).alias("pairs"))
    # Written, so that both sides of the next join are plain shuffles: where one document
    # is the first to have what very many repeat, Spark then splits its rows.
    single = written(lines.select("who", "hashes").dropDuplicates(["who"]), "single")
    matched = pairs.join(single.select(F.col("who").alias("other"), F.col("hashes").alias("theirs")), "other").join(single, "who")
    ranged = matched.select("who", "hashes", F.arrow_udf(_ranges, "array<struct<start:int,end:int>>")("hashes", "theirs", "pairs").alias("r"))
    ranged = written(ranged.select("who", "r", _ends(gram, window).alias("ends")), "ranged")
    ranged = ranged.select("who", "r").unionByName(_crossing(single, ranged, gram))
    cuts = written(ranged.groupBy("who").agg(F.flatten(F.collect_list("r")).alias("ranges")), "cuts")
    own, cut_id, cut_tag, cut_ranges = (unused(docs, c) for c in ("_cut_own", "_cut_id", "_cut_tag", "_cut_ranges"))
    cuts = cuts.select(F.col("who.id").alias(cut_id), F.col("who.tag").alias(cut_tag), F.col("ranges").alias(cut_ranges))
    # The cuts grow with the corpus: a merge join at every size, never a broadcast.
    cuts = cuts.hint("merge")
    tagged = docs.withColumn(own, tag)
    joined = tagged.join(cuts, F.col(id_col).eqNullSafe(F.col(cut_id)) & (F.col(own) == F.col(cut_tag)), "left")
    kind = "struct<text:string,n_lines:bigint,n_deleted:bigint,deleted_words:bigint>"
    # Likewise.
    cut = F.arrow_udf(_cut, kind).asNondeterministic()
    return joined.withColumn(out, cut(text_bytes(text_col), cut_ranges)).drop(own, cut_id, cut_tag, cut_ranges)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines deleted from every document, and the digest of the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = dedup(docs)
    return left.select("doc_id", "lines.n_lines", "lines.n_deleted", "lines.deleted_words", F.sha2(F.coalesce(F.col("lines.text"), F.lit("")), 256).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without later repeated runs.

    A document all of whose lines went is a repeat as a whole and goes too. Null and empty
    texts stay, equal ones of other ids go; rows with the same id and text are one document
    and all stay. Columns beside text and n_chars stay as they are, whatever their names; an
    empty table stays empty.
    """
    out = unused(docs, "_lines")
    left = dedup(docs, out=out)
    left = left.where(~((F.col(f"{out}.n_deleted") > 0) & (F.col(f"{out}.n_deleted") == F.col(f"{out}.n_lines"))))
    columns = {"text": F.col(f"{out}.text"), "n_chars": F.length(F.col(f"{out}.text")).cast("long")}
    return left.select(*[(columns[c] if c in columns else F.col(c)).alias(c) for c in docs.columns])
