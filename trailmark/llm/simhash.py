"""Operator 6, SimHash near-dedup by multi-index hashing.

Fingerprints of 64 bits link at 2 or fewer differing bits. They are cut into two
segments of 32 bits. Of two linked fingerprints either the left segments differ in
at most one bit, or the right segments are equal; so a ball of radius 1 around each
left segment and of radius 0 around each right one finds every link in the segment
tables, and the complete distance decides.

A table entry with more than ``CROWDED`` different fingerprints (many slight
variants of one text) would make all their pairs. Fingerprints that meet such an
entry are linked exactly and in proportion to their number instead: two are within
2 bits just if some word of 64 bits is within 1 bit of both, so each is dealt to
the 65 words of its own ball, and all that meet at one word (65 at most) link to the
smallest of them.

Texts that share 80 % of their five-word shingles often differ in ten bits or more,
where no segment index is selective. ``near_duplicates(similarity=0.8)`` finds these by
further fingerprints, each of a small sample of the shingles that equal texts draw
alike, and verifies the whole shingle sets of what meets: all with a few heads, and
those that these leave in different components through a prefix join, which is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import short_batches, text_bytes, unused, written
from .graph import components

SEED = 42
CROWDED = 256
HALF = 0xFFFFFFFF
#: Hashes whose bits are counted at once.
BLOCK = 65536
#: Samples of three shingles a text. Two texts with similarity 0.8 share none of them
#: once in about 100,000 times.
VIEWS = 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; none for a text without words."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()[min(size, len(words)) - 1 :]
    return np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of the shingles' hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        raw = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def views(hashes: np.ndarray) -> list[int]:
    """``VIEWS`` fingerprints, each of the three distinct shingles that one ordering puts first."""
    own = np.unique(hashes)
    if not len(own):
        return []
    out = []
    for v in range(VIEWS):
        salt = np.uint64(xxh64_intdigest(b"view", v) | 1)
        order = own * salt
        order ^= order >> np.uint64(29)
        first = own[np.argpartition(order, 2)[:3]] if len(own) > 3 else own
        a, b, c = first[0], first[-1], first[len(first) // 2]
        out.append(int(((a & b) | (a & c) | (b & c)).view(np.int64)))
    return out


def fingerprints(docs: DataFrame, *, size: int = 3, text_col: str = "text", out: str = "fp", sampled: bool = False) -> DataFrame:
    """Adds each text's fingerprint as a long; zero where there are no words or no text.

    ``sampled`` also adds ``views``, the fingerprints of the text's samples.
    """

    def over(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(shingle_hashes(x or b"", size)) for x in texts.to_pylist()], pa.int64())

    def both(texts: pa.Array) -> pa.Array:
        hashes = [shingle_hashes(x or b"", size) for x in texts.to_pylist()]
        columns = [pa.array(map(fingerprint, hashes), pa.int64()), pa.array(map(views, hashes), pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, names=[out, "views"])

    docs = short_batches(docs)
    if not sampled:
        return docs.withColumn(out, F.arrow_udf(over, "bigint")(text_bytes(text_col)))
    found = F.arrow_udf(both, f"struct<{out}:bigint,views:array<bigint>>")
    held = unused(docs, "_both")
    return docs.withColumn(held, found(text_bytes(text_col))).select("*", f"{held}.*").drop(held)


def _segments(fps: DataFrame) -> DataFrame:
    left, right = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(HALF))
    return fps.select("fp", F.inline(F.array(F.struct(F.lit(0).alias("seg"), left.alias("key")), F.struct(F.lit(1).alias("seg"), right.alias("key")))))


def links(fps: DataFrame, *, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``(u, v)`` that connect what is within 2 bits, from distinct ``fps(fp)``.

    Each pair is a link. Outside crowded entries every link is among the pairs;
    inside them the pairs connect the same components.
    """
    table = _segments(fps)
    sized = table.groupBy("seg", "key").agg(F.count("*").alias("n"))
    # Clearing a set bit reaches the other side of a one-bit difference just once.
    bits = F.array(*[F.lit(1 << k) for k in range(32)])
    cleared = F.filter(bits, lambda b: (F.col("key").bitwiseAND(b) != 0) & (F.col("seg") == 0))
    probes = table.select("fp", "seg", F.explode(F.concat(F.array(F.lit(0)), cleared)).alias("bit"), "key")
    probes = probes.select(F.col("fp").alias("u"), "seg", F.col("key").bitwiseXOR(F.col("bit")).alias("key"), "bit")
    full = written(sized.where(F.col("n") > crowded).select("seg", "key"), "crowded")
    rest = table.select(F.col("fp").alias("v"), "seg", "key")
    some = not full.isEmpty()
    found = probes.join(rest.join(full, ["seg", "key"], "left_anti") if some else rest, ["seg", "key"])
    found = found.where("(bit != 0 or u > v) and bit_count(u ^ v) <= 2").select("u", "v")
    if not some:
        return found
    held = rest.join(full, ["seg", "key"], "left_semi").select(F.col("v").alias("u"))
    reached = held.union(probes.join(full, ["seg", "key"], "left_semi").select("u")).distinct()
    words = F.array(F.lit(0), *[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)])
    balls = reached.select(F.col("u").alias("v"), F.explode(words).alias("bit")).select("v", F.col("v").bitwiseXOR(F.col("bit")).alias("word"))
    met = balls.withColumn("u", F.min("v").over(Window.partitionBy("word"))).where("u != v and bit_count(u ^ v) <= 2").select("u", "v")
    return found.unionByName(met)


def _similarity(size: int):
    def of(text: bytes | None) -> np.ndarray:
        return np.unique(shingle_hashes(text or b"", size))

    def over(one: pa.Array, other: pa.Array) -> pa.Array:
        out, held, own = [], None, np.zeros(0, np.uint64)
        for a, b in zip(one.to_pylist(), other.to_pylist()):
            if b != held:  # rows come by representative: its set is made once
                held, own = b, of(b)
            theirs = of(a)
            both = len(np.intersect1d(theirs, own, assume_unique=True))
            out.append(both / max(1, len(theirs) + len(own) - both))
        return pa.array(out, pa.float64())

    return F.arrow_udf(over, "double")


def _shingles(size: int):
    def over(texts: pa.Array) -> pa.Array:
        sets = [np.unique(shingle_hashes(x or b"", size)).view(np.int64) for x in texts.to_pylist()]
        return pa.array(sets, pa.list_(pa.int64()))

    return F.arrow_udf(over, "array<bigint>")


def crossing_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(u, v)`` of different ``comp`` that hold all those of ``similarity`` or more.

    ``sets(fp, comp, tokens)`` are compared by their prefixes: with the tokens in one
    order, the rarest first, two sets that are so similar have their first common token
    among the first few of both, and enough tokens behind it. No such pair is left out.
    In each token's list, the component with most members isn't paired with itself.
    """
    slack = 1e-6
    sized = sets.select("fp", "comp", F.size("tokens").alias("size"))
    tokens = sets.select("fp", F.explode("tokens").alias("token"))
    shared = written(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    order = tokens.join(shared, "token").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("order"))
    # Tokens that no other set has come first, so they only count in the places.
    lone = F.col("size") - F.size("order")
    least = lambda part: (F.col("size") - F.ceil(F.col("size") * part - slack) + 1).cast("int")
    prefix = F.slice("order", 1, F.greatest(F.lit(0), least(similarity) - lone))
    posts = order.join(sized, "fp").select("fp", "comp", "size", lone.alias("lone"), F.posexplode(prefix).alias("pos", "o"))
    posts = written(posts.select("fp", "comp", "size", (F.col("lone") + F.col("pos")).alias("at"), "o.token"), "posts")
    members = posts.groupBy("token", "comp").agg(F.count("*").alias("c"))
    most = written(members.groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("most"), F.count("*").alias("kinds")).where("kinds > 1"), "most")
    posts = written(posts.join(most, "token").withColumn("minor", F.col("comp") != F.col("most")).drop("most", "kinds"), "crossing")
    # The smaller set of a pair has the token in a shorter prefix still.
    small = posts.where(F.col("at") < least(2 * similarity / (1 + similarity))).alias("y")
    large = posts.alias("x")
    meet = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.comp") != F.col("y.comp"))
        & (F.struct("x.size", "x.fp") > F.struct("y.size", "y.fp"))
        & (F.col("y.size") >= F.col("x.size") * similarity - slack)
        & (F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) >= (F.col("x.size") + F.col("y.size")) * (similarity / (1 + similarity)) - slack)
    )
    found = small.where("minor").join(large, meet).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))
    return found.unionByName(small.where("not minor").join(large.where("minor"), meet).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))).distinct()


def similar_components(docs: DataFrame, each: DataFrame, found: DataFrame, *, size: int, similarity: float) -> DataFrame:
    """``(node, root)`` over the links ``found(u, v)`` and those of texts that share ``similarity`` of their shingles.

    ``each(fp, least, views)`` has a row per fingerprint; ``docs(_who, _text)`` the texts,
    of which that of the least row stands for the fingerprint. All texts that meet in a
    sample are first compared with the one of them that meets most others over all
    samples, the likeliest original, and with the least row. Where texts that
    met are in different components after that, ``crossing_pairs`` finds what else is
    similar: pairs inside a component can't change it, so none of them is needed.
    """
    met = each.select("fp", "least", F.posexplode("views").alias("view", "key"))
    # Aggregates are written before they are joined back, here and below: behind an aggregate
    # Spark can't split what is hot (a crowded sample, the root of a large component, fingerprint zero).
    groups = written(met.groupBy("view", "key").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    met = written(met.join(groups, ["view", "key"]), "met")
    weight = met.groupBy("fp", "least").agg(F.sum("n").alias("weight"))  # as many rows a key as there are views
    weighed = met.join(weight, ["fp", "least"])
    first = F.min(F.struct(-F.col("weight"), "least", "fp"))["fp"]
    heads = written(weighed.groupBy("view", "key").agg(first.alias("central"), F.min(F.struct("least", "fp"))["fp"].alias("oldest")), "heads")
    pairs = met.join(heads, ["view", "key"]).select(F.col("fp").alias("u"), F.explode(F.array("central", "oldest")).alias("v"))
    pairs = written(pairs.where("u != v").distinct(), "pairs")
    named = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct().join(each.select("fp", "least"), "fp")
    texts = written(docs.join(named, _same(docs["_who"], named["least"])).select("fp", "_text").dropDuplicates(["fp"]), "texts")
    one, other = (texts.select(F.col("fp").alias(x), F.col("_text").alias(f"text_{x}")) for x in "uv")

    def similar(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(one, "u").join(other, "v").sortWithinPartitions("v")
        return joined.where(_similarity(size)("text_u", "text_v") >= similarity).select("u", "v")

    root = components(found.unionByName(similar(pairs)))
    placed = met.join(root, met["fp"] == root["node"], "left").select("fp", "view", "key", F.coalesce("root", "fp").alias("comp"))
    mixed = written(placed.groupBy("view", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high"), "mixed")
    apart = written(placed.join(mixed, ["view", "key"], "left_semi").select("fp", "comp").distinct(), "apart")
    if apart.isEmpty():
        return root
    sets = written(texts.join(apart, "fp").select("fp", "comp", _shingles(size)("_text").alias("tokens")), "sets")
    further = similar(crossing_pairs(sets, similarity))
    return components(further.unionByName(root.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def _who(id_col: str, text_col: str) -> Column:
    """What tells rows apart: id and text. Nulls of the id come last."""
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), tag.alias("tag"))


def _same(one: Column, other: Column) -> Column:
    return (one["tag"] == other["tag"]) & one["id"].eqNullSafe(other["id"])


def grouped(docs: DataFrame, *, size: int = 3, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """``(who, fp, first)`` for each row of ``docs``: itself, its fingerprint and the least row of its component."""
    read = docs.select(_who(id_col, text_col).alias("_who"), text_bytes(text_col).alias("_text"))
    own = written(fingerprints(read, size=size, text_col="_text", sampled=similarity is not None).drop("_text"), "fingerprints")
    least = F.min("_who").alias("least")
    if similarity is None:
        each = written(own.groupBy("fp").agg(least), "distinct")
        root = components(links(each.select("fp"), crowded=crowded))
    else:
        each = written(own.groupBy("fp").agg(least, F.min_by("views", "_who").alias("views")), "distinct")
        found = links(each.select("fp"), crowded=crowded)
        root = similar_components(read, each, found, size=size, similarity=similarity)
    placed = each.join(root, each["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(placed.groupBy("root").agg(F.min("least").alias("first")), "named")
    by_fp = written(placed.join(named, "root").select("fp", "first"), "by_fp")
    return own.join(by_fp, "fp").select(F.col("_who").alias("who"), "fp", "first")


def near_duplicates(docs: DataFrame, *, size: int = 3, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """``(id, fingerprint, component_id)`` for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own
    included. Fingerprints within 2 bits link; with ``similarity``, texts that share so
    much of their shingles link too. Rows without a text or without words have
    fingerprint zero and link like any other. Rows with a null id take part in links
    but name no component unless all ids of the component are null.
    Texts of any length are read whole; equal texts tie, and the least id stands for them.
    Repeated rows stay; an empty table gives an empty result. Only the id and the text are
    read, so other columns may have any names; they are left out.
    """
    found = grouped(docs, size=size, similarity=similarity, id_col=id_col, text_col=text_col, crowded=crowded)
    return found.select(F.col("who.id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates one row stays.

    Groups are of five-word shingles and similarity 0.8. The row that stays has the
    least id, and of several rows with that id (or without any, where no row of the
    group has one) the least hash of its text. Rows that share an id but are no near
    duplicates are different documents; of rows with the same id and text one stays.
    Texts that are null or without words are one group; texts of any length are read whole.
    All columns stay as they are, whatever their names; an empty table stays empty.
    """
    found = grouped(docs, size=5, similarity=0.8)
    gone = found.where(~_same(F.col("who"), F.col("first"))).select("who").distinct()
    tag, gone_id, gone_tag = (unused(docs, c) for c in ("_tag", "_gone_id", "_gone_tag"))
    gone = gone.select(F.col("who.id").alias(gone_id), F.col("who.tag").alias(gone_tag))
    tagged = docs.withColumn(tag, _who("doc_id", "text")["tag"])
    left = tagged.join(gone, (F.col(tag) == F.col(gone_tag)) & F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
    if not found.groupBy("who").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", tag])
    return left.drop(tag)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (3-word shingles, 2 bits)."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
