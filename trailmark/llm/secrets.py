"""Operator 10, secret scans, in DataFrame functions only.

Three patterns give the base spans. The method adds stretches that look random: two
character Markov models, of random strings and of ordinary identifiers, are counted
from labelled samples, and a token, or a piece of it between / _ -, is a secret if the
mean log-likelihood ratio of its character pairs is above a threshold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: What is looked at: tokens of 16 or more characters, and their pieces between / _ - of 16 or more.
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
PIECE = r"[A-Za-z0-9+]{16,}={0,2}"
JOINED = r"[A-Za-z0-9+]{4,}"
#: Ordinary whatever their characters: identifiers of the UUID form.
UUID = r"^[^A-Za-z0-9]*([0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}[^A-Za-z0-9]*)+$"
THRESHOLD = 0.4
SMOOTH = 0.5
#: Most labelled samples of each kind that ``labelled_samples`` makes.
SAMPLES = 4000
#: The last Spark release whose settings and functions are samples.
SINCE = (4, 1)
#: Length of the samples of one character, and how often each alphabet is one.
MASK = 24
ORDERS = 2
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _starts(lengths: Column) -> Column:
    """Sum of the numbers before each one, through sums of blocks."""

    def within(blocks: Column) -> Column:
        totals = F.transform(blocks, _sum)
        before = let(totals, lambda t: F.transform(t, lambda _, k: _sum(F.slice(t, 1, k))))
        return let(before, lambda b: F.flatten(F.transform(blocks, lambda block, k: F.transform(block, lambda _, i: F.get(b, k) + _sum(F.slice(block, 1, i))))))

    blocks = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda k: F.slice(n, k * BLOCK + 1, BLOCK))
    return let(lengths, lambda n: F.when(F.size(n) == 0, F.array().cast("array<int>")).otherwise(let(blocks(n), within)))


def spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Leftmost, non-overlapping matches: array of (start, rank, end, kind, found, part).

    Positions are code points: what lies between the matches, and the matches
    themselves, have lengths that add up.
    """
    rank = KINDS.index(kind)

    def placed(parts: Column) -> Column:
        gaps, found, part = parts["gaps"], parts["found"], parts["part"]
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, x: F.length(g) + F.length(x))
        return let(
            _starts(lengths),
            lambda starts: F.transform(
                found,
                lambda x, i: let(
                    F.get(starts, i) + F.length(F.get(gaps, i)),
                    lambda at: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(x)).alias("end"), F.lit(kind).alias("kind"), x.alias("found"), F.get(part, i).alias("part")),
                ),
            ),
        )

    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), every(0).alias("found"), every(group).alias("part"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,found:string,part:string>>")
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """The contract's spans, unsorted.

    A hex match takes a whole run, and so does an access key up to the end of its run:
    for these, matches of the least length are the matches that pass it.
    """
    assign = F.filter(spans(text, ASSIGN, "assign", 2), lambda s: F.length(s["part"]) >= 6)
    return F.concat(assign, spans(text, ACCESS[:-1] + "{16,}", "access"), spans(text, HEX[:-1] + "{24,}", "hex"))


def _named_by_spark(spark: SparkSession) -> DataFrame:
    """``(name, prose)``: Spark SQL's settings with their descriptions, and its functions.

    Those of releases up to ``SINCE``, so what extensions and later releases register, and the
    settings that appear once Hive's classes are loaded, change nothing. The functions are those that
    ``pyspark.sql.functions`` says were there.
    """
    release = lambda text: tuple(map(int, text.split(".")[:2]))
    since = F.split("Since version", "[.]").cast("array<int>")
    old = (F.get(since, F.lit(0)) < SINCE[0]) | (F.get(since, F.lit(0)) == SINCE[0]) & (F.get(since, F.lit(1)) <= SINCE[1])
    settings = spark.sql("SET -v").where(F.col("Since version").rlike("^[0-9]+[.][0-9]+[.]") & F.col("key").rlike("^spark[.]sql[.]") & ~F.col("key").contains("hive")).where(old)
    settings = settings.select(F.col("key").alias("name"), F.coalesce("meaning", F.lit("")).alias("prose"))
    added = {name: re.search(r"versionadded:: *([0-9]+[.][0-9]+)", getattr(F, name).__doc__ or "") for name in F.__all__}
    functions = sorted(name for name, found in added.items() if found and release(found[1]) <= SINCE)
    return settings.unionByName(_listed(spark, functions, "name").withColumn("prose", F.lit("")))


def _listed(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """A row for each of a short list of values without spaces."""
    return spark.range(1).select(F.explode(F.split(F.lit(" ".join(values)), " ")).alias(name))


def _monotonous(spark: SparkSession) -> DataFrame:
    """``(text)``: masks and paddings of one character, and the alphabets in order, from either end."""
    orders = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")
    masks = [c * MASK for c in "".join(orders)]
    runs = [x for order in orders for x in (order, order[::-1])] * ORDERS
    return _listed(spark, masks + runs, "text")


def labelled_samples(spark: SparkSession, rows: int = SAMPLES) -> DataFrame:
    """``(text, random)``: up to ``rows`` random strings and some thousand ordinary identifiers.

    The random ones are written in ten alphabets. Most ordinary ones were chosen by people:
    the names of Spark SQL's settings and functions with the words of their
    descriptions, as they are and in the styles of code (camel case, slugs, paths, constants), and dates,
    times, versions and numbered names. The others are runs of one character and alphabets.
    """
    n = spark.range(rows)
    bits = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    coded = F.regexp_replace(F.base64(F.unhex(bits)), "=", "")
    of = lambda k, *styles: F.element_at(F.array(*styles), (F.pmod(k, F.lit(len(styles))) + 1).cast("int"))
    plain62 = F.regexp_replace(coded, "[+/]", "")
    letters = F.regexp_replace(coded, "[^A-Za-z]", "")
    kinds = (F.substring(bits, 1, 64), F.upper(F.substring(bits, 65, 40)), F.substring(coded, 1, 43), F.translate(F.substring(coded, 1, 43), "+/", "-_"), F.substring(plain62, 1, 40), F.upper(F.substring(plain62, 1, 40)), F.lower(F.substring(plain62, 1, 40)), F.substring(letters, 1, 40), F.upper(F.substring(letters, 1, 40)), F.lower(F.substring(letters, 1, 40)))
    random = n.select(of(F.col("id"), *kinds).alias("text"), F.lit(True).alias("random"))
    known = _named_by_spark(spark)
    words = known.select(F.explode(F.split(F.concat_ws(" ", "name", "prose"), "[^A-Za-z]+")).alias("text")).where("length(text) between 2 and 16").distinct()
    # Three words that stand together in a description, written in the styles of code.
    near = known.select(F.filter(F.split(F.lower("prose"), "[^a-z]+"), lambda w: F.length(w) > 2).alias("w"))
    three = near.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2), F.lit(3)), lambda k: F.slice("w", k, 3))).alias("k", "t")).where("size(t) = 3")
    number = F.pmod(F.xxhash64("t", "k"), F.lit(10_000)).cast("string")
    camel = F.concat(F.col("t")[0], F.initcap(F.col("t")[1]), F.initcap(F.col("t")[2]))
    styles = (camel, F.concat(camel, F.substring(number, 1, 2)), F.array_join("t", "_"), F.concat_ws("-", F.array_join("t", "-"), number), F.upper(F.array_join("t", "_")), F.concat_ws("/", F.array_join("t", "/"), number), F.array_join("t", ""), F.concat(F.initcap(camel), F.lit("V"), F.substring(number, 1, 1)))
    written_ = three.select(of(F.xxhash64("k", "t"), *styles).alias("text")).distinct()
    moment = F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(2_000_000_000)))
    form = lambda f: F.date_format(moment, f)
    some = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)).cast("string")
    dated = spark.range(rows // 8).select(
        of(F.col("id"), form("yyyy-MM-dd'T'HH-mm-ss"), form("yyyyMMddHHmmss"), form("yyyy/MM/dd/HH"), F.concat(F.lit("part-"), F.lpad(some, 5, "0")), F.concat(F.lit("v"), some, F.lit("-"), form("yyyyMMdd")), F.concat(form("yyyy-MM-dd"), F.lit("-run"), some)).alias("text")
    )
    dotless = known.select(F.explode(F.split("name", "[.]")).alias("text")).distinct()
    return random.unionByName(words.union(written_).union(dotless).union(dated).union(_monotonous(spark)).withColumn("random", F.lit(False)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters of ``ALPHABET``, row by row.

    Counts come from ``samples(text, random)``; characters outside the alphabet and
    null texts count nothing. The table's size depends on the alphabet alone.
    """
    chars = F.split(F.regexp_replace("text", f"[^{ALPHABET.replace('-', '')}-]", ""), "")
    pairs = F.zip_with(chars, F.slice(chars, 2, 1 << 30), lambda a, b: F.concat(a, b))
    counts = samples.where("text is not null and random is not null").select("random", F.explode(pairs).alias("pair")).where("length(pair) = 2").groupBy("random", "pair").count()
    n = {True: {}, False: {}}
    for r in counts.collect():
        n[r["random"]][r["pair"]] = r["count"]
    out = []
    for a in ALPHABET:
        total = {k: sum(n[k].get(a + b, 0) for b in ALPHABET) + SMOOTH * len(ALPHABET) for k in n}
        for b in ALPHABET:
            out.append(math.log((n[True].get(a + b, 0) + SMOOTH) / total[True]) - math.log((n[False].get(a + b, 0) + SMOOTH) / total[False]))
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded to a constant
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    size = len(ALPHABET)

    def mean(p: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.get(table, F.get(p, i) * size + F.get(p, i + 1)))
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (F.size(p) - 1)

    return let(places, mean)


def markov_spans(text: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Stretches that the models call random.

    A token is judged as a whole if each of its pieces of four or more characters
    between / _ - looks random, there are small letters, capitals and digits in it, and it isn't
    a UUID; else each piece of 16 or more characters is judged by itself, so that the
    words of a path don't hide a key in it. What is a base span as a whole (hex runs,
    access keys) isn't repeated.
    """
    # Letters of one case look least unlike words: for these the ratio has to be twice the threshold.
    random = lambda x: ratio(x, model) > F.when(x.rlike("^([a-z]+|[A-Z]+)$"), 2 * threshold).otherwise(threshold)
    base = lambda x: x.rlike(r"^([0-9a-f]{24,}|AKIA[A-Z0-9]{16,})$")
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]")

    def judged(s: Column) -> Column:
        x = s["found"]
        whole = mixed(x) & x.rlike("[/_-]") & ~x.rlike(UUID) & F.forall(F.regexp_extract_all(x, F.lit(JOINED), F.lit(0)), random) & random(x)
        moved = lambda p: F.struct((s["start"] + p["start"]).alias("start"), p["rank"].alias("rank"), (s["start"] + p["end"]).alias("end"), p["kind"].alias("kind"), p["found"].alias("found"), p["part"].alias("part"))
        pieces = F.filter(spans(x, PIECE, "markov"), lambda p: random(p["found"]))
        return F.when(whole, F.array(s)).otherwise(F.transform(pieces, moved))

    found = F.flatten(F.transform(spans(text, TOKEN, "markov"), judged))
    return F.filter(found, lambda s: ~base(s["found"]))


def scan(docs: DataFrame, model: list[float], *, threshold: float = THRESHOLD, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Adds a struct of two arrays, ``base`` and ``added``, of (start, rank, end, kind, found, part).

    Spans are in code points, end exclusive, in order of start, then kind. A null text
    counts as empty: no spans. Texts are scanned whole, however long; repeated rows get
    equal results, ties can't arise (spans of one kind don't overlap), an empty table
    gives an empty result. A column named ``out`` is replaced; all others stay as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, F.struct(F.array_sort(base_spans(text)).alias("base"), F.array_sort(markov_spans(text, model, threshold)).alias("added")))


def _named(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(spark))).select("doc_id", "secrets.base", "secrets.added")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(_named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _named(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
