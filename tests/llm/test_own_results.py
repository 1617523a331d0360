"""The registered queries' own rows, and the stages' own tables, against plain versions."""

import collections
import hashlib
import math
import random
import re

import pytest
import sentencepiece
import xxhash

from trailmark.llm import bpe, linededup, quality, queries, secrets, simhash, wordpiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\r\v\f"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows_of(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    return {r["doc_id"]: r for r in got}


def counts(text):
    w = WORD.findall(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def walked(model, x):
    """Log-odds, a tree after the other, a node after the other."""
    total = model.base
    for node in model.roots:
        while model.left[node] != node:
            node = model.left[node] if x[model.feature[node]] <= model.threshold[node] else model.right[node]
        total += model.value[node]
    return total


def test_op1(spark):
    sf = "/root/testdata/sf0.01"  # the trees reject some documents here
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows_of(spark, sf, "op1_quality")
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(got) == set(texts) and len(model.roots) == 60
    verdicts = set()
    for i, text in texts.items():
        r, want = got[i], counts(text)
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        score = 1 / (1 + math.exp(-walked(model, quality.statistics(text.encode())[1])))
        assert r["base_failed"] == failed and r["score"] == pytest.approx(score, rel=1e-9)
        assert r["kept"] == (not failed and score >= 0.5)
        verdicts.add((failed, r["kept"]))
    assert verdicts == {(True, False), (False, True), (False, False)}


def test_op3_and_op5(spark, sf, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=bpe.default_model())
    pieces = {library.id_to_piece(k) for k in range(library.get_piece_size())}
    three, five = rows_of(spark, sf, "op3_sentencepiece"), rows_of(spark, sf, "op5_token_counts")
    assert set(three) == set(five) == set(texts) and pieces
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, text in texts.items():
        ids = library.encode(text, add_eos=True)
        assert (three[i]["n_tokens"], three[i]["ids_sha256"], three[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
        n = len(WORD.findall(text))
        assert five[i]["n_words"] == n and five[i]["n_tokens"] >= n
    one = wordpiece.token_counts(spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in one} == {i: r["n_tokens"] for i, r in five.items()}


def plain_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in items}


def test_op6(spark, sf, texts):
    got = rows_of(spark, sf, "op6_simhash")
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    ids = sorted(prints)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert linked and {i: r["component_id"] for i, r in got.items()} == roots(ids, linked)


def gone_and_left(text, left):
    """Places, among the lines with a word, of those that ``left`` lacks; other lines have to be in both."""
    lines, kept = text.split("\n"), left.split("\n")
    at, place, gone = 0, 0, []
    for x in lines:
        worded = bool(x.strip(BLANK))
        if at < len(kept) and kept[at] == x:
            at += 1
        else:
            assert worded
            gone.append(place)
        place += worded
    assert at == len(kept) or left == ""
    return gone


def test_op8(spark, sf, texts):
    got = rows_of(spark, sf, "op8_line_dedup")
    left = {r["doc_id"]: r["lines"]["text"] for r in linededup.dedup(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert set(got) == set(texts)
    seen, pairs, triples, longs, some = set(), set(), set(), set(), 0
    for i in sorted(texts):
        lines = [x.strip(BLANK) for x in texts[i].split("\n") if x.strip(BLANK)]
        must = set()
        for p, x in enumerate(lines):
            if len(WORD.findall(x)) >= 50:
                must |= {p} if x in longs else set()
                longs.add(x)
            if p >= 1:
                two = tuple(lines[p - 1 : p + 1])
                must |= {p - 1, p} if two in pairs and sum(len(WORD.findall(y)) for y in two) >= 50 else set()
                pairs.add(two)
            if p >= 2:
                three = tuple(lines[p - 2 : p + 1])
                must |= {p - 2, p - 1, p} if three in triples else set()
                triples.add(three)
        text, r = left[i] or "", got[i]
        after = [x.strip(BLANK) for x in text.split("\n") if x.strip(BLANK)]
        gone = collections.Counter(lines) - collections.Counter(after)
        assert not collections.Counter(lines[p] for p in must) - gone
        within = collections.Counter(lines)
        assert all(x in seen or within[x] > 1 for x in gone)
        seen |= set(lines)
        assert (r["n_lines"], r["n_deleted"]) == (len(lines), len(lines) - len(after))
        assert r["deleted_words"] == len(WORD.findall(texts[i])) - len(WORD.findall(text))
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert len(gone_and_left(texts[i], text)) == r["n_deleted"]
        some += r["n_deleted"] > 0
    assert some


@pytest.fixture(scope="module")
def mixed(spark):
    """Good, bad, odd and long texts, some of them repeated, under ids that are absent or shared."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    good = [" ".join(word() for _ in range(120)) for _ in range(4)]
    long = "\n".join(" ".join(word() for _ in range(40)) for _ in range(3_000))
    texts = [None, "", " \n\t", "few words", "again and again " * 40, long, long, *good, good[0], None, "few words"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, None, None, 4]
    return spark.createDataFrame([(i, t, "en", None if k % 4 == 0 else "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def key(r):
    return repr((r["doc_id"], r["text"]))


def test_quality_stage(spark, sf, mixed):
    """What is left is what passes the rules and a plain walk of the trees; the rows are as they were."""
    model = quality.train(mixed, spark.read.parquet(f"{sf}/labels.parquet"))
    got = quality.stage(spark, mixed, sf)
    assert got.columns == mixed.columns

    def keeps(text):
        n = counts(text)
        passed = n[0] >= 50 and 100 * n[4] <= 50 * n[0]
        return passed and (model is None or 1 / (1 + math.exp(-walked(model, quality.statistics(text.encode())[1]))) >= 0.5)

    rows = mixed.collect()
    assert sorted(map(repr, got.collect())) == sorted(repr(r) for r in rows if keeps(r["text"] or ""))
    assert quality.stage(spark, mixed.where("doc_id = -1"), sf).count() == 0


def test_line_dedup_stage(spark, sf, mixed):
    """A repeat of another id goes as a whole, of rows with the same id and text none; nulls and empty texts stay."""
    got = linededup.stage(spark, mixed, sf)
    assert got.columns == mixed.columns
    rows = mixed.collect()
    want = [r for r in rows if not (r["doc_id"] == 7 or r["doc_id"] is None and r["text"])]
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    assert linededup.stage(spark, mixed.where("doc_id = -1"), sf).count() == 0


def test_simhash_stage(spark, sf, mixed):
    """Of equal texts the least id stays, of texts without words one; rows that share an id are told apart."""
    got = simhash.stage(spark, mixed, sf).collect()
    first = {}
    for r in sorted(mixed.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        first.setdefault((r["text"] or "").strip(), r)
    assert sorted(map(key, got)) == sorted(map(key, first.values()))
    assert simhash.stage(spark, mixed.where("doc_id = -1"), sf).count() == 0


def test_codec_stage(spark, sf, mixed):
    library = sentencepiece.SentencePieceProcessor(model_file=bpe.default_model())
    got = bpe.stage(spark, mixed, sf).collect()
    want = []
    for r in mixed.collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], r["source"], len(ids), ids, library.decode(ids)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.stage(spark, mixed.where("doc_id = -1"), sf).count() == 0


def test_masks_and_samples_of_the_session(spark):
    """Masks, paddings and alphabets aren't secrets, upper-case hex is; what a session sets or registers changes no sample."""
    samples = secrets.labelled_samples(spark)
    before = sorted(map(tuple, samples.collect()))
    spark.sql("SET spark.sql.of.this.session = aKeyThatNobodyElseHas")
    spark.udf.register("function_of_this_session", lambda x: x)
    try:
        assert sorted(map(tuple, secrets.labelled_samples(spark).collect())) == before
    finally:
        spark.conf.unset("spark.sql.of.this.session")
        spark.sql("DROP TEMPORARY FUNCTION function_of_this_session")
    assert {r for _, r in before} == {True, False}
    rng, model = random.Random(20), secrets.train(samples)
    plain = ["X" * 20, "x" * 32, "A" * 24, "A" * 31 + "=", "0" * 32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ZYXWVUTSRQPONMLKJIHGFEDCBA", "abcdefghijklmnopqrstuvwxyz", "0123456789" * 3, "XXXX-XXXX-XXXX-XXXX-XXXX"]
    keys = ["".join(rng.choice("0123456789ABCDEF") for _ in range(n)) for n in (16, 20, 24, 32, 40) for _ in range(100)]
    rows = [(k, f"a {x} b") for k, x in enumerate(plain + keys)]
    found = {r["doc_id"]: len(r["secrets"]["added"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert not any(found[k] for k in range(len(plain)))
    assert sum(found[k] > 0 for k in range(len(plain), len(rows))) >= 0.95 * len(keys)
