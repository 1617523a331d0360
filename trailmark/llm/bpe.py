"""Operator 3, SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a stretch of text the table holds the one token that ends the
prefix's encoding. Automaton matches name the pieces that end at a position; the
right one is compatible with the token that ends the prefix before it, that is, the
two encode to themselves side by side. The ids are then read off backwards.

No piece of the vocabulary has the space mark after another character (checked when
a model is loaded), so merges never cross from a word into the next space: stretches
of space marks with the characters after them are encoded one by one, and short ones
are remembered. Characters outside the vocabulary become byte tokens.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches
from .wordpiece import START, default_model

REMEMBERED = 250_000
PAIRS = 2_000_000
SHORT = 48
#: How an unknown id reads.
UNKNOWN = " \u2047 "
STRETCH = re.compile(f"{START}+[^{START}]*|[^{START}]+")


class Codec:
    """Encoder and decoder over the vocabulary of one model file."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=model)
        size = m.get_piece_size()
        self.end = m.eos_id()
        self.piece = [m.id_to_piece(i) for i in range(size)]
        self.byte = {i: int(self.piece[i][3:5], 16) for i in range(size) if m.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.unknown = m.unk_id()
        self.silent = {i for i in range(size) if m.is_control(i)}
        special = self.silent | set(self.byte) | {i for i in range(size) if m.is_unknown(i) or m.is_unused(i)}
        self.id = {self.piece[i]: i for i in range(size) if i not in special}
        self.score = {p: m.get_score(i) for p, i in self.id.items()}
        if any(START in p.lstrip(START) for p in self.id):
            raise ValueError("a piece has a space mark after another character; this vocabulary can't be encoded word by word")
        self.matches = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.matches.add_word(p, (len(p), i))
        self.matches.make_automaton()
        chars = "".join(p for p in self.id if len(p) == 1)
        self.outside = re.compile(f"[^{re.escape(chars)}]")
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.number = list(map(str, range(size)))
        # A byte below 128 is a character by itself; only the others must be put together.
        plain = {i: chr(b) for i, b in self.byte.items() if b < 128} | dict.fromkeys(self.silent, "") | {self.unknown: UNKNOWN}
        self.spelling = [plain.get(i, p) for i, p in enumerate(self.piece)]
        self.joined = {i for i, b in self.byte.items() if b >= 128}

    def merged(self, text: str) -> list[str]:
        """Merges by score, leftmost first, of a text no longer than two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, first: int, second: int) -> bool:
        """Whether the two tokens (``first`` -1: none) encode to themselves side by side."""
        key = (first + 1) << 20 | second
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        own = [self.piece[second]] if first < 0 else [self.piece[first], self.piece[second]]
        found = self.pairs[key] = self.merged("".join(own)) == own
        return found

    def stretch(self, text: str) -> list[int]:
        """Ids of a text of vocabulary characters, from its prefix table."""
        last = [-2] * (len(text) + 1)  # -2: no encoding ends here yet
        width = [0] * (len(text) + 1)
        last[0] = -1
        pairs = self.pairs
        for end, (n, token) in self.matches.iter(text):
            at = end + 1
            before = last[at - n]
            if before != -2 and last[at] == -2:
                ok = pairs.get((before + 1) << 20 | token)
                if ok or ok is None and self.compatible(before, token):
                    last[at], width[at] = token, n
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= width[at]
        return ids[::-1]

    def ids(self, text: str) -> list[int]:
        """Ids of a text with marks for spaces, where unknown characters become bytes."""
        out, at = [], 0
        for m in self.outside.finditer(text):
            if m.start() > at:
                out += self.stretch(text[at : m.start()])
            out += [self.byte_id[b] for b in m[0].encode()]
            at = m.end()
        return out + self.stretch(text[at:]) if at < len(text) else out

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        out: list[int] = []
        known = self.known
        for part in STRETCH.findall((START + text.replace(" ", START)) if text else ""):
            own = known.get(part)
            if own is None:
                own = self.ids(part)
                if len(part) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = own
            out += own
        out.append(self.end)
        return out

    def spell(self, ids: list[int]) -> str:
        """The characters of ids, space marks as spaces; a byte that spells none is U+FFFD."""
        spelling = self.spelling
        if self.joined.isdisjoint(ids):
            return "".join([spelling[i] for i in ids])
        out, raw = [], bytearray()

        def flush() -> None:
            while raw:
                try:
                    out.append(raw.decode())
                    raw.clear()
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode() + "�")
                    del raw[: e.start + 1]

        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
            else:
                flush()
                out.append(spelling[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first space mark goes, the others are spaces."""
        return self.spell(ids).removeprefix(START).replace(START, " ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them."""
        ids = self.encode(text)
        names = " ".join([self.number[i] for i in ids])
        return len(ids), hashlib.sha256(names.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def _lists(rows: Iterable[list[int]]) -> pa.Array:
    """Lists of ids as Arrow, four bytes an id from the start."""
    values, ends = array("i"), [0]
    for row in rows:
        values.extend(row)
        ends.append(len(values))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32) if len(values) else [], pa.int32()))


def encode(docs: DataFrame, *, model: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds each whole text's ids, the end id last; a null text is encoded as empty: the end id alone.

    Texts of any length are encoded whole; repeated rows get equal ids; an empty table gives an
    empty result. A column named ``out`` is replaced; all others stay as they are.
    """
    path = model or default_model()

    def over(texts: pa.Array) -> pa.Array:
        return _lists(codec(path).encode(x.as_py() or "") for x in texts)

    return short_batches(docs).withColumn(out, F.arrow_udf(over, "array<int>")(text_col))


def decode(docs: DataFrame, *, model: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; null or no ids give the empty text, null members are skipped.

    A column named ``out`` is replaced; all others stay as they are.
    """
    path = model or default_model()

    def over(ids: pa.Array) -> pa.Array:
        return pa.array((codec(path).decode([i for i in x.as_py() or [] if i is not None]) for x in ids), pa.string())

    return short_batches(docs).withColumn(out, F.arrow_udf(over, "string")(ids_col))


def round_trip(docs: DataFrame, *, model: str | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` and ``decoded``, the text of those ids, in one pass over the texts.

    Nulls, long texts, repeats and empty tables as in ``encode``. Columns named ``ids`` or
    ``decoded`` are replaced; all others stay as they are.
    """
    path = model or default_model()

    def over(texts: pa.Array) -> pa.Array:
        own, decoded = codec(path), []

        def rows() -> Iterator[list[int]]:
            for x in texts:
                ids = own.encode(x.as_py() or "")
                decoded.append(own.decode(ids))
                yield ids

        ids = _lists(rows())
        return pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string())], names=["ids", "decoded"])

    both = F.arrow_udf(over, "struct<ids:array<int>,decoded:string>")
    coded = short_batches(docs).withColumn("_both", both(text_col))
    return coded.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded")], "_both.*")


def digests(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` for each row of ``docs``.

    A null text counts as empty: one id, that of the end, and the empty text. Texts of
    any length are taken whole; repeated rows get equal results and stay; an empty table gives an
    empty result. Only the id and the text are read, so other columns may have any names.
    """
    path = model or default_model()

    def over(texts: pa.Array) -> pa.Array:
        own = codec(path)
        found = [own.digest(x.as_py() or "") for x in texts]
        columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
        return pa.StructArray.from_arrays(columns, names=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = F.arrow_udf(over, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    return short_batches(docs).select(F.col(id_col), found(F.col(text_col)).alias("_d")).select(id_col, "_d.*")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document's ids and the text that they decode to.

    A null or empty text has the end's id alone and decodes to the empty text; texts of any length
    are encoded whole, repeated rows stay. Of the columns only id and source are carried on; an
    empty table gives an empty result.
    """
    coded = round_trip(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
