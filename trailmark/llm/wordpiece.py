"""Operator 5, token counts: greedy word pieces counted in linear time.

A trie over the vocabulary carries failure links, and each node the number of
pieces that its failure pops. One pass over a word's characters adds up those
numbers, which is the count of greedy longest-match pieces; the pieces themselves
are never built.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, text_bytes

START = "▁"
#: Words whose counts a task remembers at once.
REMEMBERED = 300_000


class Automaton:
    """Trie of word starts and of continuations with failure links.

    ``pieces`` beginning with ``START`` may begin a word, the others continue one.
    """

    def __init__(self, pieces: list[str]):
        self.step: dict[int, int] = {}
        self.link: list[int] = [-1, -1]
        self.pops: list[int] = [0, 0]
        whole = [False, False]
        depth: list[tuple[int, int, int, int]] = []  # level, parent, character, node
        for piece in dict.fromkeys(pieces):
            node = 0 if piece.startswith(START) else 1
            for level, c in enumerate(map(ord, piece)):
                at = node << 21 | c
                if at not in self.step:
                    self.step[at] = len(whole)
                    depth.append((level, node, c, len(whole)))
                    whole.append(False), self.link.append(-1), self.pops.append(0)
                node = self.step[at]
            whole[node] = True
        for _, parent, c, node in sorted(depth):
            if whole[node]:
                self.link[node], self.pops[node] = 1, 1
                continue
            at, popped = self.link[parent], self.pops[parent]
            while at >= 0 and (at << 21 | c) not in self.step:
                popped += self.pops[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.pops[node] = self.step[at << 21 | c], popped

    def count(self, word: str) -> int:
        """Number of pieces of a word, or 0 if greedy matching can't cover it."""
        node, pieces = 0, 0
        for c in map(ord, START + word):
            while (to := self.step.get(node << 21 | c)) is None:
                pieces += self.pops[node]
                node = self.link[node]
                if node < 0:
                    return 0
            node = to
        while node != 1:
            pieces += self.pops[node]
            node = self.link[node]
            if node < 0:
                return 0
        return pieces


class Counts(dict):
    """Counts by word (UTF-8), found when first asked for; an unknown word is -1."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(word.decode("utf-8", "replace")) or -1
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counts(model: str) -> Counts:
    """The counts over the normal pieces of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=model)
    ids = range(m.get_piece_size())
    return Counts(Automaton([m.id_to_piece(i) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]))


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def token_counts(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_tokens, n_unknown)`` for each row of ``docs``.

    Words are runs between ASCII white space; a word that the vocabulary can't cover
    is one unknown token. A null text counts as empty (all zeros), as does one of space
    alone; texts of any length are read whole. Repeated rows get equal results and stay; an
    empty table gives an empty result. Other columns may have any names: they are left
    out. ``model`` is the vocabulary's path on the executors.
    """
    path = model or default_model()

    def over(texts: pa.Array) -> pa.Array:
        known = counts(path)
        words, tokens, unknown = [], [], []
        for text in texts.to_pylist():
            found = [known[w] for w in (text or b"").split()]
            missed = found.count(-1)
            words.append(len(found)), tokens.append(sum(found) + 2 * missed), unknown.append(missed)
        columns = [pa.array(x, pa.int64()) for x in (words, tokens, unknown)]
        return pa.StructArray.from_arrays(columns, names=["n_words", "n_tokens", "n_unknown"])

    counted = F.arrow_udf(over, "struct<n_words:bigint,n_tokens:bigint,n_unknown:bigint>")
    return short_batches(docs).select(F.col(id_col), counted(text_bytes(text_col)).alias("_n")).select(id_col, "_n.*")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
