"""How the n-gram counts number words and put n-grams in order."""

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from trailmark.llm import backoff

TEXTS = [b"", None, b" ", b"\x1c a\x0bb\x85c \xff\xfe\x00x\t\r\n", b"one", b"\n\n", "ü é x".encode(), b"a b", None]


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
@pytest.mark.parametrize("part", [slice(None), slice(3, None), slice(3, 5), slice(0, 0), slice(1, 2)])
def test_words_are_those_of_bytes(kind, part):
    words, counts = backoff._words(pa.array(TEXTS, kind)[part])
    own = [(t or b"").split() for t in TEXTS[part]]
    assert words.view(kind).to_pylist() == [w for ws in own for w in ws]
    assert counts.tolist() == [len(ws) for ws in own]


@pytest.mark.parametrize("most", [1, 3, 1000, 2**40, 2**63])
def test_order_is_stable(most):
    keys = np.random.default_rng(1).integers(0, most, 5000, dtype=np.uint64)
    assert (backoff._ordered(keys) == np.argsort(keys, kind="stable")).all()
    assert len(backoff._ordered(keys[:0])) == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_a_chunk_deals_its_words_by_hash_and_keeps_their_order(monkeypatch, parts):
    class First:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(backoff.TaskContext, "get", lambda: First)
    texts = [b"b a b", None, b"c b \xff a", b"", b"d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts, pa.binary())], names=["id", "text"])
    (row,) = backoff._chunked(100, parts)(iter([batch]))
    hashes, counts = row["hashes"][0].as_py(), row["counts"][0].as_py()
    assert len(hashes) == len(counts) == parts
    want = [xxh64_intdigest(w) for t in texts for w in (t or b"").split()]
    assert {h % 2**64: n for hs, ns in zip(hashes, counts) for h, n in zip(hs, ns)} == {h: want.count(h) for h in want}
    assert all((h % 2**64 >> 32) * parts >> 32 == k for k, hs in enumerate(hashes) for h in hs)
    chunk = backoff.Chunk(pa.Table.from_batches([row]), 0, (parts, 1))
    assert chunk.word.tolist() == want
    assert chunk.sizes.tolist() == [3, 0, 4, 0, 1]


def test_totals_are_of_ngrams_that_several_chunks_have(spark):
    """The lowest and highest hashes too; the rows are exploded and sorted once, none is joined."""
    low, high = -(2**63), 2**63 - 1
    rows = [(0, 1, [5, high], [2, 1]), (0, 2, [5, 6], [1, 4]), (0, 3, [5], [7]), (1, 1, [low, -1], [1, 9]), (1, 3, [low], [1])]
    found = backoff.totals(spark.createDataFrame(rows, "part int, chunk bigint, grams array<bigint>, counts array<int>"), 2, 1)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    split = lambda t: sorted((x["part"], b >> backoff.TOTAL_BITS, b & (1 << backoff.TOTAL_BITS) - 1) for x in t for b in x["t"])
    assert {r["chunk"]: split(r["totals_1"]) for r in found.collect()} == {1: [(0, 0, 10), (1, 0, 2)], 2: [(0, 0, 10)], 3: [(0, 0, 10), (1, 0, 2)]}
