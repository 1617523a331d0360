"""Licences behind very many words of titles."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from trailmark.llm import licences


def test_thousands_of_title_words(spark):
    """Texts and lines that repeat words of titles thousands of times don't overflow the stack; rows as the SQL has them."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    mit, notice = licences.TEXTS["MIT"], "Released under the MIT License."
    rows = [
        (1, "The " * 20_000 + "\n\n" + mit),
        (2, "Some words.\n" + "The new " * 10_000 + notice),
        (3, "the " * 20_000),
        (4, "Mit " * 20_000 + "them"),
        (5, "the " * 332 + "\n" + notice),
    ]
    got = licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted(map(tuple, got.withColumn("notices", F.array_join("notices", ",")).collect()))
    assert [(r[0], r[2], r[3]) for r in got] == [(1, "MIT", ""), (2, None, "MIT-notice"), (3, None, ""), (4, None, ""), (5, "MIT-notice", "MIT-notice")]
    assert (got[2][1], got[3][1]) == (sha("the"), sha("them"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(licences.ORACLE).fetchall())
