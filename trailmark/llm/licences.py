"""Operator 4, licence scans by canonical digest, in DataFrame functions only.

A text's canonical form has no copyright notices, list marks, upper case, punctuation,
extra space or title before a licence, and one spelling where licences vary. It doesn't
depend on where lines break. The SHA-256 of a whole document's form is joined to the
digests of known licence texts; the forms of its lines are joined to them likewise, which
finds one-line notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Public licence texts and notices, by SPDX identifier.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
# SHA-256 of the canonical forms of long public licence texts, by SPDX identifier.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "6302b5dead23526a52043dbcf277f56ddb2d8d09f4c72b47ab5c11c08754c409",
    "Artistic-1.0-Perl": "70bf7a034022d2a125b8d9cf419e8d6bba813ae4db44502edab2f2388c779d32",
    "CC0-1.0": "af66a5743ae687517638668d66139ee3b97881009593d1c3df743f2786bd2f94",
    "GFDL-1.2": "c82ed3bd6bdc38410a4dd9eb727d7746e9da2a42a97da9748d31ed8377832c85",
    "GFDL-1.3": "d245e617b393a878d76f8de941cdb5414f8e30d6447411fd75712650d5f0cd78",
    "GPL-1.0": "21e1766608aa9bd5ac7ce51a431e65e34ee2d8c19a84d3d66da2ff252dca2d93",
    "GPL-2.0": "e0aef69cf9b77bba7603bcd51b9fb53388964fa208ad48b1dd7c7fc2abee40c9",
    "GPL-3.0": "3e478b3a82999a4f8b47809b70f8a028742c8358e8fdfa62eddc28067c04d1f9",
    "LGPL-2.0": "36ed4b43ff0f372764869bd7b3736b4266c4810b5c37c308e57f96638253afd5",
    "LGPL-2.1": "1f654bcf3df492174581bb8a7de9417a634149e000ac8f9ef42ffb966fefc1c5",
    "LGPL-3.0": "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",
    "MPL-1.1": "f4fab8585596e775dd6409a3f4bfe2aa779f0b049c865b813598cddd1388f738",
    "MPL-2.0": "ba91ffb2480d2246063a0d9bcf695d79839edc0bc3180e1764c4ea6dca67a680",
}
#: Spellings that count as one, as (pattern, form), on words in lower case between spaces or line ends.
SPELLINGS = (
    (r"licence", "license"),
    (r"\bsub[ \n]+license", "sublicense"),
    (r"\bnon[ \n]+infringement", "noninfringement"),
    (r"\bcopyright([ \n]+)owner", r"copyright\1holder"),
    (r"\bneither the name of [\p{L}\p{N} \n]{1,80}? nor the names of", "neither the name of the copyright holder nor the names of"),
    (r"\bhttps?\b", " "),
    (r"merchantibility", "merchantability"),
    (r"favour", "favor"),
    (r"acknowledgement", "acknowledgment"),
)
#: Texts whose spellings are brought together; in others they don't matter.
SPEAKS = "licen|copyright|warrant"
#: A line that is a notice: a copyright with a sign, a year, a placeholder or a name behind it, or the rights reserved.
COPYRIGHT = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:"
    r"(?i:copyright)\b[^\n]{0,40}?(?:\([cC]\)|©|\b(?:19|20)[0-9]{2}\b|<|\[|\{)[^\n]{0,160}"
    r"|Copyright(?: by)? [A-Z][^\n]{0,120}"
    r"|\([cC]\)[^\p{L}\p{N}\n]*(?:(?i:copyright)\b|(?:19|20)[0-9]{2}\b)[^\n]{0,160}|©[^\n]{0,160}"
    r"|(?i:all rights reserved)[^\p{L}\p{N}\n]*"
    r")$"
)
#: Numbers and letters of lists, at the start of a line or behind a sentence.
MARKS = r"(?m)(^[^\p{L}\p{N}\n]*|[:;.][ \t]+)\(?(?:[0-9]|[a-z]|iii?|iv)[.)][ \t]+"
NOISE = r"[^\p{L}\p{N}\n]+"
#: Words of titles in front of a licence text.
TITLE = (
    r"^(?:(?:the|mit|expat|x11|isc|bsd|zlib|libpng|boost|software|unlicense|license|version"
    r"|zero|two|three|[0-3]|clause|style|new|or|revised|simplified|modified|freebsd|original|open|source|august|17th|2003) )+"
)
#: Most rows of a caller's table of texts that are broadcast by hint.
SMALL = 10_000


def _form(text: Column) -> Column:
    """The canonical words of a text, with its line ends."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, " ")
    out = F.regexp_replace(out, MARKS, "$1 ")
    out = F.regexp_replace(F.lower(out), "&", " and ")
    out = F.regexp_replace(out, NOISE, " ")

    def spelt(words: Column) -> Column:
        out = words
        for pattern, form in SPELLINGS:
            out = F.regexp_replace(out, pattern, form.replace("\\1", "$1"))
        return F.when(words.rlike(SPEAKS), out).otherwise(words)

    return F.element_at(F.transform(F.array(out), spelt), 1)


def _line(line: Column) -> Column:
    """Words without the title in front of them."""
    # Possessive, which takes the same words: Java's plain repeat of alternatives recurses, and 1,500 "the" in a row overflow a task's stack.
    return F.regexp_replace(F.trim(line), TITLE + "+", "")


def _whole(form: Column) -> Column:
    return _line(F.regexp_replace(form, r"[ \n]+", " "))


def _sha(form: Column) -> Column:
    # Never null, so that no filter works it out once more.
    return F.coalesce(F.sha2(form.cast("binary"), 256), F.lit(""))


def _key(digest: Column) -> Column:
    """The first 60 bits of a digest: lines are many, and their digests in full would be most of what is written."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    return _whole(_form(text))


def digest(text: Column) -> Column:
    return _sha(canonical(text))


def known(spark: SparkSession, texts: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """``(digest, licence)`` of known texts: the given ones, or ``TEXTS`` and ``DIGESTS``.

    ``texts`` is a dictionary or a table ``(licence, text)``. Texts whose form is empty
    are left out; of licences with one form the first by name stays.
    """
    if isinstance(texts, DataFrame):
        rows = texts.select("licence", "text")
    else:
        rows = spark.createDataFrame(list((TEXTS if texts is None else texts).items()), "licence string, text string")
    rows = rows.select(digest(F.col("text")).alias("digest"), "licence").where(F.col("digest") != _sha(F.lit("")))
    if texts is None and DIGESTS:
        rows = rows.unionByName(spark.createDataFrame([(d, name) for name, d in DIGESTS.items()], "digest string, licence string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, *, texts: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, licence, notices)`` for each row of ``docs``; its other columns are left out.

    ``licence`` is the known text that the whole document is, else null; ``notices``
    the sorted distinct licences whose text is one of its lines. A null text counts as
    empty, and no known text is empty, so it has neither; the same holds for a text
    without letters and digits. Texts of any length and ties (licences of one form: the
    first by name) are fine. Rows that repeat stay, with equal results; an empty table gives an
    empty result. Columns of ``docs`` may have any names: only two are read.

    A dictionary is the caller's own and broadcast; so is a table of at most ``SMALL``
    different texts. A larger one is left to Spark's size checks.
    """
    spark = docs.sparkSession
    table = written(known(spark, texts), "licences")
    few = table.limit(SMALL + 1).count() <= SMALL
    hinted = F.broadcast(table) if few else table
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_tag"), _form(F.col(text_col)).alias("_form"))
    # Written: texts are read and brought to their form once.
    keys = F.array_distinct(F.transform(F.split("_form", "\n"), lambda x: _key(_sha(_line(x)))))
    own = written(own.select("_id", "_tag", _sha(_whole(F.col("_form"))).alias("digest"), keys.alias("_keys")), "forms")
    lines = own.select("_id", "_tag", F.explode("_keys").alias("_key")).join(hinted.select(_key(F.col("digest")).alias("_key"), "licence"), "_key")
    # Equal texts have equal notices, so the text's hash tells rows apart well enough, with the id to part
    # copies. Written: both sides of the join below are then plain, and Spark can split what is hot.
    notices = written(lines.groupBy("_id", "_tag").agg(F.array_sort(F.collect_set("licence")).alias("notices")), "notices")
    notices = notices.select(F.col("_id").alias("_of"), F.col("_tag").alias("_of_tag"), "notices")
    joined = own.join(hinted, "digest", "left").join(notices, (F.col("_tag") == F.col("_of_tag")) & F.col("_id").eqNullSafe(F.col("_of")), "left")
    return joined.select(F.col("_id").alias(id_col), "digest", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest and licence of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("notices", F.array_join("notices", ","))


def _sql_form(text: str) -> str:
    """The canonical words in DuckDB's words."""
    out = f"regexp_replace(coalesce({text}, ''), '{COPYRIGHT}', ' ', 'g')"
    out = f"regexp_replace({out}, '{MARKS}', '\\1 ', 'g')"
    out = f"regexp_replace(lower({out}), '&', ' and ', 'g')"
    out = f"regexp_replace({out}, '{NOISE}', ' ', 'g')"
    spelt = "words"
    for pattern, form in SPELLINGS:
        spelt = f"regexp_replace({spelt}, '{pattern}', '{form}', 'g')"
    return f"list_transform([{out}], lambda words: CASE WHEN regexp_matches(words, '{SPEAKS}') THEN {spelt} ELSE words END)[1]"


def _sql_line(line: str) -> str:
    return f"sha256(regexp_replace(trim({line}, ' '), '{TITLE}', ''))"


def _sql_whole(form: str) -> str:
    return _sql_line(f"regexp_replace({form}, '[ \\n]+', ' ', 'g')")


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEXTS.items())
    digests = "".join(f" UNION ALL SELECT {quoted(v)}, {quoted(k)}" for k, v in DIGESTS.items())
    return f"""
WITH texts(licence, t) AS (VALUES {values}),
named AS (SELECT {_sql_whole(_sql_form('t'))} AS digest, licence FROM texts{digests}),
known AS (SELECT digest, min(licence) AS licence FROM named GROUP BY 1),
formed AS (SELECT row_number() OVER () AS r, doc_id, {_sql_form('text')} AS form FROM documents),
lined AS (SELECT r, doc_id, form, {_sql_whole('form')} AS digest FROM formed),
found AS (
  SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT r, {_sql_line('line')} AS digest FROM (SELECT r, unnest(string_split(form, chr(10))) AS line FROM lined)) l JOIN known USING (digest)
  GROUP BY r
)
SELECT doc_id, digest, licence, coalesce(notices, '') AS notices
FROM lined LEFT JOIN known USING (digest) LEFT JOIN found USING (r)
"""


ORACLE = _oracle()
