"""License scans by canonical digest lookup, with built-in functions only.

Texts are made canonical line by line: A-Z lower-cased, copyright statements dropped, equivalent spellings
made one, punctuation and spacing reduced to single spaces. The digest of a whole canonical text, and of
each of its lines, is looked up by hash join in a table of digests of known texts and notices. The table
is sent to every task if it has at most `table_rows` rows of 32 MiB, which are counted, else joined by a shuffle.

Defined results: a null, empty or wholly unlike text has license null and no notices; equal known texts
give the least id; a line counts once for each text; extra columns are left out; rows with equal texts get
equal results, whatever their doc_id is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.llm.store import is_small, keep

TABLE_ROWS = 100_000

#: Pairs of spellings that license matching treats as equal (the second is kept).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"), ("sub license", "sublicense"), ("noncommercial", "non commercial"), ("non infringement", "noninfringement"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Fixed values: (license id, kind, text) of known whole texts and of notices.
KNOWN = [
    ("MIT", "text", _MIT), ("MIT", "text", "MIT License\n\n" + _MIT), ("MIT", "text", "The MIT License (MIT)\n\n" + _MIT), ("ISC", "text", _ISC), ("ISC", "text", "ISC License\n\n" + _ISC),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."), ("MIT", "notice", "Released under the MIT License."), ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3"), ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "notice", "Released into the public domain under CC0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"), ("MIT", "notice", "SPDX-License-Identifier: MIT"), ("BSD-3-Clause", "notice", "SPDX-License-Identifier: BSD-3-Clause"), ("GPL-3.0-only", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
]


_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = [
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD2, _BSD3 = ("\n\n".join([_BSD_HEAD, *_BSD_CLAUSES[:n], _BSD_TAIL]) for n in (2, 3))

#: Further whole texts, besides those that the SQL knows.
COMMON = [
    ("BSD-2-Clause", "text", _BSD2), ("BSD-2-Clause", "text", "BSD 2-Clause License\n\n" + _BSD2), ("BSD-3-Clause", "text", _BSD3), ("BSD-3-Clause", "text", "BSD 3-Clause License\n\n" + _BSD3),
]
#: Digests of further whole texts, which are too long to be kept here.
COMMON_DIGESTS = [
    ("Apache-2.0", "text", "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0"),
    ("CC0-1.0", "text", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GPL-1.0-only", "text", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0-only", "text", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0-only", "text", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0-only", "text", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "text", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "text", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "text", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "text", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("GFDL-1.2-only", "text", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3-only", "text", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
]

#: Words after "copyright" that make it a part of a sentence.
_PROSE = r"(?:notices?|holders?|owners?|licen[sc]e[sd]?|laws?|statements?|interests?|protection|treat(?:y|ies)|acts?|rights?|information|disclaimers?|infringement|and|or|in|to|of|on|is|are|as|for|if|with|under|that|which|may|shall|will|conditions?)\b"
_COPYRIGHT = (
    r"^(?i:\(c\)|©|all rights reserved|copyright[\s:,]*(?:\(c\)|©|&copy;|by\b|[<\[{(]?(?:year|yyyy|[0-9]{4})|(?!" + _PROSE + r")[^0-9]*\b(?:19|20)[0-9]{2}\b))"
    r"|^(?:Copyright|COPYRIGHT)[\s:,]+(?:[Tt]he\s+)?(?!(?i:" + _PROSE + r"))\p{Lu}"
)


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that have a word, copyright statements left out."""
    lines = F.filter(F.transform(F.split(text, "[\r\n]+", -1), lambda x: F.regexp_replace(x, r"^[ \t#*/;-]+", "")), lambda x: ~x.rlike(_COPYRIGHT))
    lower = F.transform(lines, lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    bare = F.transform(lower, lambda x: F.trim(F.regexp_replace(x, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")))
    return F.filter(F.transform(bare, _respelled), lambda x: x != "")


def _whole(lines: Column) -> Column:
    """The canonical text: spellings of several words are also made one where a line ends within them."""
    out = F.concat(F.lit(" "), F.array_join(lines, " "), F.lit(" "))
    for old, new in SPELLINGS:
        if " " in old:
            out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.substring(out, 2, F.greatest(F.length(out) - 2, F.lit(0)))


def _respelled(x: Column) -> Column:
    pattern = "|".join(sorted({old for old, _ in SPELLINGS}, key=lambda s: (-len(s), s)))
    out = F.concat(F.lit(" "), x, F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.when(x.rlike(rf"(^| )({pattern})( |$)"), F.trim(out)).otherwise(x)


def _digest(x: Column) -> Column:
    return F.sha2(x, 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] | DataFrame | None = None) -> DataFrame:
    """(digest, kind, license) of known texts, one for each kind and digest."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(KNOWN + COMMON if known is None else known, "license string, kind string, text string")
    rows = rows.select("license", "kind", _digest(_whole(canonical_lines(F.col("text")))).alias("digest"))
    if known is None:
        rows = rows.unionByName(spark.createDataFrame(COMMON_DIGESTS, "license string, kind string, digest string"))
    return rows.groupBy("digest", "kind").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, digest, license (of the whole text), n_notices, notices (ids of known lines, sorted) for each row of docs."""
    known = known_digests(docs.sparkSession) if known is None else known
    few = is_small(known, table_rows, "digest", "license")
    whole, notices = (known.where(F.col("kind") == k).select("digest", "license") for k in ("text", "notice"))
    send = F.broadcast if few else (lambda x: x)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("cls"), canonical_lines(text).alias("lines"))
    found = keep(lines.select("doc_id", "cls", _digest(_whole(F.col("lines"))).alias("digest"), F.transform(F.array_distinct("lines"), lambda x: F.unhex(F.substring(_digest(x), 1, 32))).alias("marks")), "licence-digests")
    short = notices.select(F.unhex(F.substring("digest", 1, 32)).alias("mark"), F.col("license").alias("notice"))
    hits = found.select("cls", F.explode("marks").alias("mark")).join(send(short), "mark").groupBy("cls", "notice").agg(F.count_distinct("mark").alias("n"))
    hits = hits.groupBy("cls").agg(F.sum("n").alias("n_notices"), F.array_join(F.sort_array(F.collect_list("notice")), ",").alias("notices"))
    rows = found.drop("marks").join(send(whole), "digest", "left").join(hits, "cls", "left")
    return rows.select("doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(i)}, {quoted(k)}, {quoted(t)})" for i, k, t in KNOWN)
    spell = "(' ' || x || ' ')"
    for old, new in SPELLINGS:
        spell = f"replace({spell}, ' {old} ', ' {new} ')"
    lines = (
        "list_filter(list_transform(list_transform(list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\r\\n]+'), "
        "lambda x: regexp_replace(x, '^[ \\t#*/;-]+', '')), lambda x: NOT regexp_matches(x, '^(copyright|\\(c\\)|©|all rights reserved)')), "
        "lambda x: trim(regexp_replace(x, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))), lambda x: trim(" + spell + ")), lambda x: x <> '')"
    )
    return f"""
WITH k AS (SELECT sha256(array_to_string({lines}, ' ')) AS digest, kind, min(license) AS license FROM (VALUES {values}) t(license, kind, text) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rn, doc_id, {lines} AS lines FROM documents),
m AS (SELECT rn, sha256(line) AS digest FROM (SELECT DISTINCT rn, unnest(lines) AS line FROM d)),
h AS (SELECT rn, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM m JOIN k ON k.digest = m.digest AND kind = 'notice' GROUP BY rn)
SELECT d.doc_id, sha256(array_to_string(lines, ' ')) AS digest, k.license, coalesce(h.n, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN k ON k.digest = sha256(array_to_string(lines, ' ')) AND kind = 'text' LEFT JOIN h USING (rn)"""


ORACLE = _oracle()
