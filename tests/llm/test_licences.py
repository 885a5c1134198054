"""op7: spellings, copyright lines and punctuation make no difference; other words do."""

from __future__ import annotations

import re
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skeinmill.llm import licences


def test_texts_and_notices(spark):
    mit = licences.KNOWN[0][2]
    varied = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "SUB LICENCE").replace(",", " ;") + "\n(c) nobody"
    rows = [
        (1, mit), (2, varied), (3, mit + "\nand more"), (4, "# MIT License\n\n" + mit.replace("\n\n", "\n")), (5, None), (6, ""), (7, "...\n"), (8, "prose\nlicensed under the Apache Licence version 2.0\nprose"),
        (9, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT license"), (9, "Released under the MIT License."), (None, mit), (10, "x " * 100_000), (11, "copyright 1999\n"),
    ]
    docs = spark.createDataFrame([(d, t, "clash", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, license string, digest int").repartition(3)
    for table_rows in (licences.TABLE_ROWS, 0):
        got = sorted(((str(r.doc_id), r.license, r.n_notices, r.notices) for r in licences.scan(docs, table_rows=table_rows).collect()), key=str)
        assert got == sorted(
            [
                ("1", "MIT", 0, ""), ("2", "MIT", 0, ""), ("3", None, 0, ""), ("4", "MIT", 0, ""), ("5", None, 0, ""), ("6", None, 0, ""), ("7", None, 0, ""), ("8", None, 1, "Apache-2.0"), ("9", None, 2, "CC-BY-NC-4.0,MIT"),
                ("9", None, 1, "MIT"), ("None", "MIT", 0, ""), ("10", None, 0, ""), ("11", None, 0, ""),
            ], key=str,
        )
    assert licences.scan(docs.limit(0)).count() == 0


def test_own_table(spark):
    known = licences.known_digests(spark, [("B", "text", "Do what you like"), ("A", "text", "do: WHAT you like!"), ("N", "notice", "Under N")])
    docs = spark.createDataFrame([(1, "do what you like"), (2, "a\nunder n.")], "doc_id long, text string")
    assert [(r.license, r.notices) for r in licences.scan(docs, known).orderBy("doc_id").collect()] == [("A", ""), (None, "N")]


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in re.split("\n\n+", text))


def test_wrapped_texts(spark):
    texts = {(i, n): t for n, (i, kind, t) in enumerate(licences.KNOWN + licences.COMMON) if kind == "text"}
    rows = [(w, i, f"Copyright (c) 2020, Some Body\n\n{wrapped(t, w)}\n") for (i, _), t in texts.items() for w in range(40, 100, 3)]
    rows.append((0, "ISC", "Copyright Jane Doe\n\n" + licences._ISC.replace("above copyright notice", "above\ncopyright notice")))
    assert any(re.search("(?m)^copyright notice", t) for _, i, t in rows if i == "ISC") and any(re.search("(?m)^COPYRIGHT HOLDERS", t) for _, i, t in rows if i == "MIT")
    docs = spark.createDataFrame([(n, t) for n, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licences.scan(docs).collect()}
    assert [got[n] for n in range(len(rows))] == [i for _, i, _ in rows]


def test_copyright_statements(spark):
    statements = ["Copyright (c) 2020 x", "copyright 1999", "Copyright © x", "# Copyright Jane Doe", "Copyright The Regents", "copyright by x", "Copyright [yyyy] [name]", "Copyright <YEAR> x", "COPYRIGHT JANE DOE", "copyright jane doe, 2001", "(c) nobody", "All rights reserved."]
    body = ["copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE", "copyright license to reproduce", "copyright owner", "Copyright treaty adopted on 20 December 1996", "copyrighted work", "copyright law"]
    kept = spark.createDataFrame(list(enumerate(statements + body)), "i int, x string").where(F.size(licences.canonical_lines(F.col("x"))) > 0).select("x").collect()
    assert {r.x for r in kept} == set(body)


def test_common_digests(spark):
    ids = {r.license for r in licences.known_digests(spark).where("kind = 'text'").collect()}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "MIT", "ISC"} <= ids


#: Files of this system that hold known texts, and the ids of these.
SYSTEM_TEXTS = {
    "Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only",
    "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only",
}


def test_whole_texts_hash_to_the_digests(spark):
    """Texts that the system has, as they are, in capitals, behind comment signs and with a statement of one's own, are found; with a word more they aren't."""
    texts = {i: path.read_text(errors="replace") for name, i in SYSTEM_TEXTS.items() if (path := Path("/usr/share/common-licenses") / name).is_file()}
    if not texts:
        pytest.skip("no license texts on this system")
    ways = [lambda x: x, lambda x: "Copyright (c) 2020 Some Body\n\n" + x, lambda x: "\n".join("# " + line for line in x.split("\n")), lambda x: x.replace(", ", " , ").replace("\n", "\r\n"), lambda x: x + "\nadded"]
    rows = [(k, w, i, way(x)) for k, (i, x) in enumerate(texts.items()) for w, way in enumerate(ways)]
    docs = spark.createDataFrame([(10 * k + w, x) for k, w, _, x in rows], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.license for r in licences.scan(docs).collect()}
    assert got == {10 * k + w: i if w < len(ways) - 1 else None for k, w, i, _ in rows}
    assert {i for i, _, _ in licences.COMMON_DIGESTS} >= set(texts)
