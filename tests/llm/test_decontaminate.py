"""op10 against a brute-force reading of its contract, both ways to the result."""

from __future__ import annotations

import hashlib
import re

import pytest

from skeinmill.llm import decontaminate as decontamination
from skeinmill.llm.decontaminate import decontaminate, without_hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= {x for x in wins[k] if x is not None}
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


BASE = [f"w{i}" for i in range(40)]
ITEMS = [(1, " ".join(BASE[:15])), (2, " ".join(BASE[5:20])), (3, "Tiny item"), (4, None), (5, "..."), (6, "été über"), (10, " ".join(BASE[:15])), (None, "ghost words here")]
DOCS = [
    (1, " ".join(BASE)), (2, None), (3, ""), (4, "a b c d TINY, item. x y"), (5, " ".join(BASE[2:11])), (6, "x " + " ".join(BASE[3:13]).upper() + " y"), (7, "ÉTÉ über"), (8, "été-über"),
    (9, "tiny " * 4000 + "item"), (9, "tiny item"), (None, "tiny item"), (11, "ghost words here"), (12, "same same " * 600), (13, "-- ,, ..."), (14, " ".join(BASE[:9] + ["q"] + BASE[9:20])),
]


@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
def test_equals_brute_force(spark, sent_bytes):
    docs = spark.createDataFrame([(a, b, "clash", i) for i, (a, b) in enumerate(DOCS)], "doc_id long, text string, key string, n_hit int").repartition(3)
    got = decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), sent_bytes=sent_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
def test_empty_tables_and_filter(spark, sent_bytes):
    docs = spark.createDataFrame(DOCS[:9], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none, sent_bytes=sent_bytes).where("contaminated").count() == 0
    assert decontaminate(docs.limit(0), none, sent_bytes=sent_bytes).count() == 0
    kept = without_hits(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), sent_bytes=sent_bytes)
    assert kept.columns == docs.columns
    dirty = {r[0] for r in brute(DOCS[:9], ITEMS) if r[5]}
    assert {r[0] for r in kept.collect()} == {d for d, _ in DOCS[:9]} - dirty


@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
def test_filter_tells_null_and_repeated_ids_apart(spark, sent_bytes):
    leak = " ".join(f"word{i}" for i in range(12))
    rows = [(None, leak), (None, "clean"), (1, leak), (1, "clean text"), (2, None), (None, None), (3, leak), (3, leak)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = without_hits(docs, items, sent_bytes=sent_bytes).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([r for r in rows if r[1] != leak], key=str)


def test_the_index_is_bounded_in_bytes(spark):
    """Its arrays take what the switch counts on for each window, and both ways agree where the switch lies."""
    rows = [(i % 700, " ".join(f"w{(i * 31 + j * j) % 5000}" for j in range(40))) for i in range(800)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    windows = decontamination.item_windows(items)
    n = windows.count()
    index = decontamination._Index(windows.toArrow(), 10, 5)
    held = sum(x.nbytes for part in (index.sizes, index.ptr, index.items) for x in part.values()) + index.prints.nbytes
    assert n > 20_000 and held <= 1.2 * decontamination.WINDOW_BYTES * n
    docs = spark.createDataFrame([(i, f"pre {x} post") for i, (_, x) in enumerate(rows[::40])] + [(99, "clean")], "doc_id long, text string")
    small, large = (sorted(map(tuple, decontaminate(docs, items, sent_bytes=b).collect())) for b in (n * decontamination.WINDOW_BYTES, n * decontamination.WINDOW_BYTES - 1))
    assert small == large and sum(r[5] for r in small) == 20
