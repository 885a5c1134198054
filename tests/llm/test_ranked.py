"""Ranks equal a plain restatement, by both ways."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skeinmill.llm import ranked

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _cut(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k=10):
    """The rows of a definition read off the contract, a document and an item at a time."""
    texts = [(doc_id, Counter(words), len(words)) for doc_id, text in docs if (words := _cut(text))]
    n_docs, n_words = len(texts), sum(n for _, _, n in texts)
    df = Counter(term for _, terms, _ in texts for term in terms)
    asked: dict = {}
    for item_id, text in items:
        asked.setdefault(item_id, []).extend(_cut(text))
    out = []
    for item_id, words in asked.items():
        found = []
        for doc_id, terms, n in texts:
            m = 100 - 75 + (75 * n * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * terms[t]) // (1000 * terms[t] + 8 * m)) for t in words if t in terms)
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(found[:k], 1)]
    return out


def _same(frame, want):
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want, key=repr)


def _tables(seed: int):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Été", "ÀB", "x1", "日本", "THE", "the"]
    text = lambda n: " ".join(draw.choices(words, weights=range(1, len(words) + 1), k=n)) + draw.choice(["", ".", "-the", "\n"])
    docs = [(draw.choice([None, *range(200)]), draw.choice([text(draw.randint(1, 40)), "same the words", None, "", " ,.;"])) for _ in range(300)]
    items = [(draw.choice([None, *range(12)]), draw.choice([text(draw.randint(1, 8)), None, "", "nowhere", "the the x1"])) for _ in range(25)]
    return docs, items


@pytest.mark.parametrize("sent_bytes", [ranked.SENT_BYTES, 0])
def test_ranks_equal_the_definition(spark, sent_bytes, monkeypatch):
    monkeypatch.setattr(ranked, "ENTRIES", 40)
    docs, items = _tables(3)
    frames = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", ranked.F.lit(1)).repartition(5), spark.createDataFrame(items, "item_id long, text string").withColumn("term", ranked.F.lit("x"))
    _same(ranked.ranked(*frames, sent_bytes=sent_bytes), plain(docs, items))
    _same(ranked.ranked(*frames, k=3, sent_bytes=sent_bytes), plain(docs, items, 3))


@pytest.mark.parametrize("sent_bytes", [ranked.SENT_BYTES, 0])
def test_ties_repeats_and_a_long_text(spark, sent_bytes):
    docs = [(d, "alpha beta") for d in (5, 3, 3, 9, None, 1)] + [(50, "gamma " * 60_000 + "alpha")] + [(k, f"other{k}") for k in range(100, 130)]
    items = [(1, "alpha alpha"), (2, "gamma"), (3, "beta ALPHA")]
    got = ranked.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), sent_bytes=sent_bytes)
    _same(got, plain(docs, items))
    assert [r["doc_id"] for r in got.where("item_id = 1").orderBy("rank").collect()] == [1, 3, 3, 5, 9, None, 50]


@pytest.mark.parametrize("sent_bytes", [ranked.SENT_BYTES, 0])
def test_empty_tables(spark, sent_bytes):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for some in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", ranked.F.lit(None)), items), (docs, items.withColumn("text", ranked.F.lit("  ")))):
        assert ranked.ranked(*some, sent_bytes=sent_bytes).count() == 0
    with pytest.raises(ValueError):
        ranked.ranked(docs, items, 0)


def test_radix_order_is_stable_over_many_bits():
    draw = np.random.default_rng(1)
    for top in (2, 1 << 16, 1 << 20, 1 << 40):
        keys = draw.integers(0, top, 5000)
        assert (ranked.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    keys, sums = ranked.summed(np.array([5, 1, 5, 1 << 33]), np.array([1, 2, 3, 4]))
    assert keys.tolist() == [1, 5, 1 << 33] and sums.tolist() == [2, 4, 4]
