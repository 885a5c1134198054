"""op9 against brute force, at its own window and at small ones."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skeinmill.llm import grams as g
from skeinmill.llm.repeats import levels, remove_repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    words = [WORD.findall(x or "") for _, x in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(60)}"
    passages = [[word() for _ in range(rng.randrange(max(1, window - 3), 3 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            at = rng.randrange(0, len(p))
            w += rng.choice([p, p, p[at:], [word() for _ in range(rng.randrange(1, 2 * window))]])
        rows.append((rng.randrange(80), rng.choice([" ", "\n", "  "]).join(w)))
    copies = [(d + 100, x) for d, x in rng.sample(rows, 10)] + rng.sample(rows, 4)
    return rows + copies + [(None, " ".join(passages[0] * 2)), (500, None), (501, ""), (502, "é " * (window + 2)), (3, "é " * (window + 1)), (503, "same " * 4000), (504, "same " * 3000 + "end")]


@pytest.mark.parametrize(("window", "first"), [(50, 25), (6, 3), (9, 2), (2, 25), (20, 25)])
def test_equals_brute_force(spark, window, first):
    rows = corpus(window, window)
    docs = spark.createDataFrame([(d, x, i, "clash") for i, (d, x) in enumerate(rows)], "doc_id long, text string, n_words int, key string").repartition(4)
    got = remove_repeats(docs, window, first).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, window)


def test_levels_and_empty_tables(spark):
    assert levels(50, 25) == [25, 50] and levels(200, 25) == [25, 50, 100, 200] and levels(20, 25) == [10, 20]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="two words"):
        levels(1, 1)


def test_joined_words():
    rng = random.Random(2)
    texts = ["", " ", None, "one", " one  two\n", "é\t😀 x"] + ["".join(rng.choice(["a", "bc", " ", "\n", "\x0b", "é"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    words = g.words_of(pa.array(texts))
    assert words.joined() == [" ".join(WORD.findall(x or "")).encode() for x in texts]
    keep, want, at = np.array([rng.random() < 0.6 for _ in range(len(words.starts))]), [], 0
    for x in texts:
        own = WORD.findall(x or "")
        want.append(" ".join(w for w, k in zip(own, keep[at : at + len(own)], strict=True) if k).encode())
        at += len(own)
    assert words.joined(keep) == want
