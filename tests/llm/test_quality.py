"""op6: counts against brute force, the forest's verdicts on made documents."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from skeinmill.llm import quality as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    triples, hit = {}, set()
    for i in range(len(w) - 2):
        triples.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in triples.values():
        if len(at) > 1:
            hit |= {i + j for i in at for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def texts():
    rng = random.Random(2)
    parts = ["word", "é😀", " ", " ", "\n", "\n\n", "# ", "a|b", "same line\n", "same line", "\t", "\x0b", "x y z ", " ", "<>&"]
    return [None, "", "\n", " ", "a\nb\na\n a\na", "x y z x y z", "\n\n\na\na", "same\n" * 5000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 200))) for _ in range(150)]


def test_counts_equal_brute_force(spark):
    rows = [(None if i == 5 else i, x, 1) for i, x in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, n_words int").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.quality(docs, None).collect())
    assert got == sorted((str(d), *brute(x)) for d, x, _ in rows + rows[:3])
    assert all(r.kept != r.base_failed for r in q.quality(docs, None).collect())
    assert q.quality(docs.limit(0), None).count() == 0


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        good = i % 8 > 0
        text = " ".join(x + rng.choice(["", "", "", "."]) for x in w) if good else (" | ".join(w) if i % 16 else " ".join(x + "###" for x in w))
        rows.append((i, text, int(good)))
    return rows


def test_forest_tells_junk_from_text(spark):
    rows = made(600, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.where("doc_id < 300").selectExpr("doc_id", "quality").union(spark.createDataFrame([(None, 1), (9999, 0), (5, None)], "doc_id long, quality int"))
    forest = q.fit(docs, labels)
    got = {r.doc_id: r for r in q.quality(docs, forest).collect()}
    fresh = [(got[d].kept, g) for d, _, g in rows if d >= 300]
    kept, junk_kept = ([k for k, g in fresh if g == want] for want in (1, 0))
    assert sum(kept) >= 0.97 * len(kept) and sum(junk_kept) <= 0.1 * len(junk_kept)
    assert all(0 <= r.anomaly <= 1 for r in got.values())
    again = q.fit(docs.repartition(7), labels)
    assert again.threshold == forest.threshold
    assert q.fit(docs, labels.where("quality = 1")) is None and q.fit(docs.limit(0), labels) is None


def plain_ratios(text):
    n_words, chars, symbols, dup, repeats, _ = brute(text)
    text = text or ""
    count = lambda chars_: sum(text.count(c) for c in chars_) / max(chars, 1)
    return [chars / max(n_words, 1), symbols / max(chars, 1), dup / max(n_words, 1), repeats / max(n_words, 1), count("|"), count("!?"), count(".,;:")]


def plain_score(forest, row):
    """Walks each tree from its first node, row by row."""
    row = [(min(v - lo, 0) + max(v - hi, 0)) / max(hi - lo, 1e-9) for v, lo, hi in zip(row, forest.low, forest.high, strict=True)]
    paths = []
    for feature, cut, left, path in forest.trees:
        at = 0
        while feature[at] >= 0:
            at = left[at] + (row[feature[at]] > cut[at])
        paths.append(path[at])
    n = forest.size
    usual = 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return 2 ** (-sum(paths) / len(paths) / usual)


def test_scores_equal_brute_force(spark):
    rows = made(300, 4) + [(1000 + i, x, None) for i, x in enumerate(texts())]
    ratios = q.statistics(pa.array([x for _, x, _ in rows]))[1]
    assert np.allclose(ratios, [plain_ratios(x) for _, x, _ in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    forest = q.fit(docs, docs)
    got = {r.doc_id: r.anomaly for r in q.quality(docs, forest).collect()}
    for d, x, _ in rows:
        assert abs(got[d] - plain_score(forest, plain_ratios(x))) < 1e-9
    # A tree keeps every row of its sample in exactly one leaf, and leaves' rows make its paths.
    assert all((path[feature < 0] > 0).all() for feature, _, _, path in forest.trees)


def test_a_repeated_doc_id_counts_once(spark):
    rows = made(200, 5)
    docs = spark.createDataFrame([(d, x) for d, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int")
    again = docs.where("doc_id in (3, 8)")
    for _ in range(6):
        again = again.union(again)
    one, many = q.fit(docs, labels), q.fit(docs.union(again), labels)
    assert one.threshold == many.threshold and (one.low == many.low).all()
