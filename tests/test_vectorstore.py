"""Stored vector blocks and cells give what whole products give."""

from __future__ import annotations

import numpy as np
import pytest

from skeinmill.operators import retrieval, vectorstore

ROWS, QUERIES = "chunk_id string, pos long, embedding array<double>", "query_id long, embedding array<double>"


def clustered(seed, n, dim=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * spread


def want(asked, rows, k):
    scores = np.round(asked @ rows.T, 9)
    return [(q, f"c{c}", n + 1) for q in range(len(asked)) for n, c in enumerate(np.lexsort((np.arange(len(rows)), -scores[q]))[:k])]


@pytest.mark.parametrize("many", [0, 10**9])
@pytest.mark.parametrize("sent", [vectorstore.SENT_QUERIES, 0])
def test_search_equals_whole_products(spark, tmp_path, monkeypatch, many, sent):
    """With and without a first threshold, with queries sent or crossed in blocks, after several batches, ties included."""
    monkeypatch.setattr(vectorstore, "MANY_BLOCKS", many)
    monkeypatch.setattr(vectorstore, "SENT_QUERIES", sent)
    rows, asked = clustered(1, 400), clustered(2, 9)
    rows[17] = rows[3]
    rows[200] *= 4
    frame = spark.createDataFrame([(f"c{i}", i, v.tolist()) for i, v in enumerate(rows)] + [("none", 999, None)], ROWS).repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(99, None)], QUERIES)
    path = str(tmp_path / "store")
    for part in ("pos < 150", "pos >= 150", "pos < 150"):
        store = vectorstore.append(spark, path, frame.where(part), part, block=16)
    assert store.n == 400 and len(store.manifest["segments"]) == 2
    for k in (3, 500):
        got = sorted((r.query_id, r.chunk_id, r["rank"]) for r in vectorstore.search(queries, store, k).collect())
        assert got == sorted(want(asked, rows, k))
    if sent:
        row = vectorstore.met_blocks(queries, store, 3).first()
        assert 0 < row.met < row.pairs / 2


def test_empty_stores_and_bounds(spark, tmp_path):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    empty = vectorstore.append(spark, str(tmp_path / "s"), spark.createDataFrame([], ROWS), "none")
    assert empty.n == 0 and vectorstore.search(queries, empty, 3).count() == 0
    some = vectorstore.append(spark, str(tmp_path / "s"), spark.createDataFrame([("a", 0, [0.0, 0.0]), ("b", 1, [-1.0, 0.0])], ROWS), "two")
    assert [(r.chunk_id, r.score) for r in vectorstore.search(queries, some, 3).orderBy("rank").collect()] == [("a", 0.0), ("b", -1.0)]
    assert vectorstore.search(queries.limit(0), some, 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        vectorstore.search(queries, some, 0)


@pytest.mark.parametrize("group", [None, "kind"])
@pytest.mark.parametrize("scale", [False, True])
def test_cells_lose_no_pair(spark, monkeypatch, group, scale):
    """Vectors around a few directions, of one length or of many, in a hot kind and a rare one."""
    monkeypatch.setattr(vectorstore, "PIVOT_ROWS", 1)
    rows = clustered(3, 300)
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True) * (np.random.default_rng(4).uniform(0.5, 2, (300, 1)) if scale else 1)
    data = [(f"k{i:03d}", None if i == 5 else "hot" if i % 4 else "rare", v.tolist()) for i, v in enumerate(rows)] + [("null", "hot", None)]
    frame = spark.createDataFrame(data, "id string, kind string, v array<double>").repartition(4)
    dealt = vectorstore.in_cells(frame, frame, 0.9, "id", "v", group)
    assert dealt is not None and dealt[0].count() < 300 * 17
    pairs = [(a, b) for a, ka, x in data for b, kb, y in data if x and y and (not group or (ka == kb and ka)) and round(float(np.dot(x, y)), 9) > 0.9]
    got = [(r.a, r.b) for r in retrieval.similar_pairs(frame, frame, 0.9, "id", "v", group).collect()]
    assert sorted(got) == sorted(pairs) and len(pairs) > 1000
    assert sorted(r.b for r in retrieval.after_similar(frame, frame, 0.9, "id", "v", group).collect()) == sorted({b for a, b in pairs if a < b})


def test_cells_are_left_where_they_spare_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectorstore, "PIVOT_ROWS", 1)
    rows = np.random.default_rng(5).normal(size=(60, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>")
    assert vectorstore.in_cells(frame, frame, 0.1, "id", "v", None) is None and vectorstore.in_cells(frame, frame, -1.0, "id", "v", None) is None
