"""Retrieval, fusion, reranking and metrics on cases with known results."""

from __future__ import annotations

import math

import numpy as np
import pytest

from skeinmill.operators import metrics, retrieval
from skeinmill.plans import retrieving

TEXTS = [("c0", 0, "machine learning is fun"), ("c1", 1, "deep learning networks"), ("c2", 2, "cooking with fire"), ("c3", 3, None)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(TEXTS, "chunk_id string, pos int, text string")


def test_lexical_search(spark, chunks):
    queries = spark.createDataFrame([(1, "machine learning"), (2, "zebra"), (3, ""), (4, None), (5, "fire fire")], "query_id int, query string")
    got = {(r.query_id, r["rank"]): r for r in retrieval.bm25_top_k(queries, chunks, 5).collect()}
    assert got[1, 1].chunk_id == "c0" and not any(q in (2, 3, 4) for q, _ in got)
    one = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25_top_k(spark.createDataFrame([(5, "fire")], "query_id int, query string"), chunks, 5).collect()}
    assert got[5, 1].score == pytest.approx(2 * max(one.values()), abs=1e-6)


def test_lexical_search_survives_an_empty_corpus(spark, chunks):
    queries = spark.createDataFrame([(1, "a")], "query_id int, query string")
    assert retrieval.bm25_top_k(queries, chunks.limit(0), 5).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_dense_search_equals_numpy(spark, block):
    rng = np.random.default_rng(0)
    corpus, asked = rng.normal(size=(40, 8)), rng.normal(size=(5, 8))
    corpus[7] = corpus[3]
    docs = spark.createDataFrame([(f"c{i}", i, v.tolist()) for i, v in enumerate(corpus)], "chunk_id string, pos int, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, embedding array<double>")
    scores = np.round(asked @ corpus.T, 9)
    for k in (3, 100):
        got = sorted((r.query_id, r["rank"], r.chunk_id) for r in retrieval.dense_top_k(queries, docs, k, block).collect())
        want = [(q, n + 1, f"c{c}") for q in range(5) for n, c in enumerate(np.lexsort((np.arange(40), -scores[q]))[:k])]
        assert got == want
    assert retrieval.dense_top_k(queries, docs.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        retrieval.dense_top_k(queries, docs, 0)


def test_fusion_weights_and_ties(spark):
    arm = lambda ids: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, rank int")
    fused = [r.chunk_id for r in retrieval.reciprocal_rank_fusion([(arm(["a", "b"]), 10.0), (arm(["c", "b"]), 0.1)]).orderBy("rank").collect()]
    assert fused == ["b", "a", "c"] or fused == ["a", "b", "c"]
    tied = [r.chunk_id for r in retrieval.reciprocal_rank_fusion([(arm(["x"]), 1.0), (arm(["y"]), 1.0)]).orderBy("rank").collect()]
    assert tied == ["x", "y"]
    assert retrieval.reciprocal_rank_fusion([(arm(["x"]).limit(0), 1.0)]).count() == 0
    with pytest.raises(ValueError, match="no arms"):
        retrieval.reciprocal_rank_fusion([])


def test_hybrid_and_pluggable_reranker(spark, chunks):
    docs = retrieval.embed(chunks, "text")
    queries = retrieval.embed(spark.createDataFrame([(1, "machine learning")], "query_id int, query string"), "query")
    plain = retrieval.hybrid(queries, docs, 2).orderBy("rank").collect()
    assert plain[0].chunk_id == "c0" and len(plain) == 2 and plain[0].score < 0.1
    ranked = retrieval.hybrid(queries, docs, 1, 3, reranked=True, scorer=lambda q, t: 1.0 if t and "cooking" in t else 0.0).collect()
    assert ranked[0].score in (0.0, 1.0) and len(ranked) == 1
    lexical = retrieval.hybrid(queries, docs, 1, 3, reranked=True).collect()
    assert (lexical[0].chunk_id, lexical[0].score) == ("c0", 1.0)


def judged(spark, items, relevant, ks):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    ranked = metrics.dedupe(spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(items)], "query_id int, doc_id string, rank int"))
    rel = spark.createDataFrame([(1, d) for d in relevant], "query_id int, doc_id string")
    return {r.query_id: r.asDict() for r in metrics.per_query(queries, ranked, rel, ks).collect()}


def test_metrics(spark):
    one = judged(spark, ["a", "b", "c", "d"], ["a", "c"], [0, 3, 4])
    assert one[1]["precision_at_4"] == 0.5 and one[1]["precision_at_0"] == 0 and one[1]["recall_at_4"] == 1 and one[1]["mrr"] == 1
    assert one[1]["ndcg_at_3"] == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert one[2]["mrr"] == 0 and one[2]["recall_at_3"] == 0
    assert judged(spark, ["a", "b", "c"], ["a", "d"], [3])[1]["recall_at_3"] == 0.5
    assert judged(spark, ["x", "a"], ["a"], [3])[1]["mrr"] == 0.5
    assert judged(spark, ["a", "a", "a", "b"], ["a"], [4])[1]["recall_at_4"] == 1


def test_prefix_relevance_means_and_delta(spark):
    queries = spark.createDataFrame([(1, ["trainer", "quant"]), (2, [])], "query_id int, prefixes array<string>")
    docs = spark.createDataFrame([("trainer.md",), ("trainer/x",), ("quantization",), ("other",)], "doc_id string")
    assert metrics.relevant_by_prefix(queries, docs).count() == 3
    tidy = metrics.means(spark.createDataFrame([(1, 1.0), (2, 0.0)], "query_id int, mrr double"))
    assert [(r.metric, r.value, r.n) for r in tidy.collect()] == [("mrr", 0.5, 2)]
    base = spark.createDataFrame([("mrr", 0.25), ("gone", 1.0)], "metric string, value double")
    rows = metrics.delta(tidy, base, ["metric"])
    assert [r.line for r in metrics.delta_lines(rows, ["metric"]).collect()] == ["| mrr | 0.500 | +0.250 |"]


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 6)] + [("b", 42.0), ("c", None)], "k string, v double")
    got = {r.k: r for r in metrics.percentiles(rows, "v", ["k"]).collect()}
    assert got["a"].p50 == 3 and got["b"].p99 == 42 and (got["c"].p50, got["c"].n) == (0, 0)
    assert metrics.percentiles(rows.limit(0), "v").first().p95 == 0


@pytest.mark.parametrize("values, splits", [(100_000, 1000), (40, 5), (1, 2)])
def test_percentiles_of_large_groups_are_selected(spark, monkeypatch, values, splits):
    """Spread, skewed, of two values, of one, negative, infinite: by selection as by sorting, with nulls and a null group."""
    monkeypatch.setattr(metrics, "GROUP_VALUES", values)
    monkeypatch.setattr(metrics, "SPLITS", splits)
    rng = np.random.default_rng(8)
    groups = {"even": rng.uniform(-5, 5, 700), "skew": np.exp(rng.normal(size=500) * 20), "two": np.repeat([0.0, 1.0], 250), "one": np.full(300, 7.25), "few": rng.normal(size=3), "tied": rng.integers(0, 4, 400) * 1.0, None: rng.normal(size=200)}
    groups["edge"] = np.concatenate([rng.normal(size=100), [np.inf, -np.inf] * 30])
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for by in (["k"], None):
        got = metrics.percentiles(frame, "v", by).collect()
        for r in got:
            own = np.sort(groups.get(r["k"], np.zeros(0)) if by else np.concatenate(list(groups.values())))
            assert r.n == len(own)
            for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                place = p * (len(own) - 1)
                a, b = (own[int(place)], own[min(int(place) + 1, len(own) - 1)]) if len(own) else (0.0, 0.0)
                want = a if a == b else a + (b - a) * (place - int(place))
                assert r[name] == want or r[name] == pytest.approx(round(float(want), 2), abs=0.011, rel=1e-12)
        assert len(got) == (len(groups) + 1 if by else 1)


def test_repartitioning_changes_nothing(spark, chunks):
    queries = spark.createDataFrame([(1, "learning fire machine")], "query_id int, query string")
    runs = [[tuple(r) for r in retrieval.bm25_top_k(queries, chunks.repartition(n), 3).orderBy("rank").collect()] for n in (1, 2, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_models_are_loaded_in_tasks(spark, chunks):
    got = retrieval.embed(chunks, "text", load=lambda: lambda texts: [[float(len(t or ""))] for t in texts]).orderBy("pos").collect()
    assert [r.embedding for r in got] == [[float(len(t or ""))] for _, _, t in TEXTS]
    pool = spark.createDataFrame([(1, "q", "a", "x", 1), (1, "q", "b", "yy", 2)], "query_id int, query string, chunk_id string, text string, rank int")
    assert [r.chunk_id for r in retrieval.rerank(pool, 2, load=lambda: lambda q, t: len(t)).orderBy("rank").collect()] == ["b", "a"]


def test_a_batch_scorer_is_called_once_for_many_pairs(spark, tmp_path):
    """Pairs of all queries share batches of like length; each pair is scored once, and scores are those of pairs."""
    pool = spark.createDataFrame([(q, f"ask w{q}", f"c{c}", f"w{c} " * (1 + (7 * c) % 13) + "ask", c + 1) for q in range(6) for c in range(10)], "query_id int, query string, chunk_id string, text string, rank int").repartition(2)
    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        def score(pairs):
            import uuid

            lengths = [len(q) + len(t) for q, t in pairs]
            (calls / uuid.uuid4().hex).write_text(f"{len(pairs)} {lengths == sorted(lengths)}")
            return retrieval.overlap_batch(pairs)

        return score

    got = sorted(map(tuple, retrieval.rerank(pool, 4, load=load, batch=16).collect()))
    assert got == sorted(map(tuple, retrieval.rerank(pool, 4).collect()))
    told = [p.read_text().split() for p in calls.iterdir()]
    assert sum(int(n) for n, _ in told) == 60 and all(ok == "True" for _, ok in told) and len(told) <= 2 * 3
    assert retrieval.overlap_batch([("", "a"), (None, None), ("a B", "b")]) == [0.0, 0.0, 0.5]
    with pytest.raises(ValueError, match="scores for"):
        retrieval.batched_scores(lambda pairs: [1.0], ["a", "b"], ["c", "d"], 2)


def test_similar_pairs_within_a_type_are_whole(spark, tmp_path):
    rng = np.random.default_rng(6)
    vectors, labels = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    spark.createDataFrame([(i, int(labels[i]), vectors[i].tolist()) for i in range(60)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r.sim for r in retrieving.cosine_within_type(spark, str(tmp_path)).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(i, j): unit[i] @ unit[j] for i in range(60) for j in range(i + 1, 60) if labels[i] == labels[j] and unit[i] @ unit[j] > retrieving.SIMILAR}
    assert got.keys() == want.keys() and any(a % 10 for a, _ in want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)


@pytest.mark.parametrize("group", [None, "kind"])
@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
def test_similar_rows_by_small_blocks(spark, monkeypatch, group, sent_bytes):
    """However blocks are cut, dealt and sent, pairs and rows after a similar one are those of plain loops."""
    monkeypatch.setattr(retrieval, "SENT_BYTES", sent_bytes)
    monkeypatch.setattr(retrieval, "MEETING_BLOCKS", 3)
    rng = np.random.default_rng(5)
    data = [(f"k{i}", "hot" if i % 4 else "rare", v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))]
    left, right = (spark.createDataFrame(part, "id string, kind string, v array<double>").repartition(3) for part in (data, data[20:]))
    want = {(a, b) for a, ka, x in data for b, kb, y in data[20:] if (ka == kb or not group) and round(float(np.dot(x, y)), 9) > 1}
    got = [(r.a, r.b) for r in retrieval.similar_pairs(left, right, 1, "id", "v", group, 4).collect()]
    assert sorted(got) == sorted(want)
    assert sorted(r.b for r in retrieval.after_similar(left, right, 1, "id", "v", group, 4).collect()) == sorted({b for a, b in want if a < b})
