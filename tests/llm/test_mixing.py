"""op8: counts against the plain Poisson quantile, order, weights, edge cases."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest

from skeinmill.llm import mixing, store


def quantile(u, mean):
    k, weight = 0, math.exp(-mean)
    total = weight
    while total <= u:
        k += 1
        weight *= mean / k
        total += weight
    return k


def count(doc_id, rate, seed=mixing.SEED):
    parts = max(1, math.ceil(rate / mixing.PART))
    key = "\0" if doc_id is None else str(doc_id)
    return sum(quantile(int(hashlib.md5(f"{seed}:{key}:{p}".encode()).hexdigest()[:13], 16) / 2**52, rate / parts) for p in range(1, parts + 1))


def rows():
    out = [(i, f"text {i}", "big" if i % 3 else f"s{i % 7}", "clash") for i in range(300)]
    return out + [(5, "again", "big", "x"), (None, "no id", "s1", "x"), (900, None, None, "x"), (901, "", "rare", "x"), (902, "long " * 50_000, "big", "x")]


@pytest.mark.parametrize("weights", [None, {"big": 1.0, "rare": 2.0, "s1": 0.0, "none": 5.0}, {"rare": 1.0}])
def test_counts_and_order(spark, weights):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, mix_copy string")
    n = Counter(r[2] for r in rows())
    live = {s: (1.0 if weights is None else weights[s]) for s in n if weights is None or weights.get(s, 0) > 0}
    rate = {s: w / sum(live.values()) * len(rows()) / n[s] for s, w in live.items()}
    want = Counter((d, s, c) for d, _, s, _ in rows() if s in rate for c in range(count(d, rate[s])))
    got = [(r.doc_id, r.source, r.mix_copy) for r in mixing.mix(docs, weights).collect()]
    assert Counter(got) == want
    assert got == [(r.doc_id, r.source, r.mix_copy) for r in mixing.mix(docs.repartition(7), weights, table_rows=0).collect()]
    assert mixing.mix(docs, weights).columns == ["doc_id", "text", "source", "mix_copy", "mix_copies"]


def test_shares_and_empty_table(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 4 = 0, 'a', 'b') as source")
    got = {r.source: r["count"] for r in mixing.mix(docs, {"a": 3.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(got["a"] / 15_000 - 1) < 0.03 and abs(got["b"] / 5_000 - 1) < 0.05
    assert mixing.mix(docs.limit(0)).count() == 0


def test_names_used_inside_may_be_a_documents_own(spark):
    own = ["_table", "_source", "_parts", "of", "parts", "quantiles", "row", "id", "place", "_place", "rate", "p", "u", "dotted.name"]
    docs = spark.createDataFrame([(i, "s", *[f"{c}{i}" for c in own]) for i in range(50)], ["doc_id", "source", *own])
    got = mixing.mix(docs).collect()
    assert mixing.mix(docs).columns == [*docs.columns, "mix_copy", "mix_copies"]
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in own)


def test_long_names_of_sources_are_not_sent(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "s" * (1 + 40 * (i % 2)), "t") for i in range(40)], "doc_id long, source string, text string")
    want = [(r.doc_id, r.mix_copy) for r in mixing.mix(docs).collect()]
    sources = docs.select("source").distinct()
    assert store.is_small(sources, 2, "source") and not store.is_small(sources, 1, "source")
    monkeypatch.setattr(store, "SENT_BYTES", 41)
    assert not store.is_small(sources, 2, "source") and store.is_small(sources.limit(0), 0, "source")
    assert [(r.doc_id, r.mix_copy) for r in mixing.mix(docs).collect()] == want
