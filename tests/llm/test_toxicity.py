"""op5: held-out accuracy on made documents, what scores may depend on, edge cases."""

from __future__ import annotations

import binascii
import random
import time

import numpy as np
import pyarrow as pa

from skeinmill.llm import toxicity as t


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    bad = {"en": ["grotto", "Blaggard!", "zounds"], "fr": ["véju" + s for s in ("er", "ra", "té", "ment")]}
    rows = []
    for i in range(n):
        lang = "fr" if i % 3 == 0 else "en"
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad[lang]))
        rows.append((i, " ".join(w), lang, f"src{i % 4}", toxic))
    return rows


def test_held_out_accuracy_and_independence(spark):
    rows = made(1500, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int").drop("toxic")
    labels = spark.createDataFrame([(d, x) for d, *_, x in rows] + [(None, 1), (10**6, 1), (1, None)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    got = {r.doc_id: r for r in t.toxicity(docs, model).collect()}
    for d, *_ in rows[:50]:
        assert got[d].held_out == (binascii.crc32(str(d).encode()) % 3 == 1)
    held = [(got[d].predicted, x) for d, *_, x in rows if got[d].held_out]
    assert sum(p == x for p, x in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    # Labels of held-out rows change nothing, nor do lang, source and doc_id.
    flipped = t.fit(docs, labels.withColumn("toxic", t.F.when(t.held_out(t.F.col("doc_id")), 1 - t.F.col("toxic")).otherwise(t.F.col("toxic"))))
    assert (flipped.table == model.table).all() and flipped.scale == model.scale
    moved = docs.selectExpr("doc_id + 10000 as doc_id", "text", "'xx' as lang", "'yy' as source", "1 as score")
    assert all(abs(got[r.doc_id - 10000].score - r.score) < 1e-6 for r in t.toxicity(moved, model).collect())
    clean = t.without_toxic(docs, model)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, r in got.items() if not r.rejected}


def test_edges(spark):
    rows = made(400, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int")
    model = t.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "word"), (5, "a " * 50_000), (5, "a " * 50_000), (6, "grotto " * 20_000)], "doc_id long, text string")
    got = t.toxicity(odd, model).collect()
    assert len(got) == 7 and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in got if r.doc_id == 5}) == 1
    assert not next(r for r in got if r.doc_id is None).held_out
    assert t.toxicity(odd.limit(0), model).count() == 0
    assert t.fit(docs.drop("toxic"), docs.selectExpr("doc_id", "0 as toxic")) is None
    assert {r.score for r in t.toxicity(odd, None).collect()} == {0.0}


def plain_logit(model, words):
    """The classifier word by word: sums of embeddings, filters at each place, the greatest answers, the logistic layer."""
    hidden, at = [], 0
    vectors = [sum(model.table[i] for i in w) for w in words] + [np.zeros(t.DIM)] * t._PAD
    for width in t.WIDTHS:
        for f in range(t.FILTERS):
            answers = [sum(vectors[p + j] @ model.taps[:, at + j * t.FILTERS + f] for j in range(width)) for p in range(len(vectors) - width + 1)]
            hidden.append(max(max(answers) + model.bias[len(hidden)], 0))
        at += width * t.FILTERS
    return float(np.dot(hidden, model.out) + model.shift)


def test_scores_equal_brute_force():
    rows = made(60, 5)
    texts = pa.array([r[1] for r in rows] + ["", None, "one", "A b; C d"])
    docs = t._split(*t.word_ids(texts))
    model = t.train(list(zip(docs, [r[4] for r in rows], strict=False)))
    want = [plain_logit(model, d) for d in docs]
    assert np.allclose(model.logits(docs), want, atol=1e-3) and np.allclose(model.logits_in_pieces(docs), want, atol=1e-3)
    assert np.allclose([model.scores(texts.slice(i, 1))[0] for i in range(len(texts))], 1 / (1 + np.exp(-np.array(want))), atol=1e-3)


def test_gradients_equal_differences(monkeypatch):
    rows = made(12, 6)
    docs, y = t._split(*t.word_ids(pa.array([r[1] for r in rows]))), np.array([r[4] for r in rows], float)
    model = t.train(list(zip(docs, y.astype(int), strict=True)))
    for name in ("table", "taps", "bias", "out"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    loss = lambda: float(np.mean(np.logaddexp(0, x := model.logits(docs)) - y * x))
    grads, shift, used, total = t.gradients(model, docs, y)
    for name in ("taps", "bias", "out"):
        value = getattr(model, name)
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 40)]:
            keep, each = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = keep + step
                each.append(loss())
            value[at] = keep
            assert abs((each[0] - each[1]) / 2e-5 - grads[name][at]) < 1e-4
    for i in range(0, len(used), max(1, len(used) // 20)):
        if used[i] < t._TABLES * t.BUCKETS:
            each = []
            for step in (1e-5, -2e-5):
                model.table[used[i], 0] += step
                each.append(loss())
            model.table[used[i], 0] += 1e-5
            assert abs((each[0] - each[1]) / 2e-5 - total[i, 0]) < 1e-4


def test_long_and_repeated_labelled_rows(spark):
    rows = made(300, 7)
    long = [(1000 + i, ("padding words here " * 3000) + ("grotto zounds" if i % 2 else "")) for i in range(6)]
    docs = spark.createDataFrame([(d, x) for d, x, *_ in rows] + long + [(7, rows[7][1])] * 500 + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, x) for d, *_, x in rows] + [(d, i % 2) for i, (d, _) in enumerate(long)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    # No text is too long to be learned from, and what a table repeats counts once.
    again = t.fit(docs.dropDuplicates(["doc_id", "text"]), labels)
    without = t.fit(docs.where("doc_id < 1000"), labels)
    assert (again.table == model.table).all() and not (without.table == model.table).all()
    assert t.fit(docs, labels, sample_words=4) is None


def test_a_row_beyond_the_bound_is_left_out_alone(spark):
    """The row of least hash is longer than the whole bound; the sample goes on without it."""
    rows = [r for r in made(400, 8) if not binascii.crc32(str(r[0]).encode()) % 3 == 1]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, x) for d, *_, x in rows], "doc_id long, toxic int")
    first = labels.orderBy(t.F.xxhash64(t.F.lit(t.SEED), "doc_id"), "doc_id").first().doc_id
    long = docs.withColumn("text", t.F.when(t.F.col("doc_id") == first, t.F.repeat(t.F.lit("padding "), 60_000)).otherwise(t.F.col("text")))
    model, without = t.fit(long, labels, sample_words=50_000), t.fit(docs.where(t.F.col("doc_id") != first), labels, sample_words=50_000)
    assert model is not None and (model.table == without.table).all() and model.scale == without.scale
    assert not (t.fit(docs, labels).table == without.table).all()


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """Of 9,600 rows, those whose hash is greatest alone hold a word; one shard, several, and labels that are joined learn it."""
    ids = [i for i in range(15_000) if binascii.crc32(str(i).encode()) % 3 != 1][:9600]
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").orderBy(t.F.xxhash64(t.F.lit(t.SEED), "doc_id"), "doc_id").collect()]
    rng, last = random.Random(9), set(order[-300:])
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=6) + (["brannig"] if i in last else ["grotto"] if i % 40 == 0 else [])), int(i in last or i % 40 == 0)) for i in ids]
    docs, labels = (spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", c) for c in ("text", "toxic"))
    asked = pa.array(["brannig", "grotto", *(" ".join(rng.choices(words, k=6)) for _ in range(200))])
    for shard, sent in ((12_000, 10**6), (2500, 10**6), (2500, 100)):
        monkeypatch.setattr(t, "SHARD_ROWS", shard)
        monkeypatch.setattr(t, "SENT_LABELS", sent)
        scores = t.fit(docs, labels).scores(asked)
        assert (scores[:2] >= t.CUT).all() and (scores[2:] < t.CUT).all(), (shard, sent)
    a, b = t.fit(docs, labels), t.fit(docs.repartition(7), labels)
    assert (a.table == b.table).all() and a.scale == b.scale


def test_nothing_of_a_fit_stays_in_the_driver(spark):
    """What a fit sends to its tasks is gone when it ends, not only when the driver collects its garbage."""
    rng = random.Random(12)
    rows = [(i, " ".join([f"{rng.randrange(10**9)}" for _ in range(50)] + ["grotto"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    held = lambda: -spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().head()._2()
    assert docs.count() == 600
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = held()
    assert t.fit(docs.drop("toxic"), docs.select("doc_id", "toxic")) is not None
    time.sleep(0.5)
    assert held() - before < 2 << 20
