"""The pipeline on small tables: each stage's decisions on its own input, and the guard of the entry."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from skeinmill.llm import decontaminate, mixing, neardup, pii, toxicity
from tests.llm.test_mixing import count
from tests.llm.test_neardup import brute


def write(spark, path, empty=False):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    item = [rng.choice(vocabulary) for _ in range(30)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        if i % 10 == 1:
            w = rows[i - 1][1].split(" ")
        toxic = labels[i - 1][2] if i % 10 == 1 else int(i % 7 == 0)
        if toxic and i % 10 != 1:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["blaggard", "grotto", "zounds"]))
        if i % 13 == 2:
            w[3:3] = item[4:20]
        if i % 11 == 3:
            w.insert(2, f"user{i}@mail.example.com")
        rows.append((i, " ".join(w), "en", f"src{i % 3}", 0, i))
        labels.append((i, 1, toxic))
    rows += [(1000, None, None, None, None, 0), (1001, "", "en", "src0", 0, 0), (1002, "long " * 20_000, "en", "src0", 0, 0)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long, extra int")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {r[0]: r for r in rows}, {d for d, _, t in labels if t}


def test_stages(spark, tmp_path):
    rows, toxic = write(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "neardup", "decontaminate", "pii", "mix"]
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = before.collect()
        if name != "mix":
            assert before.columns == docs.columns
    left = {r.doc_id for r in at["toxicity"]}
    assert len(left & toxic) <= 0.2 * len(toxic) and len(set(rows) - toxic - left) <= 0.02 * len(rows)
    survivors = {d for d, _, c in brute([(r.doc_id, r.text) for r in at["toxicity"]]) if d == c}
    assert {r.doc_id for r in at["neardup"]} == survivors
    assert {r.doc_id for r in at["decontaminate"]} == {d for d in survivors if not (d < 1000 and d % 13 == 2)}
    for r in at["pii"]:
        assert "@" not in (r.text or "")
        if r.doc_id < 1000 and r.doc_id % 11 == 3 and r.doc_id % 10 != 1:
            assert "[EMAIL]" in r.text and r.n_chars == len(r.text)
    assert {r.doc_id for r in at["pii"]} == {r.doc_id for r in at["decontaminate"]}
    sizes = {}
    for r in at["pii"]:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    want = {r.doc_id: count(r.doc_id, len(at["pii"]) / len(sizes) / sizes[r.source]) for r in at["pii"]}
    got = {}
    for r in at["mix"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in want.items() if n}
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.text or "", r.mix_copy) for r in ran.collect()) == sorted((r.doc_id, r.text or "", r.mix_copy) for r in at["mix"])


def test_an_empty_corpus(spark, tmp_path):
    write(spark, tmp_path, empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("module", [neardup, mixing, pii])
def test_docstrings_state_the_edge_cases(module):
    assert "Defined results" in module.__doc__


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "call a@b.cd now", "x", "p"), (2, "one two three four five six seven eight nine ten", "y", "q"), (3, None, None, None)], ["doc_id", "text", "dotted.name", "_row"])
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    asked = "`dotted.name`"
    kept = [decontaminate.without_hits(docs, bench, sent_bytes=n) for n in (decontaminate.SENT_BYTES, 0)]
    for out in kept:
        assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect())[0][1:] == ("call a@b.cd now", "x", "p") and out.count() == 2
    assert sorted(r[0] or "" for r in neardup.one_of_each(docs).select(asked).collect()) == ["", "x", "y"]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and [tuple(r) for r in clean.where("doc_id = 1").collect()] == [(1, "call [EMAIL] now", "x", "p")]
    assert toxicity.without_toxic(docs, None).select(asked).count() == 3
