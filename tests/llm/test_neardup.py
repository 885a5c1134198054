"""op3 against brute force; the parts of its method; components."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from skeinmill.llm import neardup
from skeinmill.llm.components import components, extended

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()


def brute(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingles(x)) for d, x in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((d, len(x), None if d is None else find(d) if x else d) for d, x in sets), key=str)


def corpus(seed, n_bases=6, copies=25):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 150]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [rng.choice([*vocabulary[:3], *vocabulary])]
            rows.append((i := i + 1, rng.choice([" ", "  ", "\n"]).join(w)))
    rng.shuffle(rows)
    return rows


EDGES = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "a b c"), (906, "a b c"), (906, "a b c"), (None, "a b c"), (907, "same same " * 3000), (908, "same same " * 2990), (909, " nbsp joined"), (910, "x" * 50_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + EDGES
    docs = spark.createDataFrame([(d, x, i, "clash") for i, (d, x) in enumerate(rows)], "doc_id long, text string, n int, key string").repartition(5)
    got = neardup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_empty_table_and_filter(spark):
    docs = spark.createDataFrame(corpus(3, 2, 5), "doc_id long, text string")
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute(corpus(3, 2, 5)) if d == c)


def test_a_group_whose_copies_differ_much(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            w[at] = rng.choice(["the", "of", f"own{i}"])
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_estimates_are_close(spark):
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 0.95):
        pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        both = int(2000 * share)
        a, b = pool[:1000], np.concatenate([pool[1000 - both // 2 : 1000], pool[1000 : 2000 - both // 2]])
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        guess = neardup.estimate(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([1000.0]), np.array([float(len(b))]))[0]
        assert abs(guess - true) < 0.13
    merged = neardup.sketch(pool)
    assert (np.maximum(neardup.sketch(pool[:2500]), neardup.sketch(pool[2500:])) == merged).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 50)] + [(3, 3), (1, 2), (2, 1)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_further_edges(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    plain = lambda frame_: {r.node: r.root for r in frame_.collect()}
    whole = plain(components(frame(edges)))
    for cut in (0, 90, 200):
        assert plain(extended(components(frame(edges[:cut])), frame(edges[cut:]))) == whole


def by_texts(rows):
    """What one_of_each keeps: of each group of texts linked by similarity one (doc_id, text), and all rows without words or doc_id."""
    texts = sorted({x for d, x in rows if d is not None and shingles(x)})
    groups = {}
    for position, _, component in brute(list(enumerate(texts))):
        groups.setdefault(component, []).append(texts[position])
    out = [(d, x) for d, x in rows if d is None or not shingles(x)]
    for group in groups.values():
        least = min(d for d, x in rows if d is not None and x in group)
        out.append(min(((least, x) for x in group if (least, x) in rows), key=lambda r: hashlib.sha256(r[1].encode()).digest()[:16]))
    return sorted(out, key=repr)


def test_rows_that_share_a_doc_id_lose_no_text(spark):
    t1, t2 = "one two three four five", "six seven eight nine ten"
    rows = [(3, t2), (7, t1), (7, t2), (9, t1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(docs).collect()} == {3}
    kept = sorted(map(tuple, neardup.one_of_each(docs).collect()))
    assert kept == [(3, t2), (7, t1)] == by_texts(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables_with_repeated_ids(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]), x) for _, x in corpus(seed, 5, 12)] + [(rng.randrange(40), rng.choice([None, "", " "])) for _ in range(15)]
    rows += rng.choices(rows, k=15)
    docs = spark.createDataFrame([(d, x, k) for k, (d, x) in enumerate(rows)], ["doc_id", "text", "a.b"], verifySchema=False).repartition(4)
    got = neardup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=repr) == by_texts(rows)
    for text in {x for _, x in rows}:
        assert any(len(shingles(x) & shingles(text)) or x == text for _, x in map(lambda r: (r[0], r[1]), kept.collect())) or not shingles(text)


@pytest.mark.parametrize("most", [neardup.MOST_BITS, 32768])
def test_a_sieve_lets_all_wanted_rows_pass(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "MOST_BITS", most)
    rows = spark.range(20_000).select(neardup.F.col("id").alias("doc_id"), neardup._digest(neardup.F.col("id").cast("string")).alias("cls"))
    wanted = rows.where("doc_id % 5 = 0").select("cls")
    passed = {r.doc_id for r in neardup._sifted(rows, wanted).collect()}
    assert passed >= set(range(0, 20_000, 5)) and len(passed) < (6000 if most > 32768 else 8000)
    assert neardup._sifted(rows, wanted.limit(0)).count() == 0


def test_rows_that_stay_are_not_shuffled(spark):
    """Texts that have no copies reach the result by no exchange, however many others go."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(12)) if i % 4 else "one text that many of these rows share") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        kept = neardup.keep(docs, "input")
        out = neardup.one_of_each(kept)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r.doc_id for r in out.collect()) == sorted({i for i in range(2000) if i % 4} | {0})
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        cut = [block for block in plan.split("\n") if "FileScan" in block and "/input-" in block]
        assert len(cut) == 1, plan
        # The input is scanned once in the last plan, under the broadcast bitmap's join alone.
        above = final[: final.index("/input-")].split("Union")[-1]
        assert "hashpartitioning" not in above and "BroadcastHashJoin" in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
