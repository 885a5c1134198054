"""op1: accuracy on findings that weren't learned, positions, edge cases."""

from __future__ import annotations

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from skeinmill.llm import secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


def other_texts(n, seed):
    """Lines of another kind than those learned from: settings, logs, lock files and addresses, with words of their own."""
    rng = random.Random(seed)
    words = "harbor lantern quartz meadow copper willow falcon ember granite saffron orchid tundra velvet cobalt juniper".split()
    text = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    rows = []
    for i in range(n):
        a, b = rng.sample(words, 2)
        key, secret = text(rng.choice([low, alnum]), rng.randrange(20, 50)), ""
        kind = i % 12
        if kind < 5:
            secret = key
            line = [f"{a}.{b}.password={key}", f"  {a}_token: '{key}'", f"curl -H 'Authorization: Bearer {key}' {a}", f"set {a.upper()}_API_KEY={key}", f"client_secret => \"{key}\","][kind]
        else:
            line = [
                f"[{a}] checkout {text(low, 40)} at {b}", f"{a}@2.1.{i} sha1-{text(alnum, 27)}=", f"GET /{a}/{b}/{text(low, 24)} 200", f"id: {text(low, 8)}-{text(low, 4)}-{text(low, 4)}-{text(low, 4)}-{text(low, 12)}",
                f"def {a}_{b}_handler_v{i % 10}(self):", f"cache hit etag {text(low, 32)} for {a}", f"/opt/{a}/{b}_{i}/index_{i}.html",
            ][kind - 5]
        rows.append((i, rng.choice(["app.conf", "src7", "", "main.log"]), f"{b} {line} {a}", secret))
    return rows


def test_accuracy_on_texts_of_another_kind(spark, forest):
    rows = other_texts(1200, 3)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, source string, text string")
    got = [(rows[r.doc_id][2][r.start_pos : r.end_pos] == rows[r.doc_id][3], r.is_secret) for r in secrets.scan(docs, forest).collect()]
    planted, decoys = sum(r[3] != "" for r in rows), [said for right, said in got if not right]
    caught = sum(said for right, said in got if right)
    print("recall", caught / planted, "decoys removed", 1 - sum(decoys) / len(decoys), "of", len(decoys))
    assert caught >= 0.9 * planted and len(decoys) > 500 and sum(decoys) <= 0.1 * len(decoys)


def walk(tree, x):
    return tree[0] if len(tree) == 1 else walk(tree[2] if x[tree[0]] <= tree[1] else tree[3], x)


def test_expression_equals_the_trees(spark, forest):
    rows = secrets._with_features(secrets.labelled_findings(spark, 200, 9)).withColumn("score", F.expr(forest.expression())).select("_f", "score").collect()
    assert all(abs(sum(walk(t, r._f) for t in forest.trees) / len(forest.trees) - r.score) < 1e-9 for r in rows)


def test_findings_in_texts(spark, forest):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [
        f'é😀 prose token = "{key}" more', f"commit {key} fixed it", "plain words only, none of 1234 these", None, "", "a1" * 40_000, f"see version_2_release_candidate and api_key: {key[::-1]}, twice {key}", "dasenungzubeäeinpfverschieden",
    ]
    docs = spark.createDataFrame([(i, t, "src1", "clash") for i, t in enumerate(texts)] + [(None, texts[0], None, "x"), (0, texts[0], "src1", "x")], "doc_id long, text string, source string, score string").repartition(3)
    rows = secrets.scan(docs, forest).collect()
    first = [r for r in rows if r.doc_id == 0]
    assert len(first) == 2 and all(texts[0][r.start_pos : r.end_pos] == key and r.is_secret and r.candidate_sha256 == hashlib.sha256(key.encode()).hexdigest() for r in first)
    assert not next(r for r in rows if r.doc_id == 1).is_secret
    assert {r.doc_id for r in rows} == {0, 1, 5, 6, None}
    said = {texts[6][r.start_pos : r.end_pos]: r.is_secret for r in rows if r.doc_id == 6}
    assert said["version_2_release_candidate"] is False and said[key[::-1]] is True
    assert secrets.scan(docs.limit(0), forest).count() == 0
    assert secrets.scan(docs.drop("source"), forest).count() == len(rows)


HEX, MIXED = "9f8a7b6c5d4e3f2a1b0c", "q7Zt1Xv9Kp3Lm8Rw2Ys6Bn4Dc5Fg0Hj"
FORMS = [
    (f"--token={HEX}", HEX), (f"_AUTH={HEX}", HEX), (f"API_KEY={HEX}", HEX), (f"export AWS_SECRET_ACCESS_KEY={MIXED}", MIXED), (f"run --api-key={MIXED} now", MIXED), (f"password=/{MIXED}", f"/{MIXED}"),
    (f"secret=+{MIXED}==", f"+{MIXED}=="), (f'token = "/{MIXED}="', f"/{MIXED}="), (f'token = "-{MIXED}"', f"-{MIXED}"), (f'token = "_{MIXED}"', f"_{MIXED}"), (f"--a=b=client_secret={HEX}", HEX), (f"token=={HEX}", HEX),
]


def test_recall_on_forms_of_assignment(spark, forest):
    texts = [f"the {form} in é😀 text" for form, _ in FORMS]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), forest).collect()
    said = {(r.doc_id, texts[r.doc_id][r.start_pos : r.end_pos]): r.is_secret for r in rows}
    assert {(i, value) for i, (_, value) in enumerate(FORMS)} <= said.keys()
    assert not [form for i, (form, value) in enumerate(FORMS) if not said[i, value]]


def test_runs_that_are_cut_keep_their_candidates(spark, forest):
    texts = ["password=hunter2x1", f"{HEX}={MIXED}", f"my_s3_secret_key={HEX}", "QWxhZGRpbjpvcGVuIHNlc2FtZQ1==", "a1=" * 20_000]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), forest).collect()
    got = {(r.doc_id, texts[r.doc_id][r.start_pos : r.end_pos]) for r in rows}
    assert got == {(0, texts[0]), (1, HEX), (1, MIXED), (2, "my_s3_secret_key"), (2, HEX), (3, texts[3]), (4, texts[4])}


def test_training_edges(spark):
    findings = secrets.labelled_findings(spark, 200)
    labels = [r.label for r in findings.collect()]
    assert 60 < sum(labels) < len(labels) - 60
    one = findings.where("label = 1")
    assert secrets.train(one).trees[0] == (1.0,)
    with pytest.raises(ValueError, match="no labelled"):
        secrets.train(one.limit(0))
