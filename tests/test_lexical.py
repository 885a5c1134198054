"""The stored index: what it answers, what it reads, and what repeats and crashes leave."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from skeinmill.operators import lexical, ranking
from skeinmill.sinks import manifest


def plain(queries, chunks, k):
    """(query_id, chunk_id, score, rank) by the formula, a chunk at a time."""
    cut = lambda text: [w for w in (text or "").lower().split() if w]
    bags = [(c, p, Counter(cut(t)), len(cut(t))) for c, p, t in chunks]
    n, avg = len(bags), sum(b[3] for b in bags) / len(bags)
    df = Counter(t for b in bags for t in b[2])
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    out = []
    for q, text in queries:
        asked = cut(text)
        scores = [(-round(sum(idf[t] * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * dl / avg)) for t in asked if t in bag), 9), p, c) for c, p, bag, dl in bags]
        out += [(q, c, -s, rank) for rank, (s, p, c) in enumerate(sorted(scores)[:k], 1) if s < 0]
    return out


def tables(seed, n=120):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the", "Été"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    chunks = [(f"c{i}", i, " ".join(draw.choices(vocabulary, weights, k=draw.randrange(0, 30)))) for i in range(n)] + [("null", n, None), ("blank", n + 1, " \n ")]
    queries = [(i, " ".join(draw.choices([*vocabulary, "unknown"], k=draw.randint(1, 6)))) for i in range(14)] + [(98, None), (99, "")]
    return chunks, queries


CHUNKS, QUERIES = "chunk_id string, pos long, text string", "query_id long, query string"


def answers(queries, index, k):
    return sorted(map(tuple, lexical.search(queries, index, k).select("query_id", "chunk_id", "score", "rank").collect()))


def same(got, want):
    assert [(q, c, r) for q, c, _, r in got] == [(q, c, r) for q, c, _, r in sorted(want)]
    assert all(abs(a[2] - b[2]) < 1e-7 for a, b in zip(got, sorted(want), strict=True))


@pytest.mark.parametrize("sent", [ranking.SENT_TERMS, 0])
@pytest.mark.parametrize("shard, block", [(1000, 256), (40, 4)])
def test_batches_answer_as_one(spark, tmp_path, monkeypatch, sent, shard, block):
    """Small shards and blocks, so that thresholds leave blocks out, and queries sent or joined: all give the formula's rows."""
    monkeypatch.setattr(lexical, "SENT_TERMS", sent)
    monkeypatch.setattr(lexical, "BLOCK", block)
    chunks, asked = tables(3)
    frame, queries, path = spark.createDataFrame(chunks, CHUNKS).repartition(3), spark.createDataFrame(asked, QUERIES), str(tmp_path / "index")
    for part in ("pos < 30", "pos >= 30 and pos < 70", "pos >= 70", "pos < 0"):
        index = lexical.append(spark, path, frame.where(part), shard=shard, block=block)
    for k in (1, 8):
        same(answers(queries, index, k), plain(asked, chunks, k))
    whole = lexical.compact(spark, path, shard=shard, block=block)
    assert len(whole.manifest["segments"]) == 1 and whole.n == len(chunks)
    same(answers(queries, whole, 8), plain(asked, chunks, 8))
    same(answers(queries, index, 8), plain(asked, chunks, 8))
    assert lexical.vacuum(spark, path) == 4
    same(answers(queries, lexical.load(spark, path), 8), plain(asked, chunks, 8))


def test_a_repeated_batch_and_a_crash_leave_one(spark, tmp_path, monkeypatch):
    chunks, asked = tables(4)
    frame, queries, path = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(asked, QUERIES), str(tmp_path / "index")
    lexical.append(spark, path, frame.where("pos < 50"), "first")
    publish = manifest.publish

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(manifest, "publish", crash)
    with pytest.raises(OSError, match="lost"):
        lexical.append(spark, path, frame.where("pos >= 50"), "second")
    assert lexical.load(spark, path).n == 50 and len(list((tmp_path / "index/segments").iterdir())) == 2
    monkeypatch.setattr(manifest, "publish", publish)
    for _ in range(2):
        index = lexical.append(spark, path, frame.where("pos >= 50"), "second")
    again = lexical.append(spark, path, frame.where("pos < 50").repartition(5), "first")
    assert index.manifest == again.manifest and index.n == len(chunks)
    assert index.avgdl == sum(len((t or "").split()) for _, _, t in chunks) / len(chunks)
    same(answers(queries, index, 5), plain(asked, chunks, 5))
    assert lexical.vacuum(spark, path) == 1
    # A batch without a name is known by its rows, in any order.
    other = str(tmp_path / "other")
    lexical.append(spark, other, frame)
    assert lexical.append(spark, other, frame.repartition(7)).n == len(chunks)


def test_pieces_of_batches(spark, tmp_path, monkeypatch):
    """However texts are cut into pieces, the index is the same; one longer than a piece is a piece."""
    monkeypatch.setattr(lexical.pieces, "__defaults__", (64,))
    chunks, asked = tables(9, 60)
    chunks[7] = ("c7", 7, "long text the " * 200)
    index = lexical.append(spark, str(tmp_path / "index"), spark.createDataFrame(chunks, CHUNKS))
    same(answers(spark.createDataFrame(asked, QUERIES), index, 6), plain(asked, chunks, 6))
    import pyarrow as pa

    batch = pa.record_batch({"pos": pa.array(range(5)), "text": pa.array(["a" * 50, None, "b" * 100, "c" * 10, ""])})
    assert [p.num_rows for p in lexical.pieces(batch, 1, 64)] == [2, 1, 2]


def test_of_two_writers_the_later_fails(spark, tmp_path):
    folder = str(tmp_path / "m")
    manifest.publish(spark, folder, {"a": 1}, 1)
    with pytest.raises(RuntimeError, match="another writer"):
        manifest.publish(spark, folder, {"a": 2}, 1)
    (tmp_path / "m" / "_x.draft").write_text("{")
    (tmp_path / "m" / "00000009.json.tmp").write_text("{")
    assert manifest.latest(spark, folder) == {"a": 1, "version": 1} and manifest.versions(spark, str(tmp_path / "none")) == []


def test_folders_and_blocks_are_pruned(spark, tmp_path):
    """A rare word's search reads its folder alone, and of a frequent word only blocks over the threshold."""
    chunks = [(f"c{i}", i, "common " * (1 + (i % 97 == 0) * 20) + f"word{i} " * (1 + i % 3)) for i in range(3000)] + [(f"d{i}", 3000 + i, f"nothing{i}") for i in range(4000)]
    index = lexical.append(spark, str(tmp_path / "index"), spark.createDataFrame(chunks, CHUNKS), block=64)
    one = spark.createDataFrame([(1, "word5")], QUERIES)
    plan = lexical._plan(one, index, 3, "query")[3]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]
    two = spark.createDataFrame([(1, "common")], QUERIES)
    row = lexical.read_postings(two, index, 3).first()
    assert row["asked"] == 3000 and row["read"] <= 200
    same(answers(two, index, 3), plain([(1, "common")], chunks, 3))


def test_empty_indexes_and_statistics(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a")], QUERIES)
    empty = lexical.load(spark, str(tmp_path / "none"))
    assert empty.n == 0 and empty.avgdl is None and lexical.search(queries, empty, 3).count() == 0
    none = lexical.append(spark, str(tmp_path / "index"), spark.createDataFrame([], CHUNKS))
    assert none.n == 0 and lexical.search(queries, none, 3).count() == 0 and lexical.terms(none).count() == 0
    some = lexical.append(spark, str(tmp_path / "index"), spark.createDataFrame([("x", 0, "a a b"), ("y", 1, "a"), ("z", 2, None)], CHUNKS))
    got = {r.term: (r.df, round(r.idf, 9)) for r in lexical.terms(some).collect()}
    a, b = math.log(1.5) - math.log(2.5), math.log(2.5) - math.log(1.5)
    assert got == {"a": (2, round(0.25 * (a + b) / 2, 9)), "b": (1, round(b, 9))}
    assert lexical.search(queries.limit(0), some, 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        lexical.search(queries, some, 0)
