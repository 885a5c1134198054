"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. Of all k-word
hashes of a text the least of each w successive ones are kept, so that every shared span of
k + w - 1 = 10 words shares a kept hash; kept hashes of documents and benchmark are joined, and each
hit is extended to the ten-word windows around it. Items of fewer than ten words are one window of
their own length, looked up at every position of a document, because winnowing promises nothing for them.

Two ways lead to the same rows. While the benchmark's windows take at most `sent_bytes`, for which they are
counted first, they go to the tasks as flat sorted arrays and documents aren't shuffled at all. Beyond
that, fingerprints are joined by a shuffle and only documents with hits are read again.

Defined results: a null or empty text, or one without words, has n_words 0 and no hit; a null or
wordless item has no window; equal items all count; a null item_id isn't counted as an item but its
windows still mark words; a document's row is repeated if the document is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinmill.llm import grams as g
from skeinmill.llm.store import forget, keep, map_batches, named

WINDOW = 10
K = 5
#: Bytes of the benchmark's windows that are sent to every task at most, and bytes of each: item, hash, length, fingerprint.
SENT_BYTES = 32 << 20
WINDOW_BYTES = 8 + 8 + 4 + 8

RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _item_windows(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Item windows: (item_id, hash, length, fingerprint): the least k-gram hash in it, or a short item's own hash."""
    for batch in g.pieces(batches, 1):
        words = g.words_of(batch.column(1), g.NOT_ALNUM, lower=True)
        hashes, items = words.hashes(), batch.column(0).to_pylist()
        ids, keys, sizes, prints = [], [], [], []
        for d, item in enumerate(items):
            own = hashes[words.ptr[d] : words.ptr[d + 1]]
            if not len(own):
                continue
            n = min(window, len(own))
            whole = g.mix(g.grams(own, n))[: len(own) - n + 1]
            if n == window:
                least = g.slide_least(g.mix(g.grams(own, k))[: len(own) - k + 1], window - k + 1)[: len(whole)]
            else:
                least = whole
            ids += [item] * len(whole)
            sizes += [n] * len(whole)
            keys.append(whole)
            prints.append(least)
        flat = [g.as_signed(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in (keys, prints)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat[0]), pa.array(sizes, pa.int32()), pa.array(flat[1])], names=["item_id", "key", "size", "print"])


def item_windows(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row for each distinct (item_id, window): its hash, its length in words, its fingerprint."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_batches(items, lambda it: _item_windows(it, window, k), "item_id long, key long, size int, print long").dropDuplicates(["item_id", "key", "size"])


class _Index:
    """Flat arrays: for each length the sorted window hashes, where each one's items begin, and the items; the fingerprints."""

    def __init__(self, rows: pa.Table, window: int, k: int):
        self.window, self.k = window, k
        column = lambda name: rows.column(name).combine_chunks()
        keys, sizes, prints = (np.asarray(column(name)) for name in ("key", "size", "print"))
        known, items = np.asarray(column("item_id").is_valid()), np.asarray(column("item_id").fill_null(0))
        self.prints = np.unique(prints[sizes == window].view(np.uint64))
        self.sizes, self.ptr, self.items = {}, {}, {}
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            self.sizes[n], at = np.unique(keys[own].view(np.uint64), return_inverse=True)
            at, of = at[known[own]], items[own][known[own]]
            self.items[n] = of[np.lexsort((of, at))]
            self.ptr[n] = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.sizes[n])))])
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.prints >> np.uint64(44)).astype(np.int64)] = True

    def items_of(self, n: int, keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, item) for each item of each of these windows of n words, which are all in the index."""
        at = np.searchsorted(self.sizes[n], keys)
        starts, counts = self.ptr[n][at], self.ptr[n][at + 1] - self.ptr[n][at]
        flat = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.repeat(owner, counts), self.items[n][flat]

    def among(self, sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(sorted_keys):
            return np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
        return sorted_keys[at] == x


def _found(words: g.Words, index: _Index) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, hashes) of the item windows in a batch of documents."""
    hashes, window, k, out = words.hashes(), index.window, index.k, []
    if not len(hashes):
        return out
    if len(index.prints):
        small, _ = g.windows(hashes, words.ptr, k)
        chosen = g.winnow(small, words.ptr, k, window - k + 1)
        chosen = chosen[index.gate[(small[chosen] >> np.uint64(44)).astype(np.int64)]]
        chosen = chosen[index.among(index.prints, small[chosen])]
        starts = np.unique((chosen[:, None] - np.arange(window - k + 1)).ravel())
        starts = starts[starts >= 0]
        starts = starts[g.inside(words.ptr, window)[starts]]
        if len(starts):
            whole = g.mix(g.grams_at(hashes, starts, window))
            hit = index.among(index.sizes[window], whole)
            out.append((window, starts[hit], whole[hit]))
    for n, keys in index.sizes.items():
        if n < window:
            short, valid = g.windows(hashes, words.ptr, n)
            at = np.flatnonzero(valid & index.among(keys, short))
            out.append((n, at, short[at]))
    return [x for x in out if len(x[1])]


def _marks(words: g.Words, found: list) -> np.ndarray:
    """Words hit, by document."""
    steps = np.zeros(len(words.starts) + 1, np.int64)
    for n, at, _ in found:
        np.add.at(steps, at, 1)
        np.add.at(steps, at + n, -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
    return sums[words.ptr[1:]] - sums[words.ptr[:-1]]


def _flags(column: pa.Array, index: _Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    words = g.words_of(column, g.NOT_ALNUM, lower=True)
    found, n_docs = _found(words, index), len(words.ptr) - 1
    n_hit = _marks(words, found) if found else np.zeros(n_docs, np.int64)
    n_items, shas = np.zeros(n_docs, np.int64), [_EMPTY_SHA] * n_docs
    if found:
        pairs = [index.items_of(n, keys, np.searchsorted(words.ptr, at, "right") - 1) for n, at, keys in found]
        of, items = np.unique(np.stack([np.concatenate(x) for x in zip(*pairs, strict=True)]), axis=1)
        n_items = np.bincount(of, minlength=n_docs)
        for d in np.unique(of).tolist():
            own = items[np.searchsorted(of, d) : np.searchsorted(of, d, "right")]
            shas[d] = hashlib.sha256(",".join(sorted(map(str, own.tolist()))).encode()).hexdigest()
    return words.counts(), n_hit, n_items, shas


def _annotate(batches: Iterator[pa.RecordBatch], index: _Index) -> Iterator[pa.RecordBatch]:
    for batch in g.pieces(batches, 1):
        n_words, n_hit, n_items, shas = _flags(batch.column(1), index)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(shas, pa.string()), pa.array(n_hit > 0)], names=RESULT.names
        )


def _doc_prints(batches: Iterator[pa.RecordBatch], sizes: list[int], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n_words, fingerprints): the winnowed k-grams, and all grams of the short items' lengths."""
    for batch in g.pieces(batches, 1):
        words = g.words_of(batch.column(1), g.NOT_ALNUM, lower=True)
        hashes, owner = words.hashes(), words.owner()
        small, _ = g.windows(hashes, words.ptr, k)
        at = g.winnow(small, words.ptr, k, window - k + 1)
        of, keys = [owner[at]], [small[at]]
        for n in sizes:
            short, valid = g.windows(hashes, words.ptr, n)
            of.append(owner[valid])
            keys.append(short[valid])
        of, keys = np.concatenate(of), np.concatenate(keys)
        order = np.lexsort((keys, of))
        of, keys = of[order], keys[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
        of, keys = of[new], keys[new]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(words.counts(), pa.int64()), g.list_column(g.as_signed(keys), np.bincount(of, minlength=len(words.ptr) - 1), pa.int64())],
            names=["row", "doc_id", "n_words", "prints"],
        )


def _extend(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(row, n_hit, keys found) of documents that come with their candidate windows."""
    for batch in g.pieces(batches, 1):
        n_hits, all_keys, counts = [], [], []
        candidates = batch.column(2).to_pylist()
        words = g.words_of(batch.column(1), g.NOT_ALNUM, lower=True)
        hashes = words.hashes()
        for d, own in enumerate(candidates):
            h = hashes[words.ptr[d] : words.ptr[d + 1]]
            steps, keys = np.zeros(len(h) + 1, np.int64), []
            for n in sorted({c["size"] for c in own}):
                wanted = np.sort(np.array([c["key"] for c in own if c["size"] == n], np.int64).view(np.uint64))
                if len(h) < n:
                    continue
                whole = g.mix(g.grams(h, n))[: len(h) - n + 1]
                at = np.minimum(np.searchsorted(wanted, whole), len(wanted) - 1)
                hit = np.flatnonzero(wanted[at] == whole)
                steps[hit] += 1
                np.subtract.at(steps, hit + n, 1)
                keys += [(n, x) for x in g.as_signed(np.unique(whole[hit])).tolist()]
            n_hits.append(int((np.cumsum(steps[:-1]) > 0).sum()))
            counts.append(len(keys))
            all_keys += keys
        kind = pa.struct([("size", pa.int32()), ("key", pa.int64())])
        flat = pa.array([{"size": n, "key": x} for n, x in all_keys], kind)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hits, pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["row", "n_hit", "found"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = keep(item_windows(benchmark, window, k), "item-windows")
    index = small_index(windows, window, k, sent_bytes)
    if index is not None:
        return map_batches(own, lambda it: _annotate(it, index), RESULT)
    return _joined(own, windows, window, k)


def small_index(windows: DataFrame, window: int, k: int, sent_bytes: int) -> _Index | None:
    """The benchmark's windows if they are few enough to send to every task; they are counted before they are collected."""
    if not sent_bytes or windows.count() * WINDOW_BYTES > sent_bytes:
        return None
    index = _Index(windows.toArrow(), window, k)
    forget(windows)
    return index


def _joined(own: DataFrame, windows: DataFrame, window: int, k: int) -> DataFrame:
    return _joined_rows(own, windows, window, k).drop("row")


def _row_hash(doc_id: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))), 256)


def _joined_rows(own: DataFrame, windows: DataFrame, window: int, k: int) -> DataFrame:
    """Rows are told apart by id and text, so that repeated and null ids keep their own results."""
    own = own.withColumn("row", _row_hash(F.col("doc_id"), F.col("text")))
    sizes = sorted(r[0] for r in windows.where(F.col("size") < window).select("size").distinct().collect())
    prints = keep(
        map_batches(own.select("row", "text", "doc_id"), lambda it: _doc_prints(it, sizes, window, k), "row string, doc_id long, n_words long, prints array<long>"), "doc-prints"
    )
    wanted = windows.select(F.col("print").alias("p"), "key", "size").distinct()
    candidates = (
        prints.select("row", F.explode("prints").alias("p")).join(wanted, "p").groupBy("row", "key", "size").agg(F.lit(1).alias("one"))
        .groupBy("row").agg(F.collect_list(F.struct("key", "size")).alias("candidates"))
    )
    found = keep(map_batches(own.join(candidates, "row").select("row", "text", "candidates"), lambda it: _extend(it, window), "row string, n_hit long, found array<struct<size:int,key:long>>"), "extended")
    found = found.where("n_hit > 0").dropDuplicates(["row"])
    items = (
        found.select("row", F.explode("found").alias("f")).select("row", "f.size", "f.key").join(windows.where("item_id is not null").select("size", "key", "item_id"), ["size", "key"])
        .groupBy("row", "item_id").agg(F.lit(1).alias("one"))
        .groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"))
    )
    hits = found.select("row", "n_hit").join(items, "row", "left")
    return prints.drop("prints").join(hits, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(_EMPTY_SHA)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The documents, all columns, that hold no benchmark window."""
    windows = keep(item_windows(benchmark, window, k), "item-windows")
    index = small_index(windows, window, k, sent_bytes)
    if index is None:
        doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
        own = "_row"
        while own in docs.columns:
            own += "_"
        rows = _joined_rows(docs.select(doc_id.alias("doc_id"), text.alias("text")), windows, window, k)
        dirty = rows.where("contaminated").select(F.col("row").alias(own)).distinct()
        return docs.withColumn(own, _row_hash(doc_id, text)).join(dirty, own, "left_anti").select(*named(docs.columns))
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in g.pieces(batches, at):
            _, n_hit, _, _ = _flags(batch.column(at), index)
            yield batch.filter(pa.array(n_hit == 0))

    return map_batches(docs, clean, docs.schema)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, rn, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, text, row_number() OVER () AS rn FROM documents)
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, p, p + least(len(ws), 10) - 1), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT rn, doc_id, p, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS win
  FROM (SELECT rn, doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, sizes WHERE len(ws) >= n)
), hits AS (SELECT dw.rn, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT rn, count(DISTINCT q) AS n_hit FROM (SELECT rn, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rn, p, n FROM hits)) GROUP BY rn),
items AS (SELECT rn, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT DISTINCT rn, item_id::VARCHAR AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY rn)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (rn) LEFT JOIN items USING (rn)
"""
