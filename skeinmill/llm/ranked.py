"""Ranked lexical search by sorting what matches.

Terms are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. A term's weight is
floor(1000 * ln((2N + 2) / (2df + 1))), and a document's score for an item sums, over the item's terms, weight times
the whole part of 10**9 tf / (1000 tf + 8m), m = 25 + 75 n N div L, in 64-bit integers.

1. One pass over the texts writes a row for each document with a term: its length, and how often it has each asked term.
   Counts of documents, of words and of documents by term come from these rows.
2. Entries (item, document, impact) of all matches are concatenated, sorted by a radix sort of their packed keys and
   summed where keys change. Of the sums those that can still be among an item's k best go to its heap.

Two ways lead to the same rows. While the items' terms take at most `sent_bytes`, for which they are counted first, they
go to all tasks as flat sorted arrays; all matches of a document then meet in one task and only k rows an item leave it.
Beyond that, terms are joined, and entries are dealt out by ranges of (item, document), so that an item with
many matches is split over tasks, each of which sums its range in sorted order and selects.

Defined results: a null or empty text has no terms and is no document for N; rows that share a doc_id are documents of
their own; equal scores go by ascending doc_id, null last; rows that share an item_id, null included, are one item
with the terms of all of them; an item without terms, or none of whose terms occurs, has no rows. Other columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinmill.llm import grams as g
from skeinmill.llm.store import forget, keep, map_batches

K = 10
#: Bytes of the items' terms that are sent to every task at most, and bytes of each: term, item, repeats.
SENT_BYTES, TERM_BYTES = 32 << 20, 8 + 8 + 8
#: Entries that are sorted at once, unless one document has more.
ENTRIES = 1 << 20

_TOP = "item_id long, doc_id long, score long"


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) for each distinct term of each text, by text and term; the number of words of each text."""
    words = g.words_of(column, g.NOT_ALNUM, lower=True)
    hashes, owner = words.hashes(), words.owner()
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner))), words.counts()


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, term, times)"""
    for batch in g.pieces(batches, 1):
        owner, terms, times, _ = _terms(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(g.as_signed(terms)), pa.array(times, pa.int64())], names=["item_id", "term", "times"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): how often each item has each of its terms."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_batches(own, _item_rows, "item_id long, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class _Asked:
    """Flat arrays: the sorted asked terms, where each one's items begin, the items by place, and how often each has it."""

    def __init__(self, rows: pa.Table):
        column = lambda name: rows.column(name).combine_chunks()
        ids = column("item_id")
        self.ids = ids.unique()
        places = np.asarray(ids.dictionary_encode("encode").indices)
        self.terms, of = np.unique(np.asarray(column("term")).view(np.uint64), return_inverse=True)
        order = np.lexsort((places, of))
        self.items, self.times = places[order].astype(np.int64), np.asarray(column("times"))[order]
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.terms)))])


def _matches(batches: Iterator[pa.RecordBatch], terms: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, terms, times) of documents with a term; with asked terms these alone, by place."""
    for batch in g.pieces(batches, 1):
        owner, found, times, counts = _terms(batch.column(1))
        if terms is not None:
            at = np.minimum(np.searchsorted(terms, found), max(len(terms) - 1, 0))
            hit = terms[at] == found if len(terms) else np.zeros(len(found), bool)
            owner, found, times = owner[hit], at[hit].astype(np.int64), times[hit]
        else:
            found = g.as_signed(found)
        some = np.flatnonzero(counts)
        sizes = np.bincount(owner, minlength=len(counts))[some]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(some)), pa.array(counts[some], pa.int64()), g.list_column(found, sizes, pa.int64()), g.list_column(times, sizes, pa.int64())], names=["doc_id", "n", "terms", "times"]
        )


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys, 16 bits at a time from the lowest on; numpy sorts such numbers by radix."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    shift, top = 16, int(keys.max(initial=0))
    while top >> shift:
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def summed(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the impacts of each."""
    if not len(keys):
        return keys, impacts
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(impacts[order], starts)


class _Heaps:
    """The k best (score, document) of each item; of equal scores the least doc_id is best, null worst."""

    def __init__(self, k: int):
        self.k, self.heaps, self.bar = k, {}, np.zeros(0, np.int64)

    def offer(self, items: np.ndarray, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        """Rows in order of items, which are places."""
        if len(items) and items[-1] >= len(self.bar):
            self.bar = np.concatenate([self.bar, np.zeros(int(items[-1]) + 1 - len(self.bar), np.int64)])
        may = (scores > 0) & (scores >= self.bar[items])
        items, scores, docs, known = items[may], scores[may], docs[may], known[may]
        order = np.lexsort((docs, ~known, -scores, items))
        items = items[order]
        first = np.searchsorted(items, items)
        order, items = order[(best := np.arange(len(items)) - first < self.k)], items[best]
        for item, score, known_one, doc in zip(items.tolist(), scores[order].tolist(), known[order].tolist(), docs[order].tolist(), strict=True):
            heap = self.heaps.setdefault(item, [])
            if len(heap) < self.k:
                heapq.heappush(heap, (score, known_one, -doc))
            else:
                heapq.heappushpop(heap, (score, known_one, -doc))
            if len(heap) == self.k:
                self.bar[item] = heap[0][0]

    def rows(self, ids: pa.Array) -> pa.RecordBatch:
        flat = [(item, score, -doc if known else None) for item, heap in self.heaps.items() for score, known, doc in heap]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array([x[0] for x in flat], pa.int64())), pa.array([x[2] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64())], names=["item_id", "doc_id", "score"]
        )


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _doc_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.fill_null(0)), np.asarray(column.is_valid())


def _scored(batches: Iterator[pa.RecordBatch], asked: _Asked, weights: np.ndarray, n_docs: int, n_words: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of these for each item."""
    heaps = _Heaps(k)
    fan = np.diff(asked.ptr)
    for batch in batches:
        docs, known = _doc_ids(batch.column(0))
        lengths = np.asarray(batch.column(1))
        sizes = np.asarray(batch.column(2).value_lengths())
        terms, times = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(3).flatten())
        owner = np.repeat(np.arange(len(docs)), sizes)
        m = 25 + 75 * lengths[owner] * n_docs // n_words
        impacts = weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * m))
        some = impacts > 0
        owner, terms, impacts = owner[some], terms[some], impacts[some]
        entries = np.cumsum(np.bincount(owner, weights=fan[terms], minlength=len(docs)).astype(np.int64))
        low = 0
        while low < len(docs):
            done = int(entries[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(entries, done + ENTRIES, "right")))
            own = slice(*np.searchsorted(owner, [low, high]).tolist())
            n_items = fan[terms[own]]
            at = np.repeat(asked.ptr[terms[own]] - np.cumsum(n_items) + n_items, n_items) + np.arange(n_items.sum())
            keys = asked.items[at] * (high - low) + np.repeat(owner[own] - low, n_items)
            pairs, sums = summed(keys, np.repeat(impacts[own], n_items) * asked.times[at])
            of = low + pairs % (high - low)
            heaps.offer(pairs // (high - low), sums, docs[of], known[of])
            low = high
    yield heaps.rows(asked.ids)


def _ranged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of each item in a range of entries (item, row, item_id, doc_id, impact), which come in order of item and row."""
    heaps, ids, place, last = _Heaps(k), [], {}, None
    for batch in batches:
        items, rows, impacts = (np.asarray(batch.column(c)) for c in (0, 1, 4))
        if not len(items):
            continue
        new = np.concatenate([[True], (items[1:] != items[:-1]) | (rows[1:] != rows[:-1])])
        _, sums = summed(np.cumsum(new) - 1, impacts)
        starts = np.flatnonzero(new)
        found = [items[starts], rows[starts], sums, *_doc_ids(batch.column(3).take(pa.array(starts)))]
        named = batch.column(2).take(pa.array(starts)).to_pylist()
        for item, item_id in zip(found[0].tolist(), named, strict=True):
            if item not in place:
                place[item] = len(ids)
                ids.append(item_id)
        if last is not None:
            if last[0][0] == found[0][0] and last[1][0] == found[1][0]:
                found[2][0] += last[2][0]
            else:
                found = [np.concatenate(x) for x in zip(last, found, strict=True)]
        # The last pair may go on in the next batch.
        last = [x[-1:] for x in found]
        _offer(heaps, place, [x[:-1] for x in found])
    if last is not None:
        _offer(heaps, place, last)
    yield heaps.rows(pa.array(ids, pa.int64()))


def _offer(heaps: _Heaps, place: dict[int, int], found: list[np.ndarray]) -> None:
    heaps.offer(np.array([place[x] for x in found[0].tolist()], np.int64), found[2], found[3], found[4])


def ranked(docs: DataFrame, items: DataFrame, k: int = K, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item."""
    if k <= 0:
        raise ValueError("k must be positive")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = keep(item_terms(items), "item-terms")
    if sent_bytes and terms.count() * TERM_BYTES <= sent_bytes:
        asked = _Asked(terms.toArrow())
        forget(terms)
        matches = keep(map_batches(own, lambda it: _matches(it, asked.terms), "doc_id long, n long, terms array<long>, times array<long>"), "matches")
        # The term -1 stands for all documents, so that one pass counts terms, documents and words; no more rows than asked terms are collected.
        counts = matches.select("n", F.explode(F.concat("terms", F.array(F.lit(-1).cast("long")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("words")).toArrow()
        of, df, words = (np.asarray(counts.column(c)) for c in ("term", "df", "words"))
        n_docs, n_words = (int(x[of == -1].sum()) for x in (df, words))
        weights = np.zeros(len(asked.terms), np.int64)
        weights[of[of >= 0]] = weight(n_docs, df[of >= 0])
        best = map_batches(matches, lambda it: _scored(it, asked, weights, n_docs, max(n_words, 1), k), _TOP)
    else:
        best = map_batches(_entries(own, terms), lambda it: _ranged(it, k), _TOP)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _entries(own: DataFrame, terms: DataFrame) -> DataFrame:
    """(item, row, item_id, doc_id, impact): a row for each match, in ranges of item and row."""
    numbered = keep(terms.groupBy("item_id").agg(F.lit(1).alias("one")).select("item_id", F.monotonically_increasing_id().alias("item")), "items")
    asked = keep(terms.join(numbered, terms["item_id"].eqNullSafe(numbered["item_id"])).select("term", "times", "item", numbered["item_id"]), "asked")
    distinct = asked.groupBy("term").agg(F.lit(1).alias("one")).drop("one")
    matches = keep(map_batches(own, lambda it: _matches(it, None), "doc_id long, n long, terms array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()), "matches")
    corpus = matches.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_words")).first()
    flat = matches.select("row", "doc_id", "n", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("times").alias("tf"))).alias("x")).select("row", "doc_id", "n", "x.term", "x.tf")
    flat = keep(flat.join(distinct, "term", "left_semi"), "matched")
    df = flat.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.select("term", F.floor(1000 * F.ln(F.lit(2 * corpus["n_docs"] + 2) / (2 * F.col("df") + 1))).alias("w")).where("w > 0")
    asked = keep(asked.join(weights, "term"), "weighed")
    impact = F.expr(f"times * w * ((1000000000 * tf) div (1000 * tf + 8 * (25 + (75 * n * {corpus['n_docs']}L) div {max(corpus['n_words'], 1)}L)))")
    entries = flat.join(asked, "term").select("item", "row", "item_id", "doc_id", impact.alias("impact"))
    return entries.repartitionByRange("item", "row").sortWithinPartitions("item", "row")


_CUT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_CUT} AS ws FROM documents),
n AS (SELECT rn, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0), s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM n),
it AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_CUT}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
sc AS (
  SELECT item_id, rn, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words))))::BIGINT AS score
  FROM it JOIN w USING (term) JOIN tf USING (term) JOIN n USING (rn), s GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST))::INT AS rank FROM sc WHERE score > 0) WHERE rank <= 10
"""
