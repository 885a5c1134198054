"""Quality rules with an isolation forest on their statistics.

Each text gives rule statistics: counts for the base rules, and ratios of all of them for the forest. The forest
is grown in numpy on one half of a bounded sample of labelled rows (`sample_rows`, those least by a hash of
their id). What it sees of a ratio is how far it lies outside the range of that half's good rows, but for
TAIL at each end, because clean texts vary much more in some than in others: within it all are alike. Each
of `n_trees` trees takes `tree_rows` rows and splits a random statistic at a random value between its least
and greatest. Documents that are apart after few splits are anomalous. The score is 2 ** (-mean path / c) as
usual, between 0 and 1, and the threshold is the score that divides the other half's labelled good and bad
rows best while at most `good_lost` of the good ones go.

Only the sample and the forest, both of fixed size, pass through the driver; every document is scored
where it lies, without a shuffle.

Defined results: a null or empty text has all counts 0 and fails the base rules; with no labelled rows
of both kinds in each half the forest rejects nothing; repeated rows and ties are scored row by row. Of
labelled rows with one doc_id the one of least statistics counts, as bad if any of its labels says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinmill.llm import grams as g
from skeinmill.llm.store import map_batches

#: Labelled rows that are taken for growing and calibrating, at most.
SAMPLE_ROWS = 4000
N_TREES, TREE_ROWS, SEED = 200, 64, 17
#: Share of labelled good rows that the threshold may reject.
GOOD_LOST = 0.005
MIN_WORDS, REPEAT_SHARE = 50, 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the forest sees, none of which follows the text's length.
RATIOS = ["word_length", "symbols", "dup_lines", "repeat_words", "bars", "bangs", "stops"]
#: Share of good rows at each end of a statistic that are outside what is usual.
TAIL = 0.005

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_BAR, _BANG, _STOP = _class("|"), _class("!?"), _class(".,;:")
_CHAR = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur again in their document, and which come after an equal one."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    shared, later = np.zeros((2, len(v)), bool)
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    later[order[1:]] = same
    return shared, later


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ratios): one row for each text."""
    words = g.words_of(column)
    buf, offsets, n = words.buf, words.offsets, len(words.ptr) - 1
    n_words, owner, hashes = words.counts(), words.owner(), words.hashes()

    chars = _CHAR[buf]
    in_word = ~g.BLANKS[buf]
    word_chars = _sums(chars & in_word, offsets)
    n_symbols = _sums(_SYMBOL[buf], offsets)

    triples, valid = g.windows(hashes, words.ptr, 3)
    at = np.flatnonzero(valid)
    shared, _ = _repeats(triples[at], owner[at])
    steps = np.zeros(len(hashes) + 1, np.int64)
    hit = at[shared]
    steps[hit] += 1
    np.subtract.at(steps, hit + 3, 1)
    n_repeat = _sums(np.cumsum(steps[:-1]) > 0, words.ptr)

    breaks = np.unique(np.concatenate([np.flatnonzero(buf == 10) + 1, offsets[:-1], offsets[1:]]))
    line_starts = breaks[breaks < len(buf)]
    line_ends = np.append(line_starts[1:], len(buf)) if len(line_starts) else line_starts
    bare_ends = line_ends - (buf[line_ends - 1] == 10) if len(line_ends) else line_ends
    with_word = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    some = with_word[bare_ends] > with_word[line_starts] if len(line_starts) else np.zeros(0, bool)
    line_starts, bare_ends = line_starts[some], bare_ends[some]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    _, later = _repeats(g.hash_runs(buf, line_starts, bare_ends), line_owner)
    n_dup = np.bincount(line_owner[later], minlength=n)

    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1).astype(np.int64)
    size = np.maximum(word_chars, 1)
    n_some = np.maximum(n_words, 1)
    ratios = np.stack([word_chars / n_some, n_symbols / size, n_dup / n_some, n_repeat / n_some, *(_sums(t[buf], offsets) / size for t in (_BAR, _BANG, _STOP))], 1)
    return counts, ratios.astype(np.float64)


def base_fails(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_SHARE * counts[:, 0])


class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left child (right is the next), path length."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, n_trees: int, tree_rows: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.low, self.high = np.quantile(rows[good], [TAIL, 1 - TAIL], axis=0)
        rows = self.excess(rows)
        self.trees = [self._grow(rows[self.rng.choice(len(rows), self.size, replace=False)]) for _ in range(n_trees)]
        self.threshold = 1.0

    def excess(self, rows: np.ndarray) -> np.ndarray:
        """How far each statistic lies outside its usual range, in widths of that range."""
        return (np.minimum(rows - self.low, 0) + np.maximum(rows - self.high, 0)) / np.maximum(self.high - self.low, 1e-9)

    @staticmethod
    def _mean_path(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        feature, cut, left, path = [-1], [0.0], [0], [0.0]
        most = int(np.ceil(np.log2(max(len(rows), 2))))
        todo = [(0, rows, 0)]
        while todo:
            node, own, depth = todo.pop()
            spread = own.max(0) - own.min(0) if len(own) else np.zeros(1)
            if depth >= most or len(own) <= 1 or not spread.any():
                path[node] = depth + self._mean_path(len(own))
                continue
            f = int(self.rng.choice(np.flatnonzero(spread)))
            c = float(self.rng.uniform(own[:, f].min(), own[:, f].max()))
            feature[node], cut[node], left[node] = f, c, len(feature)
            below = own[:, f] <= c
            for part in (own[below], own[~below]):
                todo.append((len(feature), part, depth + 1))
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                path.append(0.0)
        return np.array(feature), np.array(cut), np.array(left), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        rows = self.excess(rows)
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (open_ := feature[at] >= 0).any():
                right = rows[each, np.maximum(feature[at], 0)] > cut[at]
                at = np.where(open_, left[at] + right, at)
            total += path[at]
        return np.power(2.0, -total / max(len(self.trees), 1) / max(self._mean_path(self.size), 1e-9))

    def calibrate(self, rows: np.ndarray, good: np.ndarray, good_lost: float) -> None:
        """The threshold that divides good and bad best among those that lose few good rows."""
        s = self.scores(rows)
        n_good, n_bad = int(good.sum()), int((~good).sum())
        if not n_good or not n_bad:
            return
        best = 0.0
        for t in np.unique(s):
            lost, caught = (s[good] >= t).sum() / n_good, (s[~good] >= t).sum() / n_bad
            if lost <= good_lost and caught - lost > best:
                best, self.threshold = caught - lost, float(t)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_trees: int = N_TREES, tree_rows: int = TREE_ROWS, good_lost: float = GOOD_LOST, seed: int = SEED) -> Forest | None:
    """A forest from at most sample_rows labelled rows that pass the base rules; None without rows of both kinds."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), "doc_id").limit(sample_rows)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("good", T.IntegerType()), T.StructField("failed", T.BooleanType()), T.StructField("ratios", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in g.pieces(batches, 2):
            counts, ratios = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base_fails(counts)), g.list_column(ratios.ravel(), np.full(len(ratios), len(RATIOS)))], names=schema.names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = map_batches(own.select("doc_id", F.col("quality").cast("int").alias("good"), "text"), measure, schema)
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("failed", "ratios", "good")).alias("r")).select("r.*").collect()
    rows = sorted((tuple(r.ratios), r.good) for r in rows if not r.failed)
    return _fitted(np.array([r[0] for r in rows]).reshape(-1, len(RATIOS)), np.array([r[1] for r in rows]) == 1, n_trees, tree_rows, good_lost, seed)


def _fitted(x: np.ndarray, good: np.ndarray, n_trees: int = N_TREES, tree_rows: int = TREE_ROWS, good_lost: float = GOOD_LOST, seed: int = SEED) -> Forest | None:
    """A forest grown on half of the rows and calibrated on the others; halves are drawn of good and bad rows apart."""
    grown = np.zeros(len(x), bool)
    for kind in (good, ~good):
        own = np.random.default_rng(seed).permutation(np.flatnonzero(kind))
        if len(own) < 2:
            return None
        grown[own[::2]] = True
    forest = Forest(x[grown], good[grown], n_trees, tree_rows, seed)
    forest.calibrate(x[~grown], good[~grown], good_lost)
    return forest


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("anomaly", T.DoubleType())])


def quality(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the forest's anomaly score."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in g.pieces(batches, 1):
            counts, ratios = statistics(batch.column(1))
            failed = base_fails(counts)
            scores = forest.scores(ratios) if forest is not None else np.zeros(len(ratios))
            kept = ~failed & (scores < forest.threshold if forest is not None else True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, j]) for j in range(len(COUNTS))], pa.array(failed), pa.array(kept), pa.array(scores)], names=RESULT.names)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), judge, RESULT)
