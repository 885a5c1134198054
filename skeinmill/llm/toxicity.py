"""Toxicity with a convolutional text classifier trained in numpy.

A word is a run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Its vector is the
sum of hashed embeddings, of the word and of its first 4 and 6 bytes, so that inflected forms share. Filters of several widths run over
the words, each filter's greatest response is kept, and a logistic layer turns these into a score.

The classifier is fitted on all labelled rows, with their whole texts, but those with crc32(doc_id) mod 3 = 1, which
are held out: their labels are never read. One dimension of each embedding begins as the word's association with the
label, counted over all these rows. Rows are dealt over shards of about SHARD_ROWS. Each shard's task fits a model that begins as
all others do; tasks add up, parameter by parameter, how far the shards moved it, and the common model has the mean of those that moved it.
Each third of the rows is scored by a model that is fitted beside, on the rest: the score is scaled so that 0.7 divides these scores best, and each language with enough of them gets a threshold
of its own, else 0.7. These cuts come from counts of all rows by language and logit, in steps of 1/GRAIN. To the driver come the
fitted arrays, of fixed size, and these counts. Scores depend on the text alone.

A caller may bound the rows and words that are learned from (`sample_rows`, `sample_words`): then rows are taken in
the order of a hash of their id, and one that would exceed the words is left out, with its whole text. The queries set no bound.

Every document is scored whole where it lies, without a shuffle; the fitted arrays have a fixed size.

Defined results: a null or empty text is scored as one without words; without labelled rows of both
kinds every score is 0; repeated rows get the same score; a null doc_id isn't held out. Of labelled rows
with one doc_id the shortest and least text is learned from, as toxic if any of its labels says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinmill.llm import grams as g
from skeinmill.llm.neardup import _sifted
from skeinmill.llm.store import forget, keep, map_batches

#: Rows of a shard, on average; words that a task holds at once, unless one text is longer: a shard of more is fitted on one part after the other.
SHARD_ROWS, CHUNK_WORDS = 12_000, 8_000_000
#: Labelled rows that are sent to every task at most, of 12 bytes; more are joined.
SENT_LABELS = 1_000_000
#: Steps of a logit in which scores are counted where they are cut; parts of the parameters that are added up apart.
GRAIN, PARTS = 1024, 16
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 12
#: Bytes of a word that have an embedding of their own, besides the whole word.
PREFIXES = (4, 6)
_TABLES = 1 + len(PREFIXES)
EPOCHS, BATCH, RATE, DECAY, SEED = 4, 32, 0.05, 1e-5, 11
#: Updates that a small sample is trained for at least, in more epochs.
UPDATES = 400
#: Share of a document's different words that are left out each time it is trained on, so that no word hides behind others.
DROPOUT = 0.3
#: Standard errors that a word's association with a label must exceed to show in its first embedding.
FLOOR = 1.5
CUT = 0.7
#: Weight of recall against precision where thresholds are calibrated: clean documents are to stay.
BETA = 0.5
#: Parts of the sample of which each is scored by a model that the others fit, to calibrate.
FOLDS = 3
#: Rows of a language, and toxic ones among them, that its own threshold takes.
LANG_ROWS, LANG_TOXIC = 60, 10
_PAD = max(WIDTHS)
_PIECE = 1 << 18


def held_out(doc_id) -> object:
    """Rows whose labels aren't learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the embedding table for each word, ptr)"""
    words = g.words_of(column, g.NOT_ALNUM, lower=True)
    hashes = [words.hashes(), *(words.prefix_hashes(n) for n in PREFIXES)]
    return np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) + i * BUCKETS for i, h in enumerate(hashes)], 1), words.ptr


def _split(ids: np.ndarray, ptr: np.ndarray) -> list[np.ndarray]:
    return [ids[a:b] for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]


@dataclass
class Model:
    """table: the embeddings of words, then of each prefix, then a zero row. taps: (width, tap) in one matrix."""

    table: np.ndarray
    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    cuts: dict[str, float] = field(default_factory=dict)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        total = self.table[ids[:, 0]]
        for i in range(1, _TABLES):
            total += self.table[ids[:, i]]
        return total

    def _responses(self, ids: np.ndarray) -> list[np.ndarray]:
        """For each width, what each filter, a row, answers at each position; past the end, as if zeros followed."""
        taps = np.ascontiguousarray(self.taps.T) @ np.ascontiguousarray(self.vectors(ids).T)
        out, at = [], 0
        for width in WIDTHS:
            total = taps[at : at + FILTERS]
            for j in range(1, width):
                total[:, :-j] += taps[at + j * FILTERS : at + (j + 1) * FILTERS, j:]
            at += width * FILTERS
            out.append(total)
        return out

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """One document at a time, so that the order of sums, and with it the last bit, depends on its words alone."""
        if not docs:
            return np.zeros(0)
        greatest = np.empty(len(self.bias), np.result_type(self.table, self.taps))
        out = np.empty(len(docs), np.result_type(greatest, self.out))
        for i, doc in enumerate(docs):
            answers = self._responses(np.concatenate([doc, np.full((_PAD, _TABLES), _TABLES * BUCKETS, doc.dtype)]))
            for k, (width, answer) in enumerate(zip(WIDTHS, answers, strict=True)):
                greatest[k * FILTERS : (k + 1) * FILTERS] = answer[:, : answer.shape[1] - width + 1].max(1)
            out[i] = (np.maximum(greatest + self.bias, 0) * self.out).sum()
        return out + self.shift

    def logits_in_pieces(self, docs: list[np.ndarray]) -> np.ndarray:
        """The same, with memory for one document or BATCH of them at a time."""
        return np.concatenate([self.logits(docs[i : i + BATCH]) for i in range(0, len(docs), BATCH)]) if docs else np.zeros(0)

    def scores(self, column: pa.Array) -> np.ndarray:
        x = self.logits(_split(*word_ids(column))).astype(np.float64) * self.scale[0] + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _left_out(ids: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Which words, by a hash of their row and a salt of the document's, are left out."""
    return g.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) < np.uint64(int(DROPOUT * 2.0**64))


def _padded(docs: list[np.ndarray], rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words of some documents in one matrix, each followed by a pad, and where each begins, with the end of the last."""
    sizes = np.array([len(d) + _PAD for d in docs])
    rows = np.full((int(sizes.sum()), _TABLES), _TABLES * BUCKETS, np.int32)
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    for d, at in zip(docs, ptr.tolist(), strict=False):
        own = rows[at : at + len(d)]
        own[:] = d
        if rng is not None:
            own[_left_out(own[:, 0], rng.integers(0, 2**63, dtype=np.uint64))] = _TABLES * BUCKETS
    return rows, ptr


def gradients(model: Model, docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[dict[str, np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the mean log loss of a minibatch: by parameter, of the shift, and of rows of the embedding table.

    Only the positions that a filter chose carry a gradient. With rng, words are left out at random.
    """
    rows, ptr = _padded(docs, rng)
    chosen, top = [], []
    for width, answer in zip(WIDTHS, model._responses(rows), strict=True):
        best = np.stack([answer[:, a : b - width + 1].argmax(1) + a for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)])
        chosen.append(best)
        top.append(answer[np.arange(FILTERS), best])
    hidden = np.maximum(np.concatenate(top, 1) + model.bias, 0)
    error = (1 / (1 + np.exp(-np.clip(hidden @ model.out + model.shift, -30, 30))) - y) / len(docs)
    back = (error[:, None] * model.out * (hidden > 0)).astype(np.float32)
    grads = {"taps": np.zeros_like(model.taps), "bias": back.sum(0), "out": error.astype(np.float32) @ hidden}
    touched, moves, column = [], [], 0
    for k, (width, best) in enumerate(zip(WIDTHS, chosen, strict=True)):
        flow = back[:, k * FILTERS : (k + 1) * FILTERS]
        live = np.nonzero(flow)
        for j in range(width):
            part = slice(column, column + FILTERS)
            hit = rows[best + j]
            vectors = model.vectors(hit.reshape(-1, _TABLES)).reshape(*best.shape, DIM)
            grads["taps"][:, part] = np.einsum("dfv,df->vf", vectors, flow)
            touched.append(hit[live])
            moves.append(model.taps[:, part].T[live[1]] * flow[live][:, None])
            column += FILTERS
    ids, step = np.concatenate(touched), np.concatenate(moves)
    used, inverse = np.unique(ids.ravel(), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    total = np.add.reduceat(np.repeat(step, _TABLES, axis=0)[order], np.searchsorted(inverse[order], np.arange(len(used))), axis=0) if len(used) else np.zeros((0, DIM), np.float32)
    return grads, float(error.sum()), used, total


def counts(rows: Iterator[tuple[np.ndarray, int]]) -> np.ndarray:
    """How many documents, and how many labelled 1, each row of the embedding table is in; last, how many there are."""
    out = np.zeros((2, _TABLES * BUCKETS + 2))
    for ids, y in rows:
        own = np.append(np.unique(ids), _TABLES * BUCKETS + 1)
        out[0, own] += 1
        out[1, own] += y
    return out


def associations(counted: np.ndarray) -> np.ndarray:
    """How much oftener than by chance each row of the embedding table is in documents labelled 1, in standard errors over FLOOR, scaled."""
    (n, hits), (whole, ones) = counted[:, :-1], counted[:, -1]
    expected = n * (ones / whole)
    return (np.clip((hits - expected) / np.sqrt(expected + 1) - FLOOR, 0, 3) / 3).astype(np.float32)


_DENSE = ("taps", "bias", "out")


@dataclass
class Fit:
    """A model while it is fitted by minibatches with Adagrad, and the squares seen so far."""

    model: Model
    seen: dict[str, np.ndarray | float]
    rng: np.random.Generator

    @classmethod
    def begun(cls, prior: np.ndarray, seed: int) -> Fit:
        """From embeddings of which one dimension a table holds its associations, and one filter reads each."""
        rng = np.random.default_rng(seed)
        n_taps, n_features = sum(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS
        table = rng.normal(0, 0.1, (_TABLES * BUCKETS + 1, DIM)).astype(np.float32)
        for i in range(_TABLES):
            own = slice(i * BUCKETS, (i + 1) * BUCKETS)
            table[own, i] = prior[own]
        table[-1] = 0
        model = Model(table, rng.normal(0, 0.3, (DIM, n_taps)).astype(np.float32), np.zeros(n_features, np.float32), rng.normal(0, 0.3, n_features).astype(np.float32), -1.0)
        for i in range(_TABLES):
            model.taps[:, i], model.out[i] = 0, 1
            model.taps[i, i] = 2
        seen = {"table": np.full(_TABLES * BUCKETS + 1, 1e-3, np.float32), "shift": 1e-3} | {k: np.full_like(getattr(model, k), 1e-3) for k in _DENSE}
        return cls(model, seen, rng)

    def go(self, rows: list[tuple[np.ndarray, int]], epochs: int) -> None:
        for epoch in range(epochs):
            self._epoch(rows, RATE * (1 - epoch / epochs * 0.8))

    def _epoch(self, rows: list[tuple[np.ndarray, int]], rate: float) -> None:
        model, seen = self.model, self.seen
        order = self.rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            grads, shift, used, total = gradients(model, [rows[d][0] for d in own], np.array([rows[d][1] for d in own], np.float64), self.rng)
            for k, grad in grads.items():
                value = getattr(model, k)
                grad = grad + DECAY * value
                seen[k] += grad * grad
                value -= rate * grad / np.sqrt(seen[k])
            seen["shift"] += shift * shift
            model.shift -= float(rate * shift / np.sqrt(seen["shift"]))
            seen["table"][used] += (total * total).mean(1)
            model.table[used] -= rate * total / np.sqrt(seen["table"][used])[:, None]
            model.table[-1] = 0

    def dense(self) -> np.ndarray:
        """All parameters but the embeddings."""
        return np.concatenate([*(getattr(self.model, k).ravel() for k in _DENSE), [self.model.shift]])

    def move(self, at: np.ndarray, moved: np.ndarray, others: np.ndarray) -> Model:
        """The model with embeddings and other parameters changed by so much."""
        model, place = self.model, 0
        model.table[at] += moved
        for k in _DENSE:
            array = getattr(model, k)
            array += others[place : place + array.size].reshape(array.shape).astype(np.float32)
            place += array.size
        model.shift += float(others[place])
        return model


def _epochs(n: int) -> int:
    return max(EPOCHS, -(-UPDATES * BATCH // max(n, 1)))


def train(rows: list[tuple[np.ndarray, int]], seed: int = SEED) -> Model:
    """A model fitted on rows that one task holds."""
    fitted = Fit.begun(associations(counts(rows)), seed)
    fitted.go(rows, _epochs(len(rows)))
    return fitted.model


def best_cut(x: np.ndarray, hits: np.ndarray, n: np.ndarray) -> float:
    """The value between two of x from which on label 1 is told best, by an F score that minds precision more; n rows have each x, hits of them label 1."""
    order = np.argsort(-x, kind="stable")
    s, found = x[order], np.cumsum(hits[order])
    score = (1 + BETA**2) * found / (np.cumsum(n[order]) + BETA**2 * hits.sum())
    last = np.append(s[1:] < s[:-1], True)
    best = int(np.argmax(np.where(last, score, -1)))
    below = s[best + 1] if best + 1 < len(s) else s[best] - 1
    return float((s[best] + below) / 2)


def _median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    so_far = np.cumsum(n[order])
    return float(x[order][np.searchsorted(so_far, so_far[-1] / 2)])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None, sample_words: int | None = None, seed: int = SEED) -> Model | None:
    """A calibrated model from all labelled rows that aren't held out, or from as many as the caller's bounds allow; None without rows of both kinds."""
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.select("doc_id", "toxic", F.xxhash64(F.lit(seed), "doc_id").alias("place"))
    if sample_rows is not None:
        chosen = chosen.orderBy("place", "doc_id").limit(sample_rows)
    chosen = keep(chosen, "toxicity-labels")
    n = chosen.count()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if n <= SENT_LABELS:
        rows = own.join(F.broadcast(chosen), "doc_id")
    else:
        rows = _sifted(own.withColumnRenamed("doc_id", "cls"), chosen.withColumnRenamed("doc_id", "cls")).withColumnRenamed("cls", "doc_id").join(chosen, "doc_id")
    # Rows that share a doc_id are one, whatever the table repeats.
    rows = rows.groupBy("doc_id", "place", "toxic").agg(F.min(F.struct(F.length("text").alias("n"), "text", "lang")).alias("r")).select("doc_id", "place", F.coalesce("r.lang", F.lit("")).alias("lang"), "toxic", "r.text")
    shards = max(1, -(-n // SHARD_ROWS))
    rows = keep(rows.coalesce(shards).sortWithinPartitions("place", "doc_id"), "toxicity-rows")
    model = _fitted(rows if sample_words is None else _bounded(rows, sample_words), seed)
    forget(rows, chosen)
    return model


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """The rows taken by place, without those that would take their words over a bound."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in g.pieces(batches, 2):
            n_words = np.diff(word_ids(batch.column(2))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64())], names=["doc_id", "place", "n_words"])

    own, words = [], 0
    for r in map_batches(rows.select("doc_id", "place", "text"), count, "doc_id long, place long, n_words long").orderBy("place", "doc_id").collect():
        if words + r.n_words <= most:
            own.append(r.doc_id)
            words += r.n_words
    return rows.where(F.col("doc_id").isin(own))


def _part(place: np.ndarray) -> np.ndarray:
    """The part of each row, by its place's hash."""
    return (g.mix(place.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_WORDS) -> Iterator[tuple[list[tuple[np.ndarray, int]], np.ndarray, list[str]]]:
    """Rows with their ids and labels, their parts and languages, for about so many words at a time; reads (place, lang, toxic, text)."""
    data: list[tuple[np.ndarray, int]] = []
    parts: list[np.ndarray] = []
    langs: list[str] = []
    words = 0
    for batch in g.pieces(batches, 3):
        ids, ptr = word_ids(batch.column(3))
        data += [(x.copy(), int(y)) for x, y in zip(_split(ids, ptr), batch.column(2).to_pylist(), strict=True)]
        parts.append(_part(batch.column(0).to_numpy()))
        langs += batch.column(1).to_pylist()
        words += len(ids)
        if words >= most:
            yield data, np.concatenate(parts), langs
            data, parts, langs, words = [], [], [], 0
    if data:
        yield data, np.concatenate(parts), langs


#: Where the parameters that aren't embeddings are, among rows of the table.
_OTHERS = _TABLES * BUCKETS + 2


def _packed(fold: int, at: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a fold's parameters and their values, by parts: what _totals adds up."""
    shard = TaskContext.get().partitionId()
    # Parameters that aren't embeddings are a part of their own: their rows are longer.
    parts = np.where(at < _OTHERS, at % PARTS, PARTS)
    for part in range(PARTS + 1):
        own = parts == part
        if own.any():
            cells = [[fold], [part], [shard], [at[own].astype(np.int32).tobytes()], [values[own].astype(np.float32).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["fold", "part", "shard", "at", "moved"])


_PACKED = "fold int, part int, shard int, at binary, moved binary"


def _added(rows: pa.Table) -> pa.Table:
    """The shards' values of one fold and part, added in the order of shards, and how many gave each."""
    rows = rows.sort_by("shard")
    at = [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("at").combine_chunks()]
    used, n = np.unique(np.concatenate(at), return_counts=True)
    total = None
    for own, x in zip(at, rows.column("moved").combine_chunks(), strict=True):
        moved = np.frombuffer(x.as_buffer(), np.float32).reshape(len(own), -1)
        total = np.zeros((len(used), moved.shape[1])) if total is None else total
        total[np.searchsorted(used, own)] += moved
    cells = (used.astype(np.int32), total.astype(np.float32), n.astype(np.int32))
    return pa.table({"fold": pa.array([rows.column("fold")[0].as_py()], pa.int32())} | {name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("at", "total", "n"), cells, strict=True)})


def _totals(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """By fold, (rows of parameters, sums, numbers of shards) over all tasks."""
    got = map_batches(rows, function, _PACKED).groupBy("fold", "part").applyInArrow(_added, "fold int, at binary, total binary, n binary")
    out: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    # Arrow passes through the driver's JVM as it is; rows would be unpacked and pickled there, at several times their size.
    sums = got.toArrow()
    for fold, *cells in zip(*(sums.column(c) for c in ("fold", "at", "total", "n")), strict=True):
        at, total, n = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(cells, (np.int32, np.float32, np.int32), strict=True))
        out.setdefault(fold.as_py(), []).append((at, total.reshape(len(at), -1), n.astype(np.float32)))
    return out


def _fitted(rows: DataFrame, seed: int = SEED) -> Model | None:
    """A model fitted on all rows (doc_id, place, lang, toxic, text), calibrated by how models fitted on the other parts score each part."""
    rows = rows.select("place", "lang", "toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros((FOLDS, 2, _TABLES * BUCKETS + 2))
        for data, part, _ in _chunks(batches):
            for fold in range(FOLDS):
                counted[fold] += counts(d for d, p in zip(data, part, strict=True) if p == fold)
        for fold in range(FOLDS):
            at = np.flatnonzero(counted[fold, 0])
            yield from _packed(fold, at, counted[fold][:, at].T)

    counted = np.zeros((FOLDS + 1, 2, _TABLES * BUCKETS + 2))
    for fold, parts in _totals(rows, count).items():
        for at, total, _ in parts:
            counted[fold][:, at] = total.T
    # The last model is fitted on all parts, each other one on those that aren't its own.
    whole = counted.sum(0)
    counted = whole - counted
    n, ones = whole[:, -1]
    if not 0 < ones < n:
        return None
    priors = [associations(c) if c[0, -1] else None for c in counted]
    epochs = [_epochs(int(c[0, -1] / max(1, n // SHARD_ROWS))) for c in counted]
    # What only the jobs below need is broadcast by itself, to be destroyed after them: what a function holds stays in the driver's memory until that collects its garbage.
    context = rows.sparkSession.sparkContext
    sent_priors = context.broadcast(priors)
    del counted, whole

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits: dict[int, Fit] = {}
        priors = sent_priors.value
        for data, part, _ in _chunks(batches):
            for fold, prior in enumerate(priors):
                own = [d for d, p in zip(data, part, strict=True) if p != fold]
                if prior is not None and own:
                    if fold not in fits:
                        fits[fold] = Fit.begun(prior, seed)
                    fits[fold].go(own, epochs[fold])
        for fold in list(fits):
            now, begun = fits.pop(fold), Fit.begun(priors[fold], seed)
            moved = now.model.table - begun.model.table
            at = np.flatnonzero(moved.any(1))
            yield from _packed(fold, at, moved[at])
            yield from _packed(fold, np.array([_OTHERS]), (now.dense() - begun.dense())[None, :])

    moves = {}
    for fold, parts in _totals(rows, step).items():
        others = next(total[0] / n[0] for at, total, n in parts if at[0] == _OTHERS)
        parts = [(at, total / n[:, None]) for at, total, n in parts if at[0] != _OTHERS]
        moves[fold] = (np.concatenate([at for at, _ in parts]), np.concatenate([mean for _, mean in parts]), others)
    model = Fit.begun(priors[FOLDS], seed).move(*moves.pop(FOLDS))
    sent_moves = context.broadcast(moves)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {fold: Fit.begun(sent_priors.value[fold], seed).move(*moved) for fold, moved in sent_moves.value.items()}
        for data, part, langs in _chunks(batches, CHUNK_WORDS // 16):
            for fold, own in models.items():
                mine = np.flatnonzero(part == fold)
                if len(mine):
                    x = np.rint(np.clip(own.logits([data[i][0] for i in mine]), -128, 128) * GRAIN).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in mine], pa.string()), pa.array(x), pa.array([data[i][1] for i in mine], pa.int64())], names=["lang", "x", "y"])

    scored = map_batches(rows, score, "lang string, x long, y long").groupBy("lang", "x").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).orderBy("lang", "x").toArrow()
    sent_priors.destroy()
    sent_moves.destroy()
    # A table too small for parts of both labels has rows that no other part's model has scored; they aren't calibrated on.
    if scored.num_rows:
        _calibrate(model, *(scored.column(c).to_numpy() for c in ("x", "hits", "n")), scored.column("lang").to_pylist())
    return model


def _calibrate(model: Model, x: np.ndarray, hits: np.ndarray, n: np.ndarray, langs: list[str]) -> None:
    """Scales logits so that the best cut gets a score of CUT, then finds each language's own; n rows of a language have x / GRAIN, hits of them label 1."""
    x = x / GRAIN
    spread = max(_median(np.abs(x - _median(x, n)), n), 1e-3)
    slope = min(1.0, 4.0 / spread)
    model.scale = (slope, float(np.log(CUT / (1 - CUT)) - slope * best_cut(x, hits, n)))
    scores = 1 / (1 + np.exp(-np.clip(x * model.scale[0] + model.scale[1], -500, 500)))
    for lang in sorted(set(langs)):
        own = np.array([a == lang for a in langs])
        if n[own].sum() >= LANG_ROWS and LANG_TOXIC <= hits[own].sum() < n[own].sum():
            model.cuts[lang] = float(np.clip(best_cut(scores[own], hits[own], n[own]), 0.5, 0.9))


RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("rejected", T.BooleanType())]
)


def _rejects(model: Model | None, scores: np.ndarray, langs: list[str | None]) -> np.ndarray:
    cuts = np.array([model.cuts.get(x or "", CUT) if model is not None else CUT for x in langs])
    return scores >= cuts


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted (at 0.7), rejected (at the language's threshold) for each row of docs."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in g.pieces(batches, 3, _PIECE):
            scores = model.scores(batch.column(3)) if model is not None else np.zeros(batch.num_rows)
            rejected = _rejects(model, scores, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= CUT).astype(np.int32)), pa.array(rejected)], names=RESULT.names)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), lang.alias("lang"), F.col("text").cast("string").alias("text")), judge, RESULT)


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, all columns, that the classifier doesn't reject."""
    text, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in g.pieces(batches, text, _PIECE):
            scores = model.scores(batch.column(text)) if model is not None else np.zeros(batch.num_rows)
            langs = batch.column(lang).to_pylist() if lang is not None else [None] * batch.num_rows
            yield batch.filter(pa.array(~_rejects(model, scores, langs)))

    return map_batches(docs, clean, docs.schema)
