"""A stored lexical index of immutable segments, and pruned search over it.

Under the index's path `segments/` holds a folder for each batch of chunks, which is never changed, and `manifest/` small
versioned files, the newest of which says what segments there are. It is published last, by a rename: a reader sees
whole batches only, a batch whose write broke off isn't listed, and one that is listed already isn't added again.

A segment's chunks are dealt to shards by a hash of their place, SHARD to each or so. A term's postings in a shard are cut
into blocks of BLOCK, those of greatest weight first, with the greatest count and the least length in each, which bound
the weight of its postings in a corpus of any mean length. Files are parted by a hash of the term, so that a
search reads the folders of its terms only.

A search sums weights in arrays over a shard's chunks, a task for each shard, so that postings are shuffled once for all
queries and only k rows of a query leave a shard. First the best block of each term gives every query a threshold, a
score that k chunks reach. Then a block is read only if its bound and the greatest weights of some query's other terms
together reach that query's threshold: all postings of all chunks that can be among the best are read, so that results are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.functions.text import words
from skeinmill.operators.ranking import PLACES, SENT_BYTES, SENT_TERMS, few, top_k
from skeinmill.sinks import manifest as manifests

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks of a shard, about; postings of a block; postings of a folder, about, and folders at most.
SHARD, BLOCK, FOLDER, FOLDERS = 1 << 15, 256, 4_000_000, 1024
#: Bytes of text that are cut into words at once, unless one text is longer.
PIECE = 4 << 20
#: By which a bound may fall short of a threshold, for what sums of doubles differ by.
SLACK = 1e-6

_BLOCKS = "bucket int, term string, shard int, block int, n int, max_tf int, min_dl int, docs array<long>, tfs array<int>, dls array<int>"


class Index(NamedTuple):
    spark: SparkSession
    path: str
    manifest: dict

    @property
    def n(self) -> int:
        return self.manifest["n"]

    @property
    def avgdl(self) -> float | None:
        return self.manifest["words"] / self.n if self.n else None


def pieces(batch: pa.RecordBatch, column: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices of about `size` bytes of a text column, which bounds what is made of them at once."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        yield batch.slice(low, high - low)
        low = high


def postings(chunks: DataFrame) -> DataFrame:
    """(term, pos, tf, dl) of (pos, text), lower-cased and cut at ASCII white space; a row without a term gives a batch's number of chunks and words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, 1)):
            cut = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
            flat = cut.flatten()
            owner = np.repeat(np.arange(len(cut)), np.asarray(cut.value_lengths()))
            real = pc.not_equal(flat, "")
            flat, owner = flat.filter(real), owner[np.asarray(real)]
            coded = flat.dictionary_encode()
            keys, tf = np.unique(owner * max(1, len(coded.dictionary)) + np.asarray(coded.indices), return_counts=True)
            of, code = np.divmod(keys, max(1, len(coded.dictionary)))
            dl = np.bincount(owner, minlength=len(cut))
            terms = pa.concat_arrays([coded.dictionary.take(pa.array(code)), pa.nulls(1, pa.string())])
            places = pa.concat_arrays([batch.column(0).take(pa.array(of)), pa.nulls(1, pa.int64())])
            yield pa.RecordBatch.from_arrays([terms, places, pa.array(np.append(tf, len(cut)), pa.int64()), pa.array(np.append(dl[of], dl.sum()), pa.int64())], names=["term", "pos", "tf", "dl"])

    own = chunks.select(F.col("pos").cast("long").alias("pos"), F.lower("text").alias("text"))
    return own.mapInArrow(counted, "term string, pos long, tf long, dl long")


def _pack(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (bucket, term, shard, pos, tf, dl), which come with each term's together, in order of shard and falling weight."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        starts = _run_starts(rows)
        # The last run may go on in the next batch; no run has more rows than a shard has chunks.
        rest = rows.slice(int(starts[-1]))
        if len(starts) > 1:
            yield _blocks_of(rows.slice(0, int(starts[-1])), starts[:-1], block)
    if rest is not None:
        yield _blocks_of(rest, np.zeros(1, np.int64), block)


def _run_starts(rows: pa.RecordBatch) -> np.ndarray:
    codes, shards = np.asarray(rows.column(1).dictionary_encode().indices), np.asarray(rows.column(2))
    return np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (shards[1:] != shards[:-1])]))


def _blocks_of(rows: pa.RecordBatch, starts: np.ndarray, block: int) -> pa.RecordBatch:
    at = np.arange(rows.num_rows)
    nth = at - np.repeat(starts, np.diff(np.append(starts, rows.num_rows)))
    first = np.flatnonzero(nth % block == 0)
    ends = pa.array(np.append(first, rows.num_rows).astype(np.int32))
    tf, dl = np.asarray(rows.column(4)).astype(np.int32), np.asarray(rows.column(5)).astype(np.int32)
    take = pa.array(first)
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0).take(take), rows.column(1).take(take), rows.column(2).take(take), pa.array((nth[first] // block).astype(np.int32)), pa.array(np.diff(np.append(first, rows.num_rows)).astype(np.int32)),
            pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl, first)),
            pa.ListArray.from_arrays(ends, pa.array(np.asarray(rows.column(3)))), pa.ListArray.from_arrays(ends, pa.array(tf)), pa.ListArray.from_arrays(ends, pa.array(dl)),
        ],
        names=[field.split()[0] for field in _BLOCKS.split(", ")],
    )


def load(spark: SparkSession, path: str) -> Index:
    """The index as its newest manifest has it; one that has never been written is empty."""
    empty = {"version": 0, "segments": [], "n": 0, "words": 0, "mean": None}
    return Index(spark, path, manifests.latest(spark, f"{path}/manifest") or empty)


def batch_of(chunks: DataFrame) -> str:
    """A name that equal batches share, whatever the order of their rows."""
    row = chunks.select(F.xxhash64(F.col("chunk_id").cast("string"), F.col("pos").cast("long"), "text").cast("decimal(38,0)").alias("h"), F.xxhash64("text", F.col("pos").cast("long")).cast("decimal(38,0)").alias("g")).agg(F.count("*"), F.sum("h"), F.sum("g")).first()
    return "-".join("0" if x is None else str(x) for x in row)


def append(spark: SparkSession, path: str, chunks: DataFrame, batch: str | None = None, shard: int = SHARD, block: int = BLOCK) -> Index:
    """Adds a batch of chunks (chunk_id, pos, text) as a segment; texts stored before aren't read.

    `batch` names it, by default by its content. A batch that the index has is left out, so that a run that
    broke off, or that wasn't known to have ended, is repeated as a whole. Places are unique in the index; a null text has
    no words and counts as a chunk. One writer at a time: of two that publish the same version the later one fails.
    """
    before = load(spark, path).manifest
    batch = batch_of(chunks) if batch is None else batch
    if any(batch in s["batches"] for s in before["segments"]):
        return load(spark, path)
    folder = f"{path}/segments/{uuid.uuid4().hex}"
    postings(chunks).write.parquet(f"{folder}/raw")
    chunks.select(F.col("pos").cast("long").alias("pos"), F.col("chunk_id").cast("string").alias("chunk_id")).write.parquet(f"{folder}/chunks")
    return _publish(spark, path, before, [*before["segments"]], _packed(spark, folder, [batch], shard, block))


def _packed(spark: SparkSession, folder: str, batches: list[str], shard: int, block: int) -> dict:
    """Makes the blocks of a segment of its raw postings, and says what the manifest is to hold of it."""
    raw = spark.read.parquet(f"{folder}/raw")
    total = raw.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
    n, n_words = total["n"], total["words"]
    n_postings = raw.where("term is not null").count()
    buckets, shards = min(FOLDERS, max(8, n_postings // FOLDER)), max(1, -(-n // shard))
    weight = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(n_words / n if n_words else 1.0)))
    rows = raw.where("term is not null").select(_bucket("term", buckets).alias("bucket"), "term", F.pmod(F.xxhash64("pos"), F.lit(shards)).cast("int").alias("shard"), "pos", "tf", "dl")
    # By a number first, which is compared faster than a term.
    rows = rows.repartition("bucket", "shard").sortWithinPartitions(F.xxhash64("term"), "term", "shard", weight.desc(), "pos")
    rows.mapInArrow(lambda it: _pack(it, block), _BLOCKS).write.partitionBy("bucket").parquet(f"{folder}/blocks")
    manifests.remove(spark, f"{folder}/raw")
    return {"folder": folder.rsplit("/", 1)[1], "batches": batches, "n": n, "words": n_words, "postings": n_postings, "buckets": buckets, "shards": shards}


def _publish(spark: SparkSession, path: str, before: dict, kept: list[dict], made: dict) -> Index:
    segments = [*kept, made]
    n, n_words = sum(s["n"] for s in segments), sum(s["words"] for s in segments)
    draft = Index(spark, path, {"segments": segments, "n": n, "words": n_words, "mean": None})
    mean = _raw(draft).agg(F.avg("raw")).first()[0]
    manifests.publish(spark, f"{path}/manifest", draft.manifest | {"mean": mean}, before["version"] + 1)
    return load(spark, path)


def compact(spark: SparkSession, path: str, shard: int = SHARD, block: int = BLOCK) -> Index:
    """One segment instead of many, from their postings, not the texts; readers of earlier versions aren't disturbed until `vacuum`."""
    index = load(spark, path)
    if len(index.manifest["segments"]) < 2:
        return index
    folder = f"{path}/segments/{uuid.uuid4().hex}"
    rows = blocks(index).select("term", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")).select("term", F.col("p.docs").alias("pos"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.dls").cast("long").alias("dl"))
    total = spark.createDataFrame([(None, None, index.n, index.manifest["words"])], "term string, pos long, tf long, dl long")
    rows.unionByName(total).write.parquet(f"{folder}/raw")
    chunks(index).write.parquet(f"{folder}/chunks")
    batches = [b for s in index.manifest["segments"] for b in s["batches"]]
    return _publish(spark, path, index.manifest, [], _packed(spark, folder, batches, shard, block))


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes folders of segments that the newest manifest doesn't list, and says how many; not while a batch is being added."""
    listed = {s["folder"] for s in load(spark, path).manifest["segments"]}
    fs, target = manifests._path(spark, f"{path}/segments")
    gone = [s.getPath() for s in fs.listStatus(target) if s.getPath().getName() not in listed] if fs.exists(target) else []
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)


def _bucket(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def blocks(index: Index, terms: DataFrame | None = None) -> DataFrame:
    """All blocks, with the number of their segment; or of some terms, of which the folders alone are read."""
    parts = []
    for k, s in enumerate(index.manifest["segments"]):
        part = index.spark.read.schema(_BLOCKS).parquet(f"{index.path}/segments/{s['folder']}/blocks")
        if terms is not None:
            asked = sorted(r[0] for r in terms.select(_bucket("term", s["buckets"])).distinct().collect())
            part = part.where(F.col("bucket").isin(asked))
        parts.append(part.select(F.lit(k).alias("segment"), *part.columns))
    return _union(parts) if parts else index.spark.createDataFrame([], f"segment int, {_BLOCKS}")


def chunks(index: Index) -> DataFrame:
    parts = [index.spark.read.parquet(f"{index.path}/segments/{s['folder']}/chunks") for s in index.manifest["segments"]]
    return _union(parts) if parts else index.spark.createDataFrame([], "pos long, chunk_id string")


def _raw(index: Index, terms: DataFrame | None = None) -> DataFrame:
    counted = blocks(index, terms) if terms is None else blocks(index, terms).join(terms, "term")
    counted = counted.groupBy("term").agg(F.sum("n").alias("df"), F.max(_bound(index.avgdl)).alias("most"))
    return counted.withColumn("raw", F.ln(F.lit(index.n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))


def _bound(avgdl: float | None) -> Column:
    """The greatest weight in a block, but for the term's idf."""
    return F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + K1 * (1 - B + B * F.col("min_dl") / F.lit(avgdl or 1.0)))


def terms(index: Index, asked: DataFrame | None = None) -> DataFrame:
    """(term, df, idf, most): a term in more than half of the chunks would have a negative weight; it gets EPSILON times the mean weight of all."""
    mean = index.manifest["mean"]
    idf = F.when(F.col("raw") < 0, F.lit(None if mean is None else EPSILON * mean)).otherwise(F.col("raw"))
    return _raw(index, asked).select("term", "df", idf.alias("idf"), "most")


class _Asked:
    """Queries as flat arrays: for each its terms' codes, falling by what they can give, and their weights; thresholds."""

    def __init__(self, asked: pa.Table, known: pa.Table, avgdl: float):
        self.avgdl = avgdl
        self.terms = known.column("term").combine_chunks()
        idf, most = (np.asarray(known.column(c)) for c in ("idf", "most"))
        code = pc.index_in(asked.column("term").combine_chunks(), self.terms)
        hit = code.is_valid()
        ids = asked.column("query_id").combine_chunks().filter(hit).dictionary_encode("encode")
        self.ids, query, code = ids.dictionary, np.asarray(ids.indices), np.asarray(code.filter(hit))
        weight = np.asarray(asked.column("times").combine_chunks().filter(hit)) * idf[code]
        order = np.lexsort((-weight * most[code], query))
        self.code, self.weight = code[order], weight[order]
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=len(self.ids)))])
        self.most = self.weight * most[self.code]
        self.owner = query[order]
        self.sums = np.bincount(self.owner, weights=self.most, minlength=len(self.ids))
        # Bounds hold for weights that aren't negative only; a query with another one has no threshold.
        self.plain = np.bincount(self.owner, weights=self.weight < 0, minlength=len(self.ids)) == 0
        self.bar = np.full(len(self.ids), -np.inf)

    def with_bar(self, scores: dict) -> _Asked:
        places = {q: i for i, q in enumerate(self.ids.to_pylist())}
        for q, score in scores.items():
            if self.plain[places[q]]:
                self.bar[places[q]] = score - SLACK
        return self

    def limits(self) -> pa.Table:
        """(term, limit): blocks whose bound is under the limit can't help any query."""
        need = np.where(self.weight > 0, (self.bar - self.sums)[self.owner] + self.most, -np.inf) / np.where(self.weight > 0, self.weight, 1)
        limit = np.full(len(self.terms), np.inf)
        np.minimum.at(limit, self.code, need)
        return pa.table({"term": self.terms, "limit": limit})


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a shard at once, of rows (segment, shard, ...) in order."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        segment, shard = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        edges = [0, *(np.flatnonzero((segment[1:] != segment[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:], strict=False):
            part = batch.slice(low, high - low)
            if rest and (rest[-1].column(0)[0], rest[-1].column(1)[0]) != (part.column(0)[0], part.column(1)[0]):
                yield pa.concat_batches(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pa.concat_batches(rest)


def _scored(batches: Iterator[pa.RecordBatch], asked: _Asked, k: int) -> Iterator[pa.RecordBatch]:
    """The k best chunks of each shard for each query, of blocks (segment, shard, term, bound, docs, tfs, dls)."""
    for rows in _shards(batches):
        code = np.asarray(pc.index_in(rows.column(2), asked.terms))
        bound = np.asarray(rows.column(3))
        order = np.lexsort((-bound, code))
        rows, code, bound = rows.take(pa.array(order)), code[order], bound[order]
        sizes = np.asarray(rows.column(4).value_lengths())
        ends = np.concatenate([[0], np.cumsum(sizes)])
        tf, dl = (np.asarray(rows.column(c).flatten()).astype(np.float64) for c in (5, 6))
        weights = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / asked.avgdl))
        places, local = np.unique(np.asarray(rows.column(4).flatten()), return_inverse=True)
        first = np.searchsorted(code, np.arange(len(asked.terms) + 1))
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q in range(len(asked.ids)):
            sums = np.zeros(len(places))
            for t in range(asked.ptr[q], asked.ptr[q + 1]):
                low, high = first[asked.code[t]], first[asked.code[t] + 1]
                if asked.weight[t] > 0 and low < high:
                    # Blocks come by falling bounds: those from some place on can't lift a chunk over the threshold.
                    need = (asked.bar[q] - asked.sums[q] + asked.most[t]) / asked.weight[t]
                    high = low + int(np.searchsorted(-bound[low:high], -need, "right"))
                own = slice(ends[low], ends[high])
                sums[local[own]] += asked.weight[t] * weights[own]
            sums = np.round(sums, PLACES)
            may = np.flatnonzero((sums > 0) & (sums >= asked.bar[q]))
            if len(may) > k:
                may = may[sums[may] >= np.partition(sums[may], len(may) - k)[len(may) - k]]
            # Places ascend, so that of equal scores the first chunks stay.
            best = may[np.argsort(-sums[may], kind="stable")[:k]]
            found.append((q, places[best], sums[best]))
        counts = [len(x[1]) for x in found]
        of = np.repeat([x[0] for x in found], counts)
        flat = [np.concatenate([x[c] for x in found]) if found else np.zeros(0) for c in (1, 2)]
        yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(of, pa.int64())), pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.float64())], names=["query_id", "pos", "score"])


def _plan(queries: DataFrame, index: Index, k: int, query_text: str) -> tuple[_Asked | None, DataFrame, DataFrame, DataFrame]:
    """(the queries as arrays with their thresholds, if they are few; the asked terms; their blocks; blocks that are read)"""
    rows = queries.select("query_id", F.explode(words(query_text, lower=True)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    distinct = rows.select("term").distinct()
    if not few(rows, SENT_TERMS, F.octet_length("term") + F.octet_length(F.col("query_id").cast("string")), SENT_BYTES):
        of_terms = blocks(index).join(distinct, "term")
        return None, rows, of_terms, of_terms
    distinct = F.broadcast(distinct)
    known = terms(index, distinct).toArrow()
    asked = _Asked(rows.toArrow(), known, index.avgdl or 1.0)
    of_terms = blocks(index, distinct)
    if max(known.column("df").to_pylist(), default=0) > BLOCK and len(asked.ids):
        heads = _best(of_terms.where("block = 0").join(distinct, "term"), asked, k, queries, index)
        bars = top_k(heads, k).where(F.col("rank") == k).select("query_id", "score").collect()
        asked.with_bar({r["query_id"]: r["score"] for r in bars})
    limits = F.broadcast(index.spark.createDataFrame(asked.limits().to_pandas(), "term string, limit double"))
    return asked, rows, of_terms, of_terms.join(limits, "term").where(_bound(index.avgdl) >= F.col("limit"))


def _best(rows: DataFrame, asked: _Asked, k: int, queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, pos, score): k rows at most of each shard and query."""
    dealt = rows.select("segment", "shard", "term", _bound(index.avgdl).alias("bound"), "docs", "tfs", "dls").repartition("segment", "shard").sortWithinPartitions("segment", "shard")
    return dealt.mapInArrow(lambda it: _scored(it, asked, k), f"query_id {dict(queries.dtypes)['query_id']}, pos long, score double")


def search(queries: DataFrame, index: Index, k: int = 20, query_text: str = "query") -> DataFrame:
    """(query_id, chunk_id, pos, score, rank): the k best chunks with a positive score; a repeated query word counts again.

    Up to SENT_TERMS asked terms, which are counted, go to all tasks as arrays; beyond that postings are joined with them.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not index.manifest["segments"]:
        return queries.limit(0).select("query_id", F.lit("").alias("chunk_id"), F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    asked, rows, of_terms, read = _plan(queries, index, k, query_text)
    if asked is not None:
        best = top_k(_best(read, asked, k, queries, index), k)
        best = F.broadcast(best) if k * len(asked.ids) <= SENT_TERMS else best
    else:
        idf = terms(index).join(rows, "term").select("query_id", "term", "times", "idf")
        hits = of_terms.select("term", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")).join(idf, "term")
        weight = F.col("times") * F.col("idf") * F.col("p.tfs") * (K1 + 1) / (F.col("p.tfs") + K1 * (1 - B + B * F.col("p.dls") / F.lit(index.avgdl)))
        best = top_k(hits.groupBy("query_id", F.col("p.docs").alias("pos")).agg(F.round(F.sum(weight), PLACES).alias("score")), k).where("score > 0")
    return chunks(index).join(best, "pos").select("query_id", "chunk_id", "pos", "score", "rank")


def read_postings(queries: DataFrame, index: Index, k: int = 20, query_text: str = "query") -> DataFrame:
    """One row (asked, read): postings of the queries' terms, and those in blocks that a search reads after its thresholds are known."""
    _, rows, of_terms, read = _plan(queries, index, k, query_text)
    total = of_terms.join(rows.select("term").distinct(), "term").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("asked"))
    return total.crossJoin(read.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read")))
