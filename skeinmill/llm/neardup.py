"""Near-duplicate groups with SetSketch registers.

A document's set is its distinct four-word shingles. Its sketch has BANDS x ROWS registers: each keeps
the least of an exponentially distributed hash over the set, truncated to floor(1 - log_b(min)), so that
values are exponentially spaced. Registers of a union are the larger ones of the parts, and equal with a
probability close to the Jaccard similarity.

1. Equal texts are one class, numbered, of which one sketch is worked on.
2. ROWS successive registers are a band; classes that agree on a band are candidates. A pair at the
   threshold is missed by all bands with a probability of (1 - 0.8**6)**48, about 5e-7.
3. Similarity of a candidate pair is estimated jointly from how many registers are larger, smaller and
   equal, by the likelihood that the sizes of the sets, which are known, and a similarity give these
   counts. Pairs whose estimate lies more than SLACK standard errors under the threshold are left.
4. The rest are confirmed on their full sets, made again from the texts.

Pairs within a bucket aren't all formed. First each member is held against the least member of its
buckets, the most similar first, and links are joined to components. Buckets whose members still are in
several components go on: members outside the largest one are held against its likeliest centre, and
what is apart even then against those members of other components that share a rare enough shingle, a
condition that no linked pair fails. Pairs left out are in one component already or can't be linked, so
that components are those of all links among candidates.

Defined results: a document without words, or a null text, has an empty set and is linked with nothing;
one of fewer than four words has its whole sequence as one shingle; a null doc_id is linked with nothing
and kept, with a null component. Rows that share a doc_id are one node: it is linked by each of its texts, and those of its
rows that have words get its component. `one_of_each` goes by texts instead, so that none is lost when the text that
stands for it goes: of each group of linked texts, not joined by doc_ids, one row stays, of the least doc_id and then the
least digest; rows without words and of null doc_id all stay; of rows alike in doc_id and text one stays, that of
the least hash of all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinmill.llm import grams as g
from skeinmill.llm.components import components, extended
from skeinmill.llm.store import forget, keep, map_batches, named

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 48, 6
#: Base of the spacing and rate of the exponential hashes.
BASE, RATE = 1.001, 20.0
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 6.0

_rng = np.random.default_rng(20240229)
_FACTORS = (_rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)


def shingle_sets(words: g.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ptr): the distinct shingles of each document, sorted."""
    hashes, counts = words.hashes(), words.counts()
    keys, valid = g.windows(hashes, words.ptr, n)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for d, (a, b) in enumerate(zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist(), strict=True)):
        if b - a >= n:
            out.append(np.unique(keys[a : b - n + 1]))
        elif b > a:
            out.append(g.mix(g.grams(hashes[a:b], b - a)[:1] + np.uint64(b - a)))
        else:
            continue
        sizes[d] = len(out[-1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes, as 16-bit numbers."""
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(elements), 2048):
        part = elements[i : i + 2048]
        low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        drawn = low[:, None] * _FACTORS[None, :]
        drawn += high[:, None]
        np.minimum(least, drawn.min(0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype(np.uint16)


def _scan(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, class, set size, registers)"""
    for batch in g.pieces(batches, 2):
        words = g.words_of(batch.column(2), lower=True)
        elements, ptr = shingle_sets(words, n)
        sizes = np.diff(ptr)
        registers = [sketch(elements[a:b]) if b > a else None for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([None if r is None else r.tobytes() for r in registers], pa.binary())], names=["doc_id", "cls", "n", "registers"]
        )


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key) for each band of each class; reads (id, registers)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            keys = _bands(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS))), pa.array(keys.ravel())], names=["id", "key"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, shingles)"""
    for batch in g.pieces(batches, 1):
        elements, ptr = shingle_sets(g.words_of(batch.column(1), lower=True), n)
        yield pa.RecordBatch.from_arrays([batch.column(0), g.list_column(g.as_signed(elements), np.diff(ptr), pa.int64())], names=["id", "shingles"])


def _bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    values = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), values.shape[:2]).copy()
    for r in range(ROWS):
        key = g.mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
    return g.as_signed(key)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """The similarity of most likelihood for each pair of register rows, given the sizes of the sets."""
    more, less = (left > right).sum(1), (left < right).sum(1)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1 - u
    top = np.minimum(u, v) / np.maximum(u, v)
    grid = np.linspace(0, 1, 201)[None, :] * top[:, None]
    spread = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    # Jaccard j: the left set's own share of the union is u - v * j over 1, and likewise for the right.
    p_more = np.clip(spread(u[:, None] - v[:, None] * grid), 1e-12, 1)
    p_less = np.clip(spread(v[:, None] - u[:, None] * grid), 1e-12, 1)
    p_same = np.clip(1 - p_more - p_less, 1e-12, 1)
    likelihood = more[:, None] * np.log(p_more) + less[:, None] * np.log(p_less) + same[:, None] * np.log(p_same)
    return grid[np.arange(len(grid)), likelihood.argmax(1)]


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, estimate) of pairs that may reach the threshold; reads (a, b, n and registers of each)."""
    floor = percent / 100 - SLACK * np.sqrt(percent / 100 * (1 - percent / 100) / (BANDS * ROWS))
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            rows = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in (4, 5)]
            sizes = [part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in (2, 3)]
            guess = estimate(*rows, *sizes)
            keep_ = pa.array(guess >= floor)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep_), part.column(1).filter(keep_), pa.array(guess).filter(keep_)], names=["a", "b", "guess"])


def _confirm(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of pairs whose full sets reach the threshold; reads (a, b, text of a, text of b)."""
    seen: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in g.pieces(g.pieces(batches, 2), 3):
        own, ptr = shingle_sets(g.words_of(batch.column(3), lower=True), n)
        hits = np.zeros(batch.num_rows, bool)
        for i, text in enumerate(batch.column(2).to_pylist()):
            if text != seen[0]:
                seen = (text, shingle_sets(g.words_of(pa.array([text]), lower=True), n)[0])
            b = own[ptr[i] : ptr[i + 1]]
            both = len(np.intersect1d(seen[1], b, assume_unique=True))
            hits[i] = both > 0 and 100 * both >= percent * (len(seen[1]) + len(b) - both)
        flags = pa.array(hits)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(flags), batch.column(1).filter(flags)], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    rows, heads, roots = _grouped(docs, shingle, percent)
    worded = rows.where("n > 0 and doc_id is not null")
    by_doc = keep(worded.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), "doc-classes")
    # A doc_id with several texts links their classes.
    shared = by_doc.where("lo < hi").select("doc_id", "lo")
    roots = extended(roots, worded.join(shared, "doc_id").where("id != lo").select(F.col("lo").alias("a"), F.col("id").alias("b")))
    placed = keep(_rooted(heads, roots), "rooted")
    least = placed.groupBy("root").agg(F.min("head").alias("component"))
    of_doc = by_doc.select("doc_id", F.col("lo").alias("id")).join(placed.select("id", "root"), "id").join(least, "root").select("doc_id", "component")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.join(of_doc, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _digest(text: Column) -> Column:
    """The class of a text: 128 bits of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _rooted(heads: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, cls, head, root) of all classes."""
    return heads.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _grouped(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(each row's doc_id, class and set size, its class's number; the numbered classes that have words and a doc_id, with the least of these; roots of linked classes)"""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("cls"), text.alias("text"))
    scanned = keep(map_batches(own, lambda it: _scan(it, shingle), "doc_id long, cls binary, n long, registers binary"), "sketches")
    # One sketch of each class: copies are combined before the shuffle.
    classes = scanned.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("head"), F.first("registers").alias("registers"))
    nodes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    heads = keep(nodes.select("id", "cls", "head"), "heads")
    rows = keep(scanned.select("doc_id", "cls", "n").join(heads.select("cls", "id"), "cls", "left"), "members")
    forget(scanned)
    roots = _roots(nodes, own, heads, shingle, percent)
    forget(nodes)
    return rows, heads, roots


def _roots(nodes: DataFrame, own: DataFrame, heads: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, root) of classes that are linked with another one."""
    bands = keep(map_batches(nodes.select("id", "registers"), _banded, "id long, key long"), "bands")
    buckets = keep(bands.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "least"), "buckets")
    met = keep(bands.join(buckets, "key"), "met")
    busy = met.groupBy("id").agg(F.lit(1).alias("one")).drop("one")
    # A class's text is that of a row of its least doc_id; other copies aren't shuffled.
    wanted = keep(heads.join(busy, "id").select("id", "cls", "head"), "busy-classes")
    texts = _sifted(own, wanted).join(wanted.select("cls", "id", F.col("head").alias("doc_id")), ["doc_id", "cls"]).dropDuplicates(["doc_id", "cls"])
    texts = keep(texts.select("id", "text"), "busy-texts")
    # Sketches of these few are drawn again, which costs less than shuffling those of all classes.
    again = texts.select(F.col("id").alias("doc_id"), F.lit(None).cast("binary").alias("cls"), "text")
    drawn = keep(map_batches(again, lambda it: _scan(it, shingle), "doc_id long, cls binary, n long, registers binary").select(F.col("doc_id").alias("id"), "n", "registers"), "busy-sketches")
    forget(wanted)
    forget(bands, buckets)

    first = met.where("id != least").groupBy(F.col("least").alias("a"), F.col("id").alias("b")).agg(F.lit(1).alias("one")).drop("one")
    likely = keep(_filtered(first, drawn, percent), "likely")
    best = likely.groupBy("b").agg(F.max(F.struct("guess", (-F.col("a")).alias("a"))).alias("top")).select((-F.col("top.a")).alias("a"), "b")
    links = keep(_confirmed(best, texts, shingle, percent), "links")
    roots = components(links)

    # Buckets whose members are still apart, without members that can't be linked with any of the others.
    apart = _apart(met.select("key", "id"), drawn, roots)
    forget(met, likely, links)
    shingles, shared = _counted(apart, texts, shingle)
    apart = keep(apart.join(shared, "id").where(f"100 * s >= {int(percent)} * n"), "apart-shared")
    # The one with the most shingles in common with others is the likeliest centre of its bucket.
    hubs = keep(apart.where("root = main").groupBy("key").agg(F.max(F.struct("s", "id")).alias("top")).select("key", F.col("top.id").alias("a")), "hubs")
    near = apart.where("root != main").select("key", F.col("id").alias("b")).join(hubs, "key").groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")
    links = keep(_confirmed(_filtered(near, drawn, percent).select("a", "b"), texts, shingle, percent), "hub-links")
    roots = extended(roots, links)
    # What is apart even now: members outside their bucket's largest component meet those that share a rare shingle.
    apart = _apart(apart.select("key", "id", "s"), drawn, roots)
    more = keep(_confirmed(_filtered(_rare_pairs(apart, shingles, percent), drawn, percent).select("a", "b"), texts, shingle, percent), "more-links")
    roots = extended(roots, more)
    forget(drawn, texts, shingles, shared, hubs, links, apart, more)
    return roots


#: Bits of a sieve of classes: so many for each class, as long as the whole has a number that is sent to every task, 32 MiB.
SIEVE_BITS, MOST_BITS = 16, 1 << 28


def _sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose class may be a wanted one: a bitmap of hashes of the wanted classes, of bounded size, goes to every task, so
    that hardly any other text is shuffled. With more classes than it is made for it lets more rows pass, never fewer."""
    return _marked(rows, wanted, "cls").where("held").select(*rows.columns)


def _marked(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """All rows, and whether the sieve of wanted keys passes them as `held`."""
    size = min(MOST_BITS, -(-max(1, wanted.count() * SIEVE_BITS) // 32768) * 32768)
    bit = F.pmod(F.xxhash64(*keys), F.lit(size))
    maps = wanted.select(bit.alias("bit")).selectExpr("bit div 32768 as part", "bit % 32768 as at").groupBy("part").agg(F.bitmap_construct_agg("at").alias("map"))
    held = F.expr("coalesce(bit_get(cast(conv(hex(substring(map, cast(bit % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) = 1, false)")
    return rows.withColumn("bit", bit).withColumn("part", F.expr("bit div 32768")).join(F.broadcast(maps), "part", "left").select(*rows.columns, held.alias("held"))


# What is joined by a bucket or a shingle, of which one may hold a large share of all rows, is written first:
# then both sides are plain tables, and a frequent key's rows are split over several tasks.


def _apart(rows: DataFrame, drawn: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets with several components, with each row's set size and root, and the bucket's main root."""
    known = drawn.select("id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = keep(rows.join(keep(known, "known"), "id"), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    split = parts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return keep(placed.join(keep(split.select("key", F.col("top.root").alias("main")), "split"), "key"), "apart")


def _counted(apart: DataFrame, texts: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """((id, shingle, df): the shingles of these documents, and how many of them have each; (id, s): how many others have, too)"""
    own = texts.join(apart.groupBy("id").agg(F.lit(1).alias("one")).drop("one"), "id").select("id", "text")
    own = keep(map_batches(own, lambda it: _sets(it, shingle), "id long, shingles array<long>").select("id", F.explode("shingles").alias("shingle")), "sets")
    often = keep(own.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    counted = keep(own.join(often, "shingle", "left").select("id", "shingle", F.coalesce("df", F.lit(1).cast("long")).alias("df")), "apart-shingles")
    forget(own, often)
    return counted, keep(counted.where("df > 1").groupBy("id").agg(F.count("*").alias("s")), "shared")


def _rare_pairs(apart: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that may reach the threshold, by prefix filtering.

    Of sets ordered from rare to frequent shingles, a pair with t in common shares one among the first
    n - t + 1 of each. Copies that are apart in spite of a common centre have changes of their own, which
    are rare and fill their prefix, so that hardly any pair is formed for what everybody shares.
    """
    mates = keep(apart.groupBy("key").agg(F.min("n").alias("least")), "mates")
    nodes = apart.join(mates, "key").groupBy("id").agg(
        F.max("n").alias("n"), F.max("s").alias("s"), F.max("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("outside"),
        F.min(F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))).alias("least"),
    )
    needed = F.ceil((F.col("n") + F.col("least")) * percent / (100 + percent) - 1e-9)
    sets = nodes.join(shingles, "id").groupBy("id", "n", "s", "root", "outside", "least").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    heads = sets.select("id", "n", "s", "root", "outside", F.posexplode(F.slice("rare", F.lit(1), F.greatest(F.lit(0), (F.col("n") - needed + 1).cast("int")))).alias("pos", "r"))
    heads = keep(heads.where("r.df > 1").select("id", "n", "s", "root", "outside", "pos", F.col("r.shingle").alias("shingle")), "prefixes")
    left = heads.where("outside").select("shingle", *(F.col(c).alias(c + "_a") for c in ("id", "n", "s", "root", "pos")))
    common = f"ceil((n + n_a) * {int(percent)} / {100 + int(percent)} - 1e-9)"
    met = f"root != root_a and (not outside or id_a < id) and pos <= n - {common} and pos_a <= n_a - {common} and least(s, s_a) >= {common}"
    return heads.join(left, "shingle").where(met).groupBy(F.least("id", "id_a").alias("a"), F.greatest("id", "id_a").alias("b")).agg(F.lit(1).alias("one")).drop("one")


def _filtered(pairs: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    left = drawn.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = drawn.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    rows = pairs.join(right, "b").join(left, "a").where(f"100 * least(na, nb) >= {int(percent)} * greatest(na, nb)")
    return map_batches(rows.select("a", "b", "na", "nb", "ra", "rb"), lambda it: _likely(it, percent), "a long, b long, guess double")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return map_batches(rows, lambda it: _confirm(it, shingle, percent), "a long, b long")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns: one row of each group of linked texts, and all rows without words or doc_id."""
    rows, heads, roots = _grouped(docs, shingle, percent)
    placed = _rooted(heads, roots)
    stays = placed.groupBy("root").agg(F.min(F.struct("head", "cls")).alias("top")).select("top.head", "top.cls")
    worded = rows.where("n > 0 and doc_id is not null").groupBy("doc_id", "cls").agg(F.count("*").alias("copies"))
    gone = worded.join(stays, (worded["doc_id"] == stays["head"]) & (worded["cls"] == stays["cls"]), "left_anti").select("doc_id", "cls", F.lit(False).alias("repeated"))
    repeated = worded.where("copies > 1").join(stays, (worded["doc_id"] == stays["head"]) & (worded["cls"] == stays["cls"]), "left_semi").select("doc_id", "cls", F.lit(True).alias("repeated"))
    told = keep(gone.unionByName(repeated), "gone").select(F.col("doc_id").alias("_doc_id"), F.col("cls").alias("_cls"), "repeated")
    # Columns of any name: rows travel as one column, beside their key.
    columns = named(docs.columns)
    whole = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"), _digest(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_cls"))
    # Rows that a sieve passes may have to go, and are shuffled to see; all others stay where they lie.
    marked = _marked(whole, told.select("_doc_id", "_cls"), "_doc_id", "_cls")
    maybe = keep(marked.where("held").select(*whole.columns), "maybe-gone")
    single = marked.where("not held").select("_row").unionByName(maybe.join(told, ["_doc_id", "_cls"], "left_anti").select("_row"))
    first = maybe.join(told.where("repeated"), ["_doc_id", "_cls"], "left_semi").groupBy("_doc_id", "_cls").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row")
    return single.unionByName(first).select(*(F.col("_row")[c].alias(c) for c in docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + least(len(ws), 4) - 1), ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON c.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
