"""Chunkers: table functions from documents to chunks.

Each adds chunk_index, chunk_id, text and strategy to doc_id; documents that are empty after stripping
give none. The recursive and the header chunker are built from higher-order functions; the fixed window
depends on where the one before it ended, so it is an Arrow-batched function.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.functions.text import chunk_id, let, strip

SEPARATORS = ["\n\n", "\n", ". ", " "]
_NONE = "cast(array() as array<string>)"


def fixed_spans(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of windows of `size` that end at their last space, unless they reach the end or have none inside.

    The next window begins `overlap` before that, but after the last chunk's and this window's begin. Places of spaces are
    found at once, in the text's code points as an array, and looked up by bisection: no step goes over characters.
    """
    text = text.strip()
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32).tolist()
    found: list[tuple[int, str]] = []
    begin, floor = 0, 0
    while begin < len(text):
        full = begin + size
        last = bisect_left(spaces, full) - 1
        end = spaces[last] if full < len(text) and last >= 0 and spaces[last] > begin else full
        piece = text[begin:end].strip()
        if piece:
            found.append((begin, piece))
            floor = begin + 1
        begin = max(end - overlap, floor, begin + 1) if end < len(text) and overlap else end
    return found


def fixed_rows(keys: pa.Array, texts: pa.Array, size: int, overlap: int) -> pa.RecordBatch:
    """(doc_id, chunk_index, text, char_start) of a batch of texts."""
    spans = [fixed_spans(t or "", size, overlap) for t in texts.to_pylist()]
    counts = np.array([len(x) for x in spans], np.int64)
    owner = np.repeat(np.arange(len(spans)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = [c for own in spans for c in own]
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(owner)), pa.array(nth.astype(np.int32)), pa.array([t for _, t in flat], pa.string()), pa.array([s for s, _ in flat], pa.int32())], names=["doc_id", "chunk_index", "text", "char_start"]
    )


def fixed(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    own = docs.select("doc_id", "content")
    pieces = own.mapInArrow(lambda it: (fixed_rows(b.column(0), b.column(1), size, overlap) for b in it), f"doc_id {dict(own.dtypes)['doc_id']}, chunk_index int, text string, char_start int")
    return pieces.select("doc_id", "chunk_index", chunk_id("doc_id", "chunk_index").alias("chunk_id"), "text", F.lit("fixed").alias("strategy"), "char_start")


class ChunkFixed:
    """Table function: chunk_fixed(TABLE(rows of doc_id and content), size, overlap), by Arrow batches.

    Lateral joins can't call table functions on Arrow batches, so that it takes a table and gives the doc_id back.
    """

    def eval(self, rows: pa.RecordBatch, size: pa.Array, overlap: pa.Array) -> Iterator[pa.Table]:
        if rows.num_rows:
            made = fixed_rows(rows.column("doc_id").cast(pa.string()), rows.column("content"), size[0].as_py(), overlap[0].as_py())
            yield pa.Table.from_batches([made])


def register(spark: SparkSession) -> None:
    """Makes chunk_fixed known to SQL."""
    spark.udtf.register("chunk_fixed", F.arrow_udtf(ChunkFixed, returnType="doc_id string, chunk_index int, text string, char_start int"))


def _split(x: Column, separators: list[str], size: int) -> Column:
    """Pieces no longer than `size`, by the coarsest separator that does it."""
    if not separators:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / size).cast("int")), lambda i: F.substr(x, i * size + 1, F.lit(size)))
    parts = F.filter(F.transform(F.split(x, r"\Q" + separators[0] + r"\E", -1), strip), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_split(p, separators[1:], size))))


def _merge(pieces: Column, size: int, overlap: int) -> Column:
    """Pieces joined by blank lines up to `size`; a new chunk begins with the last words of the one before, if that fits."""

    def step(state: Column, piece: Column) -> Column:
        def decide(now: Column) -> Column:
            joined = F.concat(now, F.lit("\n\n"), piece)
            tail = F.right(now, F.lit(overlap))
            space = F.locate(" ", tail)
            carried = F.concat(F.when(space > 1, F.substr(tail, space + 1)).otherwise(tail), F.lit("\n\n"), piece)
            fresh = F.when((F.length(now) > overlap) & (F.length(carried) <= size), carried).otherwise(piece) if overlap > 0 else piece
            fits = F.length(joined) <= size
            return F.struct(F.when(fits, state["done"]).otherwise(F.array_append(state["done"], now)).alias("done"), F.when(fits, joined).otherwise(fresh).alias("now"))

        return let(state["now"], decide)

    start = F.struct(F.expr(_NONE).alias("done"), F.get(pieces, F.lit(0)).alias("now"))
    merged = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda s: F.array_append(s["done"], s["now"]))
    return F.when(F.size(pieces) > 0, merged).otherwise(F.expr(_NONE))


def recursive_pieces(text: Column, size: int, overlap: int, separators: list[str] | None = None) -> Column:
    separators = SEPARATORS if separators is None else separators
    whole = lambda x: F.when(x == "", F.expr(_NONE)).when(F.length(x) <= size, F.array(x)).otherwise(_split(x, separators, size))
    return let(strip(text), lambda x: let(whole(x), lambda pieces: _merge(pieces, size, overlap)))


def _pack(header: Column, body: Column, size: int) -> Column:
    """An oversized section by paragraphs; its header leads the first, and a longer paragraph stays whole."""

    def step(state: Column, para: Column) -> Column:
        def decide(bare: Column) -> Column:
            joined = F.when(bare != "", strip(F.concat(state["now"], F.lit("\n\n"), para))).otherwise(para)
            fits = F.length(joined) <= size
            done = F.when(bare != "", F.array_append(state["done"], bare)).otherwise(state["done"])
            return F.struct(F.when(fits, state["done"]).otherwise(done).alias("done"), F.when(fits, joined).otherwise(para).alias("now"))

        return let(strip(state["now"]), decide)

    paragraphs = F.filter(F.transform(F.split(body, r"\n\n+", -1), strip), lambda p: p != "")
    start = F.struct(F.expr(_NONE).alias("done"), F.when(header != "", F.concat(header, F.lit("\n\n"))).otherwise(F.lit("")).alias("now"))
    end = lambda s: F.when(strip(s["now"]) != "", F.array_append(s["done"], strip(s["now"]))).otherwise(s["done"])
    return F.aggregate(paragraphs, start, step, end)


_HEADER = r"(?md)^#{1,6}\s+.+$"


def header_pieces(text: Column, size: int) -> Column:
    """Sections from one header of any level to the next; what stands before the first has none."""

    def section(header: Column, body: Column) -> Column:
        whole = F.when(header != "", strip(F.concat(header, F.lit("\n\n"), body))).otherwise(strip(body))
        return let(whole, lambda w: F.when(w == "", F.expr(_NONE)).when(F.length(w) <= size, F.array(w)).otherwise(_pack(header, body, size)))

    def sections(x: Column) -> Column:
        headers, bodies = F.regexp_extract_all(x, F.lit(_HEADER), F.lit(0)), F.transform(F.split(x, _HEADER, -1), strip)
        return let(headers, lambda hs: let(bodies, lambda bs: F.flatten(F.transform(bs, lambda b, i: section(F.when(i > 0, F.get(hs, i - 1)).otherwise(F.lit("")), b)))))

    return let(strip(text), lambda x: F.when(x == "", F.expr(_NONE)).otherwise(sections(x)))


def _pieces(docs: DataFrame, pieces: Column, strategy: str) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(pieces).alias("chunk_index", "text"))
    return rows.select("doc_id", "chunk_index", chunk_id("doc_id", "chunk_index").alias("chunk_id"), "text", F.lit(strategy).alias("strategy"), F.lit(None).cast("int").alias("char_start"))


def recursive(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    return _pieces(docs, recursive_pieces(F.col("content"), size, overlap), "recursive")


def header(docs: DataFrame, size: int = 512) -> DataFrame:
    return _pieces(docs, header_pieces(F.col("content"), size), "header")


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixed": fixed, "recursive": recursive, "header": header}


def chunk(docs: DataFrame, strategies: list[str] | None = None, size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of (doc_id, content) by each strategy named, in one table."""
    out = None
    for name in strategies or list(CHUNKERS):
        if name not in CHUNKERS:
            raise ValueError(f"unknown chunking strategy {name!r}")
        rows = CHUNKERS[name](docs, size) if name == "header" else CHUNKERS[name](docs, size, overlap)
        out = rows if out is None else out.unionByName(rows)
    return out
