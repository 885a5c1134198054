"""Substring dedup by level-wise doubling.

A window is `window` consecutive words. Levels double up to it, 25 and 50 words by default: windows of
one level that occur in two documents or more are extended to twice their length, and what is repeated
there goes on, until the window's own length is reached or no candidate survives. At the first level
not all windows are shipped: those with the least hash of each run of successive ones are enough,
because every longer window holds one of them, and equal windows hold the same ones.

A word goes if some window over it also starts in a document with a smaller doc_id. So only the least
doc_id of each repeated window is needed, an aggregate that is combined before any shuffle; pairs of
documents are never formed. Equal texts are one class, of which the least doc_id alone is worked on:
every window of its other members starts there too.

Defined results: null, empty or wordless texts have n_words 0 and keep nothing to hash but the empty
string; a null doc_id is neither smaller nor larger than any other, so its words stay and it removes
none; rows with equal doc_id remove nothing from each other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinmill.llm import grams as g
from skeinmill.llm.store import keep, map_batches

WINDOW = 50
#: Length of the first level, in words, at least.
FIRST = 25
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def levels(window: int, first: int) -> list[int]:
    """Lengths that double up to the window, two at least: each is at most twice the one before."""
    if window < 2:
        raise ValueError("a window has two words at least")
    out = [window]
    while out[0] > 1 and (out[0] > first or len(out) == 1):
        out.insert(0, (out[0] + 1) // 2)
    return out


def _scan(batches: Iterator[pa.RecordBatch], length: int, window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, class, n_words, sha256 of all words, chosen windows of the first level)."""
    for batch in g.pieces(batches, 2):
        words = g.words_of(batch.column(2))
        keys, _ = g.windows(words.hashes(), words.ptr, length)
        at = g.winnow(keys, words.ptr, length, window - length + 1)
        shas = [hashlib.sha256(x).hexdigest() for x in words.joined()]
        per_doc = np.diff(np.searchsorted(at, words.ptr))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(words.counts(), pa.int64()), pa.array(shas), g.list_column(g.as_signed(keys[at]), per_doc, pa.int64())], names=["doc_id", "cls", "n_words", "sha", "marks"]
        )


def _extend(batches: Iterator[pa.RecordBatch], length: int, longer: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, class, start, key) of the longer windows that hold a repeated window of the level below."""
    for batch in g.pieces(batches, 2):
        words = g.words_of(batch.column(2))
        marks = batch.column(3)
        hashes, owner = words.hashes(), words.owner()
        short, valid = g.windows(hashes, words.ptr, length)
        offsets = np.frombuffer(marks.buffers()[1], np.int32)[marks.offset : marks.offset + len(marks) + 1]
        flat = np.asarray(marks.values)
        wanted = np.unique(flat[offsets[0] : offsets[-1]].view(np.uint64))
        # Marks of another document of the batch only add candidates.
        at = np.flatnonzero(valid)
        near = np.minimum(np.searchsorted(wanted, short[at]), len(wanted) - 1)
        at = at[wanted[near] == short[at]]
        steps = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(steps, np.maximum(at - (longer - length), words.ptr[owner[at]]), 1)
        np.subtract.at(steps, at + 1, 1)
        starts = np.flatnonzero((np.cumsum(steps[:-1]) > 0) & g.inside(words.ptr, longer))
        keys = g.mix(g.grams(hashes, longer))[starts]
        of = owner[starts]
        for part in range(0, len(starts), 200_000):
            s = slice(part, part + 200_000)
            rows = pa.array(of[s])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array((starts - words.ptr[of])[s].astype(np.int32)), pa.array(g.as_signed(keys[s]))], names=["doc_id", "cls", "start", "key"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(class, n_removed, sha256 of the kept words) from the starts of windows to remove."""
    for batch in g.pieces(batches, 1):
        words, starts = g.words_of(batch.column(1)), batch.column(2)
        ends = np.frombuffer(starts.buffers()[1], np.int32)[starts.offset : starts.offset + len(starts) + 1]
        at = np.asarray(starts.values)[ends[0] : ends[-1]] + np.repeat(words.ptr[:-1], np.diff(ends))
        steps = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(steps, at, 1)
        np.subtract.at(steps, at + window, 1)
        stays = np.cumsum(steps[:-1]) == 0
        gone = np.concatenate([[0], np.cumsum(~stays)])[words.ptr]
        shas = [hashlib.sha256(x).hexdigest() for x in words.joined(stays)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(gone), pa.int64()), pa.array(shas)], names=["cls", "n_removed", "sha"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("cls"), text.alias("text"))
    lengths = levels(window, first)
    scanned = keep(map_batches(own, lambda it: _scan(it, lengths[0], window), "doc_id long, cls binary, n_words long, sha string, marks array<long>"), "scanned")
    heads = scanned.groupBy("cls").agg(F.min("doc_id").alias("head"))
    marks = scanned.where("size(marks) > 0").join(heads, "cls").where("doc_id = head").select("doc_id", "cls", F.explode(F.array_distinct("marks")).alias("key"))
    for length, longer in itertools.pairwise(lengths):
        own_marks = marks.join(_repeated(marks, f"repeated-{length}").select("key"), "key").groupBy("doc_id", "cls").agg(F.collect_set("key").alias("marks"))
        texts = own.join(own_marks, ["doc_id", "cls"]).select("doc_id", "cls", "text", "marks")
        marks = keep(map_batches(texts, lambda it, a=length, b=longer: _extend(it, a, b), "doc_id long, cls binary, start int, key long"), f"level-{longer}")
    starts = marks.join(_repeated(marks, f"repeated-{window}"), "key").where("doc_id > least").groupBy("doc_id", "cls").agg(F.collect_set("start").alias("starts"))
    cut = map_batches(own.join(starts, ["doc_id", "cls"]).select("cls", "text", "starts"), lambda it: _cut(it, window), "cls binary, n_removed long, sha string").dropDuplicates(["cls"])
    state = heads.join(cut.withColumnRenamed("sha", "cut_sha"), "cls", "left")
    is_copy = (F.col("doc_id") > F.col("head")) & (F.col("n_words") >= window)
    is_head = F.col("doc_id") == F.col("head")
    return scanned.drop("marks").join(state, "cls").select(
        "doc_id", "n_words",
        F.when(is_copy, F.col("n_words")).when(is_head & F.col("n_removed").isNotNull(), F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(is_copy, F.lit(_EMPTY_SHA)).when(is_head & F.col("n_removed").isNotNull(), F.col("cut_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def _repeated(marks: DataFrame, label: str) -> DataFrame:
    """(key, least): windows that start in two documents or more, and the least doc_id of each.

    Written, so that what joins it by key reads two plain tables, of which a frequent key's rows are split.
    """
    return keep(marks.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key", "least"), label)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rn, doc_id, p, sha256(array_to_string(list_slice(ws, p, p + 49), ' ')) AS k FROM (SELECT rn, doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50)),
l AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
hit AS (SELECT w.rn, w.p FROM w JOIN l USING (k) WHERE w.doc_id > l.least),
gone AS (SELECT DISTINCT rn, unnest(range(p, p + 50)) AS p FROM hit),
word AS (SELECT rn, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT word.rn, string_agg(word, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.rn = gone.rn AND word.p = gone.p GROUP BY word.rn)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rn)
"""
