"""Byte-level BPE encoding and decoding by recursive queries in each partition.

A text is cut into words by the vocabulary's pattern. Words that a worker hasn't met yet and that aren't tokens
themselves become token-position rows, a row for each byte, in a DuckDB database that the worker has to itself. A
recursive query joins neighbouring rows with the merge table and contracts each word's leftmost pair of least rank until
no word has a pair. Ids of known words are then put together for each text. Decoding joins ids with the
vocabulary's bytes and concatenates them by an ordered aggregation.

The recursion keeps the rows of all its rounds, about half the square of a word's length, so that words of more than
LONG bytes are contracted in a table that is replaced in each round instead. A round contracts the occurrences of the
least rank from the left on, as far as none of them makes a pair of lower rank: what as many single rounds would do.

Texts are worked on by MANY words at once, however long they are, so that memory is bounded by one text, its ids and
its bytes. A Python worker remembers KNOWN words at most, over its tasks, and then starts anew: a word that it meets
again is contracted again, with the same result.

Defined results: a null text is empty; an empty one has no ids, and empty bytes; rows are kept one by one, so that
repeated and null doc_ids keep their own results; other columns aren't read. The vocabulary has to hold all 256 single bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinmill.llm import grams as g
from skeinmill.llm.store import map_batches

#: Bytes over which a word is contracted without keeping all rounds; words worked on at once; words contracted at once; words remembered.
LONG, MANY, TOGETHER, KNOWN = 200, 1 << 17, 20_000, 1 << 19


class Vocabulary:
    """Ranks by token, the pattern that cuts texts into words, and the merge table: every pair of tokens whose bytes are a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds all single bytes")
        if max(ranks.values()) >= 1 << 31 or min(ranks.values()) < 0:
            raise ValueError("ranks must be numbers of 31 bits")
        self.ranks, self.pattern = ranks, pattern
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = np.array(pairs, np.int64).reshape(-1, 2)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file with a line for each token: its bytes in base64, and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


#: p is a word's number and a place in it. Each round shifts what lies behind the contracted pair by one place.
_CONTRACT = """
WITH RECURSIVE step(n, p, tok) AS (
  SELECT 0, p, tok FROM start_rows
  UNION ALL
  SELECT n + 1, CASE WHEN p > place THEN p - 1 ELSE p END, CASE WHEN p = place THEN rank ELSE tok END
  FROM (
    SELECT n, p, tok, best >> 20 AS rank, p >> 20 << 20 | (best & 1048575) AS place
    FROM step JOIN (
      SELECT a.p >> 20 AS word, min(rank << 20 | (a.p & 1048575)) AS best
      FROM step a JOIN step b ON b.p = a.p + 1 JOIN merges ON pair = (a.tok << 32 | b.tok) GROUP BY 1
    ) ON p >> 20 = word
  ) WHERE p <> place + 1
), ends AS (SELECT p >> 20 AS word, max(n) AS n FROM step GROUP BY 1)
SELECT p >> 20 AS word, tok FROM step JOIN ends ON p >> 20 = word AND step.n = ends.n ORDER BY p
"""

#: One round for long words: `chosen` are occurrences of a word's least rank that don't overlap, `stop` the first that makes a pair of lower rank.
_ROUND = """
CREATE OR REPLACE TABLE contracted AS
WITH pairs AS (SELECT a.word, a.i, rank FROM now a JOIN now b ON b.word = a.word AND b.i = a.i + 1 JOIN merges ON pair = (a.tok << 32 | b.tok)),
least AS (SELECT word, min(rank) AS rank FROM pairs GROUP BY word),
runs AS (SELECT word, i, rank, i - row_number() OVER (PARTITION BY word ORDER BY i) AS run FROM pairs SEMI JOIN least USING (word, rank)),
chosen AS (SELECT word, i, rank FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY i) AS k FROM runs) WHERE k % 2 = 1),
beside AS (
  SELECT c.word, c.i, c.rank, CASE WHEN c2.i IS NOT NULL THEN c.rank ELSE l.tok END AS left_tok, r.tok AS right_tok
  FROM chosen c LEFT JOIN chosen c2 ON c2.word = c.word AND c2.i = c.i - 2 LEFT JOIN now l ON l.word = c.word AND l.i = c.i - 1 LEFT JOIN now r ON r.word = c.word AND r.i = c.i + 2
),
stop AS (
  SELECT word, min(i) AS last FROM beside LEFT JOIN merges x ON x.pair = (left_tok << 32 | beside.rank) LEFT JOIN merges y ON y.pair = (beside.rank << 32 | right_tok)
  WHERE x.rank < beside.rank OR y.rank < beside.rank GROUP BY word
),
taken AS (SELECT c.word, c.i, c.rank FROM chosen c LEFT JOIN stop USING (word) WHERE stop.last IS NULL OR c.i <= stop.last)
SELECT n.word, n.i - count(gone.i) OVER (PARTITION BY n.word ORDER BY n.i) AS i, coalesce(taken.rank, n.tok) AS tok, gone.i IS NOT NULL AS dead
FROM now n LEFT JOIN taken ON taken.word = n.word AND taken.i = n.i LEFT JOIN taken gone ON gone.word = n.word AND gone.i = n.i - 1
"""

_DECODE = "SELECT part, string_agg(bytes, '' ORDER BY i) AS bytes FROM (SELECT part, i, bytes FROM id_rows JOIN vocabulary ON vocabulary.tok = id_rows.tok) GROUP BY part"


class _Database:
    """A worker's own in-memory database with the merge table and the tokens' bytes in hexadecimal digits."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self._fill("merges", pair=vocabulary.pairs[:, 0], rank=vocabulary.pairs[:, 1])
        tokens = list(vocabulary.ranks.items())
        self._fill("vocabulary", tok=np.array([r for _, r in tokens], np.int64), bytes=pa.array([t.hex() for t, _ in tokens]))

    def _fill(self, name: str, **columns: np.ndarray | pa.Array) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, token) for each byte."""
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), sizes)
        return word, np.arange(len(word)) - (np.cumsum(sizes) - sizes)[word], self.vocabulary.single[np.frombuffer(b"".join(words), np.uint8)]

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            word, place, tok = self._rows([words[x] for x in some])
            self._fill("start_rows", p=word << 20 | place, tok=tok)
            self._put(out, some, self.con.sql(_CONTRACT).to_arrow_table())
        for k, w in enumerate(words):
            if len(w) > LONG:
                word, place, tok = self._rows([w])
                self._fill("now", word=word, i=place, tok=tok)
                while True:
                    self.con.execute(_ROUND)
                    changed = self.con.sql("SELECT count(*) FROM contracted WHERE dead").fetchall()[0][0]
                    if not changed:
                        break
                    self.con.execute("CREATE OR REPLACE TABLE now AS SELECT word, i, tok FROM contracted WHERE NOT dead")
                self._put(out, [k], self.con.sql("SELECT word, tok FROM now ORDER BY i").to_arrow_table())
        return out

    @staticmethod
    def _put(out: list[np.ndarray], places: list[int], rows: pa.Table) -> None:
        ids = rows.column("tok").to_numpy().astype(np.uint32)
        ends = np.cumsum(np.bincount(rows.column("word").to_numpy(), minlength=len(places)))
        for k, part in zip(places, np.split(ids, ends[:-1]), strict=True):
            out[k] = part

    def decode(self, parts: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        sizes = np.array([len(x) for x in parts], np.int64)
        out = [b""] * len(parts)
        if sizes.sum():
            ids = np.concatenate(parts).astype(np.int64)
            self.con.register("id_rows", pa.table({"part": np.repeat(np.arange(len(parts)), sizes), "i": np.arange(len(ids)), "tok": ids}))
            rows = self.con.sql(_DECODE).to_arrow_table()
            self.con.unregister("id_rows")
            for part, text in zip(rows.column("part").to_pylist(), rows.column("bytes").to_pylist(), strict=True):
                out[part] = bytes.fromhex(text)
        return out


class _Encoder:
    """Ids of words, remembered by word: codes are places in a flat list of ids."""

    def __init__(self, database: _Database):
        self.database, self.cut = database, regex.compile(database.vocabulary.pattern)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.starts, self.sizes, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, MANY at a time at most if the text is long."""
        if len(text) <= MANY:
            yield self.cut.findall(text)
        else:
            found = (m.group() for m in self.cut.finditer(text))
            while part := list(islice(found, MANY)):
                yield part

    def encode(self, parts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each list of words."""
        words = list(chain.from_iterable(parts))
        # Each word is looked up once; only those that weren't known are again.
        codes = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(codes < 0).tolist()
        new = list(dict.fromkeys(words[i] for i in unknown))
        if len(self.codes) + len(new) > KNOWN and self.codes:
            self._forget()
            new, unknown = list(dict.fromkeys(words)), list(range(len(words)))
        self._learn(new)
        codes[unknown] = [self.codes[words[i]] for i in unknown]
        starts, sizes = self.starts[codes], self.sizes[codes]
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])]
        edges = np.cumsum([len(part) for part in parts])[:-1]
        return np.split(flat, at[edges]) if parts else []

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        ranks, known = self.database.vocabulary.ranks, len(self.codes)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        whole = [ranks.get(w, -1) for w in raw]
        ids = [np.array([max(r, 0)], np.uint32) for r in whole]
        for k, got in zip([k for k, r in enumerate(whole) if r < 0], self.database.contract([w for w, r in zip(raw, whole, strict=True) if r < 0]), strict=True):
            ids[k] = got
        sizes = np.array([len(x) for x in ids], np.int64)
        self.codes.update(zip(new, range(known, known + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids.astype(np.uint32), *ids])


#: The last encoder of this Python worker, by its vocabulary: the next task goes on with what it knows.
_last: dict[str, _Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> _Encoder:
    if vocabulary.key not in _last:
        _last.clear()
        _last[vocabulary.key] = _Encoder(_Database(vocabulary))
    return _last[vocabulary.key]


def _encoded(batches: Iterator[pa.RecordBatch], encoder: _Encoder) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids): reads doc_id and text."""
    for batch in g.pieces(batches, 1):
        found: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
        parts: list[list[str]] = []
        owners: list[int] = []

        def flush() -> None:
            for k, ids in zip(owners, encoder.encode(parts), strict=True):
                found[k].append(ids.astype("<u4").tobytes())  # noqa: B023
            parts.clear()  # noqa: B023
            owners.clear()  # noqa: B023

        waiting = 0
        for k, text in enumerate(batch.column(1).to_pylist()):
            for part in encoder.words(text or ""):
                parts.append(part)
                owners.append(k)
                waiting += len(part)
                if waiting >= MANY:
                    flush()
                    waiting = 0
        flush()
        whole = [b"".join(x) for x in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in whole], pa.int64()), pa.array(whole, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], database: _Database) -> Iterator[pa.RecordBatch]:
    """The rows with the decoded bytes: reads doc_id, n_tokens and ids."""
    for batch in batches:
        sizes, rows = batch.column(1).to_numpy(), [np.frombuffer(x or b"", "<u4") for x in batch.column(2).to_pylist()]
        out: list[bytes] = []
        k = 0
        while k < len(rows):
            many = max(k + 1, k + int(np.searchsorted(np.cumsum(sizes[k:]), 2 * MANY)))
            if many == k + 1 and len(rows[k]) > 2 * MANY:
                out.append(b"".join(database.decode([rows[k][i : i + MANY]])[0] for i in range(0, len(rows[k]), MANY)))
            else:
                out += database.decode(rows[k:many])
            k = many
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens and ids, little-endian 32-bit numbers one after the other, for each row of docs."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(own, lambda it: _encoded(it, _encoder(vocabulary)), f"doc_id {dict(own.dtypes)['doc_id']}, n_tokens long, ids binary")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows of doc_id, n_tokens and ids with `decoded`, the bytes of the ids."""
    own = rows.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "ids")
    return map_batches(own, lambda it: _decoded(it, _encoder(vocabulary).database), f"doc_id {dict(own.dtypes)['doc_id']}, n_tokens long, ids binary, decoded binary")


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What decode(encode(docs)) gives, with one database and one Python worker for both."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        yield from _decoded(_encoded(batches, encoder), encoder.database)

    return map_batches(own, both, f"doc_id {dict(own.dtypes)['doc_id']}, n_tokens long, ids binary, decoded binary")


def oracle(path: str) -> str:
    """The query's rows by SQL alone: recursion over the distinct words of all texts.

    The pattern has a look-ahead, which SQL's doesn't: white space before a word is parted from that word's own blank first.
    """
    blank = r"\t\n\x0B\f\r\x{85}\p{Z}"
    cut = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{blank}\p{{L}}\p{{N}}]+|[{blank}]+".replace("'", "''")
    return rf"""
WITH RECURSIVE vocab AS MATERIALIZED (SELECT hex(from_base64(column0)) AS h, column1::BIGINT AS tok FROM read_csv('{path}', delim=' ', header=false, columns={{'column0': 'VARCHAR', 'column1': 'BIGINT'}}, quote='', escape='')),
merges AS MATERIALIZED (SELECT a.tok << 32 | b.tok AS pair, v.tok AS rank FROM (SELECT h, tok, unnest(range(1, len(h) // 2)) AS k FROM vocab) v JOIN vocab a ON a.h = v.h[1:2*k] JOIN vocab b ON b.h = v.h[2*k+1:]),
docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT rn, part, row_number() OVER (PARTITION BY rn) AS k FROM (SELECT rn, unnest(string_split(regexp_replace(text, '([{blank}]+)([{blank}][^{blank}])', '\1' || chr(57344) || '\2', 'g'), chr(57344))) AS part FROM docs)),
cut AS (SELECT rn, k, list_filter(regexp_extract_all(part, '{cut}'), lambda x: x <> '') AS ws FROM parts),
places AS (SELECT rn, k, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM cut),
words AS MATERIALIZED (SELECT word, row_number() OVER () AS w, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM places)),
step(n, p, tok) AS (
  SELECT 0, w << 20 | i, tok FROM (SELECT w, unnest(range(1, len(h) // 2 + 1)) AS i, h FROM words WHERE h NOT IN (SELECT h FROM vocab)) x JOIN vocab v ON v.h = x.h[2*i-1:2*i]
  UNION ALL
  SELECT n + 1, CASE WHEN p > spot THEN p - 1 ELSE p END, CASE WHEN p = spot THEN rank ELSE tok END
  FROM (SELECT n, p, tok, best >> 20 AS rank, p >> 20 << 20 | (best & 1048575) AS spot FROM step
    JOIN (SELECT a.p >> 20 AS w, min(rank << 20 | (a.p & 1048575)) AS best FROM step a JOIN step b ON b.p = a.p + 1 JOIN merges m ON m.pair = (a.tok << 32 | b.tok) GROUP BY 1) ON p >> 20 = w)
  WHERE p <> spot + 1
), ends AS (SELECT p >> 20 AS w, max(n) AS n FROM step GROUP BY 1),
ids AS (
  SELECT w, list(tok ORDER BY p) AS ids FROM step JOIN ends ON p >> 20 = w AND step.n = ends.n GROUP BY w
  UNION ALL SELECT w, [tok] FROM words JOIN vocab USING (h)
),
flat AS (SELECT rn, k, j, unnest(ids) AS tok, generate_subscripts(ids, 1) AS i FROM places JOIN words USING (word) JOIN ids USING (w)),
whole AS (
  SELECT rn, count(*) AS n, string_agg(printf('%02x%02x%02x00', tok % 256, tok // 256 % 256, tok // 65536), '' ORDER BY k, j, i) AS ids, string_agg(h, '' ORDER BY k, j, i) AS bytes
  FROM flat JOIN vocab USING (tok) GROUP BY rn
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, sha256(unhex(coalesce(ids, ''))) AS ids_sha256, sha256(unhex(coalesce(bytes, ''))) AS decoded_sha256
FROM docs LEFT JOIN whole USING (rn)
"""
