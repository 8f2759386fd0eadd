"""Byte-level BPE by recursive DuckDB queries, one database for each partition.

Texts are split by the tokenizer's pattern. Each distinct piece of a partition is encoded once: its bytes become rows of
(word, position, token, next token), which join the merge table; each step of the recursive query contracts every word's
leftmost pair of least rank, and words without a pair drop out, until none is left. Whole pieces that are tokens stay whole.
Ordered aggregation turns token rows into id lists and bytes, first for each word, then for each document.

The vocabulary comes from a rank file whose path is a parameter; the driver reads it and broadcasts its bytes (about 1 MB;
``MOST_RANKS`` bounds it). A partition holds at most ``WORDS`` encoded pieces at a time, and a chunk of about ``CHUNK`` characters.

Cases: a null text counts as empty: no tokens, and the digests of ''. Rows are independent of their ids, so null and repeated
ids give a row each. Strings that look like special tokens are ordinary text. Other columns are ignored. An empty table gives
an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import shutil
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

CHUNK, WORDS, MOST_RANKS = 3_000_000, 300_000, 1_000_000
#: Bytes of words that are contracted together, and rows that a query keeps at a time of words beyond the longest token.
LETTERS, ROWS = 250_000, 1_000_000

# Words longer than the longest token. They are cut into stretches of {span} bytes, no less than the longest token. A step takes
# the least rank of each stretch; neighbours of equal rank are one run. Where the stretches beside a run have higher ranks
# only, nothing that happens elsewhere can reach into the run before its own pairs are contracted, as a token would have to
# grow over a whole stretch. Its pairs of that rank are then contracted from the left, every second one where they overlap,
# up to one whose new token makes a pair of lower rank with a neighbour. So the result is that of one contraction at a time.
ENCODE = """
CREATE OR REPLACE TABLE state AS
WITH RECURSIVE step(w, pos, tok, nt, np, it) AS (
  SELECT w, pos, tok, nt, np, 0 FROM state
  UNION ALL
  (WITH pairs AS (
    SELECT p.w, p.pos, p.np, p.pos // {span} AS part, m.made, m.calm, m.twin FROM step p JOIN merges m ON m.l = p.tok AND m.r = p.nt WHERE p.it < {steps}
  ), best AS (
    SELECT w, part, min(made) AS made FROM pairs GROUP BY w, part
  ), beside AS (
    SELECT *, CASE WHEN lag(part) OVER o = part - 1 THEN lag(made) OVER o END AS before, CASE WHEN lead(part) OVER o = part + 1 THEN lead(made) OVER o END AS after
    FROM best WINDOW o AS (PARTITION BY w ORDER BY part)
  ), run AS (
    SELECT *, count(*) FILTER (before IS DISTINCT FROM made) OVER (PARTITION BY w ORDER BY part) AS run FROM beside
  ), free AS (
    SELECT w, run FROM run GROUP BY w, run HAVING bool_and(coalesce(before, made) >= made AND coalesce(after, made) >= made)
  ), due AS (
    SELECT p.w, p.pos, p.np, p.made, p.calm, p.twin, r.run, CASE WHEN lag(p.np) OVER (PARTITION BY p.w, r.run ORDER BY p.pos) = p.pos THEN 0 ELSE 1 END AS apart
    FROM pairs p JOIN run r ON r.w = p.w AND r.part = p.part AND r.made = p.made SEMI JOIN free f ON f.w = r.w AND f.run = r.run
  ), chain AS (
    SELECT *, sum(apart) OVER (PARTITION BY w, run ORDER BY pos) AS chain FROM due
  ), made AS (
    SELECT c.w, c.run, c.pos AS spot, c.made, c.np AS eaten, n.nt, n.np, c.calm OR coalesce(least(c.twin, x.made, y.made), c.made) >= c.made AS calm
    FROM (SELECT *, row_number() OVER (PARTITION BY w, run, chain ORDER BY pos) AS k FROM chain) c JOIN step n ON n.w = c.w AND n.pos = c.np
    LEFT JOIN step v ON v.w = c.w AND v.np = c.pos LEFT JOIN merges x ON x.l = c.made AND x.r = n.nt LEFT JOIN merges y ON y.l = v.tok AND y.r = c.made
    WHERE c.k % 2 = 1
  ), done AS (
    SELECT * FROM (SELECT *, count(*) FILTER (NOT calm) OVER (PARTITION BY w, run ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wild FROM made) WHERE wild = 0
  )
  SELECT j.w, j.pos, coalesce(a.made, j.tok), CASE WHEN z.made IS NOT NULL THEN z.made WHEN a.made IS NULL THEN j.nt ELSE coalesce(y.made, a.nt) END,
         CASE WHEN a.made IS NULL THEN j.np ELSE a.np END, j.it + 1
  FROM step j LEFT JOIN done a ON a.w = j.w AND a.spot = j.pos LEFT JOIN done z ON z.w = j.w AND z.spot = j.np LEFT JOIN done y ON y.w = j.w AND y.spot = a.np
  WHERE j.w IN (SELECT w FROM done) AND NOT EXISTS (SELECT 1 FROM done e WHERE e.w = j.w AND e.eaten = j.pos))
)
SELECT w, pos, tok, nt, np, it FROM step SEMI JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) USING (w, it)
"""
# Words of one stretch, where each has one pair to contract.
SHORT = """
CREATE OR REPLACE TABLE state AS
WITH RECURSIVE step(w, pos, tok, nt, np, it) AS (
  SELECT w, pos, tok, nt, np, 0 FROM state
  UNION ALL
  SELECT j.w, j.pos,
         CASE WHEN j.pos = b.spot THEN b.made ELSE j.tok END,
         CASE WHEN j.pos = b.spot THEN b.nt WHEN j.np = b.spot THEN b.made ELSE j.nt END,
         CASE WHEN j.pos = b.spot THEN b.np ELSE j.np END,
         j.it + 1
  FROM step j JOIN (
    SELECT h.w, h.best % 4294967296 AS spot, (h.best // 4294967296)::INT AS made, h.eaten, n.nt, n.np
    FROM (SELECT p.w, min(m.made * 4294967296 + p.pos) AS best, arg_min(p.np, m.made * 4294967296 + p.pos) AS eaten
          FROM step p JOIN merges m ON m.l = p.tok AND m.r = p.nt GROUP BY p.w) h
    JOIN step n ON n.w = h.w AND n.pos = h.eaten
  ) b ON b.w = j.w
  WHERE j.pos <> b.eaten
)
SELECT w, pos, tok, nt, np, it FROM step SEMI JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) USING (w, it)
"""
# Ids of words, and the bytes that these ids stand for: of words that are one token, and of those in the table ``state``.
ONE = "INSERT INTO words SELECT w, 1, tok::VARCHAR, decode(unhex(h)) FROM single JOIN vocab ON vocab.id = tok"
DECODE = """
INSERT INTO words
SELECT w, len(l), array_to_string(list_transform(l, lambda x: x.tok), ','), decode(unhex(array_to_string(list_transform(l, lambda x: x.h), '')))
FROM (SELECT w, list({{'tok': tok, 'h': h}} ORDER BY pos) AS l FROM state JOIN vocab ON vocab.id = tok WHERE {done} GROUP BY w)
"""
# One sort serves both aggregates, which take their rows in its order as the database has one thread (an order inside each
# costs a quarter more time). The result is compared with the text, so that another order could not pass.
AGGREGATE = """
SELECT d, sum(n)::BIGINT AS n, string_agg(ids, ',') AS ids, string_agg(piece, '') AS piece
FROM (SELECT d, n, ids, piece FROM pieces JOIN words ON words.w = pieces.w ORDER BY place) GROUP BY d
"""
DIGESTS = f"SELECT d, n, sha256(ids) AS ids, sha256(piece) AS bytes FROM ({AGGREGATE})"
FULL = f"SELECT d, n, ids, piece AS bytes FROM ({AGGREGATE})"


@lru_cache(1)
def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(1)
def merge_table(data: bytes) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """(l, r, made, calm, twin): every split of a token into two, whether the token is in none of lower rank, and the token of it twice; (id, h): hex bytes of each; ids of the 256 single bytes."""
    ranks = ranks_of(data)
    rows = [(ranks[b[:k]], ranks[b[k:]], i) for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks]
    l, r, made = zip(*rows, strict=True) if rows else ((), (), ())
    part_of: dict[int, int] = {}
    twice = {a: i for a, b, i in rows if a == b}
    for a, b, i in rows:
        for x in (a, b):
            part_of[x] = min(i, part_of.get(x, i))
    merges = pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "made": pa.array(made, pa.int64()), "calm": pa.array([part_of.get(i, i + 1) > i for i in made], pa.bool_()), "twin": pa.array([twice.get(i) for i in made], pa.int64())})
    vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "h": pa.array([b.hex() for b in ranks], pa.string())})
    return merges, vocab, np.array([ranks[bytes([i])] for i in range(256)], np.int32)


class Encoder:
    """The DuckDB database of a partition."""

    def __init__(self, data: bytes, folder: str):
        import duckdb

        self.ranks, (merges, vocab, self.single) = ranks_of(data), merge_table(data)
        self.span = max(map(len, self.ranks))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": folder})
        for name, rows in (("merges", merges), ("vocab", vocab)):
            self.con.register("given", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.con.execute("CREATE TABLE words (w INT, n BIGINT, ids VARCHAR, piece VARCHAR)")

    def learn(self, new: list[str]) -> None:
        """Encodes pieces that ``known`` has numbered but ``words`` lacks."""
        whole, short, long = [], [], []
        for w in new:
            b = w.encode()
            i = self.ranks.get(b)
            if i is not None:
                whole.append((self.known[w], i))
            else:
                (short if len(b) <= self.span else long).append((self.known[w], b))
        if whole:
            w, ids = zip(*whole, strict=True)
            self.con.register("single", pa.table({"w": pa.array(w, pa.int32()), "tok": pa.array(ids, pa.int32())}))
            self.con.execute(ONE)
            self.con.unregister("single")
        for words, query in ((short, SHORT), (long, ENCODE)):
            lo = 0
            while lo < len(words):
                hi, size = lo, 0
                while hi < len(words) and (hi == lo or size + len(words[hi][1]) <= LETTERS):
                    size += len(words[hi][1])
                    hi += 1
                self._contract(words[lo:hi], query, max(1, ROWS // size))
                lo = hi

    def _contract(self, words: list[tuple[int, bytes]], query: str, steps: int) -> None:
        """Encodes (number, bytes). A query of long words keeps the rows of so many steps, and is run until none is left."""
        sizes = np.array([len(b) for _, b in words], np.int64)
        signs = np.frombuffer(b"".join(b for _, b in words), np.uint8)
        pos = np.arange(len(signs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = pos == np.repeat(sizes - 1, sizes)
        tok, mask = self.single[signs], pa.array(last)
        after = pa.compute.if_else(mask, None, pa.array(np.roll(tok, -1)))
        letters = pa.table({"w": np.repeat(np.array([i for i, _ in words], np.int32), sizes), "pos": pos, "tok": tok, "nt": after, "np": pa.compute.if_else(mask, None, pa.array(pos + 1))})
        self.con.register("letters", letters)
        self.con.execute("CREATE OR REPLACE TABLE state AS SELECT * FROM letters")
        self.con.unregister("letters")
        if query is SHORT:
            self.con.execute(SHORT)
            self.con.execute(DECODE.format(done="true"))
            return
        while True:
            self.con.execute(query.format(span=self.span, steps=steps))
            self.con.execute(DECODE.format(done=f"it < {steps}"))
            self.con.execute(f"CREATE OR REPLACE TABLE state AS SELECT * FROM state WHERE it >= {steps}")
            if not self.con.execute("SELECT count(*) FROM state").fetchall()[0][0]:
                return

    def documents(self, texts: list[str], split, query: str) -> dict[int, tuple]:
        """By position, (n, ids, bytes) of each text with pieces."""
        if len(self.known) > WORDS:
            self.known.clear()
            self.con.execute("DELETE FROM words")
        before, known, numbers, sizes = len(self.known), self.known, [], []
        for t in texts:
            pieces = split(t)
            sizes.append(len(pieces))
            numbers.append(np.array(list(map(known.__getitem__, pieces)), np.int32))
        if len(known) > before:
            self.learn(list(islice(known, before, None)))
        if not sum(sizes):
            return {}
        w = np.concatenate(numbers)
        self.con.register("pieces", pa.table({"d": np.repeat(np.arange(len(texts), dtype=np.int32), sizes), "place": np.arange(len(w), dtype=np.int64), "w": w}))
        got = self.con.execute(query).fetchall()
        self.con.unregister("pieces")
        return {r[0]: r[1:] for r in got}


def code(docs: DataFrame, rank_file: str, pattern: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids array<int> and the decoded bytes; with ``digests`` the SHA-256 of both instead."""
    with open(rank_file, "rb") as f:
        data = f.read()
    if data.count(b"\n") > MOST_RANKS:
        raise ValueError(f"more than {MOST_RANKS} ranks")
    shared, query, nothing = docs.sparkSession.sparkContext.broadcast(data), DIGESTS if digests else FULL, hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, folder = regex.compile(pattern).findall, tempfile.mkdtemp()
        try:
            encoder = Encoder(shared.value, folder)
            for x in slices(batches):
                texts = [t or "" for t in x.column("text").to_pylist()]
                found, lo = {}, 0
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                        size += len(texts[hi])
                        hi += 1
                    found.update((lo + d, r) for d, r in encoder.documents(texts[lo:hi], split, query).items())
                    lo = hi
                empty = (0, nothing, nothing) if digests else (0, "", "")
                n, ids, made = zip(*(found.get(i, empty) for i in range(len(texts))), strict=True) if texts else ((), (), ())
                for t, b in zip(texts, made, strict=True):
                    if b != (hashlib.sha256(t.encode()).hexdigest() if digests else t):
                        raise ValueError("a text does not come back from its tokens")
                if digests:
                    kept = [pa.array(ids, pa.string()), pa.array(made, pa.string())]
                else:
                    kept = [pa.array([np.array(i.split(","), np.int32) if i else [] for i in ids], pa.list_(pa.int32())), pa.array([b.encode() for b in made], pa.binary())]
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(n, pa.int64()), *kept], ["doc_id", "n_tokens", "ids", "decoded"])
            encoder.con.close()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    kinds = "ids string, decoded string" if digests else "ids array<int>, decoded binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")
