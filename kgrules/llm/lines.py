"""Fuzzy line deduplication: character-shingle MinHash, high-recall bands, exact Jaccard, one line kept per component.

Lines are split at "\\n"; a line's set are the distinct runs of 8 code points of the stripped, lower-cased line (the whole
line if shorter). Lines with 100 * intersection >= 80 * union are linked; of each component the occurrence with the
smallest (doc_id, line number) stays, all others are cut from their documents. Stripped, lower-cased lines are known by a
64-bit hash; those that differ but have equal sets have equal bands and are linked like any others.

Cases: blank lines are no lines here and always stay. A null text stays null, an empty one empty. Rows with a null doc_id
come through unchanged. Rows that repeat a doc_id are one document: equal rows keep the same lines. All other columns,
whatever their names, are carried along. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices, unused
from .near import Circulant, char_runs, char_shingles, link

#: 14 bands of 4: a pair at 0.8 meets in no band with a probability of 6e-4, at 0.85 of 3e-5.
SHINGLE, BANDS, ROWS, PLACES = 8, 14, 4, 1 << 16
#: Lines of a partition whose ids it remembers.
SEEN = 1 << 18
#: Lines up to LONG code points are shingled together, about PASS code points at a time; longer ones alone.
LONG, PASS = 1 << 14, 1 << 18


def line_set(line: str) -> np.ndarray:
    return char_shingles(line.strip().lower(), SHINGLE)


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.strip().lower().encode("utf-8", "surrogatepass")) - (1 << 63)


def signed(plain: list[str], circulant: Circulant) -> tuple[np.ndarray, np.ndarray]:
    """Set size and band keys of each line, stripped and lower-cased."""
    n, keys = np.empty(len(plain), np.int64), np.empty((len(plain), circulant.bands), np.int64)
    together = [i for i, p in enumerate(plain) if SHINGLE <= len(p) <= LONG]
    while together:
        size = stop = 0
        while stop < len(together) and stop < 1 << 16 and size < PASS:
            size += len(plain[together[stop]])
            stop += 1
        part, together = together[:stop], together[stop:]
        runs, start, size, n[part] = char_runs([plain[i] for i in part], SHINGLE)
        keys[part] = circulant.keys_of(runs, start, size)
    for i, p in enumerate(plain):
        if not SHINGLE <= len(p) <= LONG:
            s = char_shingles(p, SHINGLE)
            n[i], keys[i] = len(s), circulant.keys([s])[0]
    return n, keys


def occurrences(docs: DataFrame, circulant: Circulant) -> DataFrame:
    """(doc_id, line_no, id, n, bands) of each line that isn't blank; bands are null where a partition repeats a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of: dict[int, int] = {}
        for x in slices(batches):
            count, at, ids, place, new = [], [], [], [], []
            if len(ids_of) > SEEN:
                ids_of.clear()
            for t in x.column("text").to_pylist():
                lines = (t or "").split("\n")
                full = [i for i, line in enumerate(lines) if line and not line.isspace()]
                count.append(len(full))
                at += full
                for line in map(lines.__getitem__, full):
                    k = ids_of.get(key := hash(line))
                    if k is None:
                        plain = line.strip().lower()
                        ids_of[key] = k = xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63)
                        place.append(len(ids))
                        new.append(plain)
                    ids.append(k)
            n, keys = signed(new, circulant)
            sizes, bands = np.zeros(len(ids), np.int64), [None] * len(ids)
            sizes[place] = n
            raw, wide = keys.tobytes(), 8 * circulant.bands
            for k, i in enumerate(place):
                bands[i] = raw[k * wide : k * wide + wide]
            owner = x.column("doc_id").take(pa.array(np.repeat(np.arange(len(count)), count)))
            yield pa.RecordBatch.from_arrays([owner, pa.array(at, pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes), pa.array(bands, pa.binary())], ["doc_id", "line_no", "id", "n", "bands"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line_no int, id long, n long, bands binary")


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in slices(batches):
        ids, texts = [], []
        for t, at in zip(x.column("text").to_pylist(), x.column("at").to_pylist(), strict=True):
            lines = t.split("\n")
            for a in at:
                if a["line_no"] < len(lines) and line_id(lines[a["line_no"]]) == a["id"]:
                    ids.append(a["id"])
                    texts.append(lines[a["line_no"]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "text"])


def cuts(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, cut array<struct<line_no, own>>): each document's lines whose component has others; ``own`` is the component where
    it begins in this document, whose first line of it stays."""
    occ = scratch.keep(occurrences(docs, Circulant(BANDS, ROWS, PLACES)))
    firsts = occ.where("n > 0")  # those with bands, without reading these

    def texts(ids: DataFrame) -> DataFrame:
        at = firsts.join(ids.hint("shuffle_hash"), "id", "left_semi").select("id", "doc_id", "line_no").dropDuplicates(["id"])
        at = at.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "id")).alias("at"))
        return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(at.hint("shuffle_hash"), "doc_id").select("text", "at").mapInArrow(_pick, "id long, text string")

    comp = link(firsts.select("id", "n", "bands"), BANDS, texts, line_set, percent, scratch)
    # the first document of each line that repeats or is linked, then of its component; a line is one row here, however common
    lines_ = occ.groupBy("id").agg(F.min("doc_id").alias("d0"), F.count("*").alias("k")).join(comp.hint("shuffle_hash"), "id", "left")
    lines_ = scratch.keep(lines_.where("k > 1 or comp is not null").select("id", F.coalesce("comp", "id").alias("comp"), "d0", "k"))
    first = lines_.groupBy("comp").agg(F.min("d0").alias("d0"), F.sum("k").alias("k")).where("k > 1").select("comp", "d0")
    first = scratch.keep(lines_.select("id", "comp").join(first, "comp").select("id", "comp", "d0"))
    gone = occ.select("doc_id", "line_no", "id").join(first.hint("shuffle_hash"), "id")
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", F.when(F.col("doc_id") == F.col("d0"), F.col("comp")).alias("own"))).alias("cut"))
    gone = scratch.keep(gone)
    scratch.drop(occ, lines_, first)
    return gone


def _cut(rows: list[dict]) -> set[int]:
    """The lines to cut: all but the first of each component that begins here."""
    first: dict[int, int] = {}
    for r in rows:
        if r["own"] is not None:
            first[r["own"]] = min(r["line_no"], first.get(r["own"], r["line_no"]))
    return {r["line_no"] for r in rows if first.get(r["own"]) != r["line_no"]}


def deduplicate(docs: DataFrame, percent: int = 80, counts: bool = False) -> DataFrame:
    """``docs`` with the text's repeated lines cut; with ``counts`` also n_lines and n_kept of lines that aren't blank
    (under other names where ``docs`` has these, see ``unused``).

    Where a column n_chars is there, it is set to the new text's length.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    id_, cut_ = unused(docs, "id", "cut")
    gone = cuts(docs, percent, scratch).select(F.col("doc_id").alias(id_), F.col("cut").alias(cut_))
    joined = docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == gone[id_], "left").drop(id_)
    names, counted = docs.columns, unused(docs, "n_lines", "n_kept")
    k, sized = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            texts, total, left = [], [], []
            for t, cut in zip(x.column(k).to_pylist(), x.column(len(names)).to_pylist(), strict=True):
                lines = [] if t is None else t.split("\n")
                full = len(lines) - lines.count("") - sum(map(str.isspace, lines))
                gone_ = _cut(cut) if cut and t is not None else ()
                if gone_:
                    t = "\n".join(s for i, s in enumerate(lines) if i not in gone_)
                texts.append(t)
                total.append(full)
                left.append(full - len(gone_))
            columns = list(x.columns[: len(names)])
            columns[k] = pa.array(texts, x.schema.field(k).type)
            if sized is not None:
                columns[sized] = pa.array([None if t is None else len(t) for t in texts], x.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(left, pa.int64())], [*names, *counted])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counted)])
    out = joined.select(*names, cut_).mapInArrow(run, schema)
    return out if counts else out.where((F.col(counted[0]) == 0) | (F.col(counted[1]) > 0)).select(*names)
