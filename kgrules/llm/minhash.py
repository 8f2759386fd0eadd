"""Near-duplicate documents by circulant MinHash: banded candidates, exact Jaccard verification, connected components.

Cases: a null text counts as empty, and an empty or white-space text has an empty set and is linked with nothing. A row
with a null doc_id is linked with nothing, has a null component and is kept. Rows that repeat a doc_id count as one
document that owns each of their texts; each of the rows is returned. Columns besides doc_id and text are ignored by
``components_of`` and carried along by ``deduplicate``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .near import Circulant, link, set_key, word_shingles

#: 40 bands of 6 coordinates: a pair at the threshold of 0.8 meets in no band with a probability of 5e-6, one of 0.3 in
#: some band with 0.03.
BANDS, ROWS = 40, 6


def features(docs: DataFrame, words: int, circulant: Circulant) -> DataFrame:
    """(doc_id, n, set_key, bands) for each row; set_key identifies equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            sets = [word_shingles(t, words) for t in x.column("text").to_pylist()]
            raw, wide = circulant.keys(sets).tobytes(), 8 * circulant.bands
            yield pa.RecordBatch.from_arrays(
                [x.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([raw[i * wide : i * wide + wide] for i in range(len(sets))], pa.binary())],
                ["doc_id", "n", "set_key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, set_key binary, bands binary")


def components_of(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; component_id is the smallest doc_id that links reach.

    Documents are linked if their sets of ``words``-word shingles have 100 * intersection >= percent * union.
    Equal sets are brought together first, so that a group of copies takes part as one node.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows_ = scratch.keep(features(docs, words, Circulant(bands, rows)))
    linkable = rows_.where("doc_id is not null and n > 0")
    same = scratch.keep(linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    nodes = linkable.join(same.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n", "bands")
    nodes = scratch.keep(nodes)

    def texts(ids: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")

    comp = link(nodes, bands, texts, partial(word_shingles, k=words), percent, scratch)
    # a doc_id that owns several sets ties their classes together
    ties = rows_.where("doc_id is not null and n > 0").join(same, "set_key").select(F.col("doc_id").alias("id"), "rep").where("id <> rep")
    tied = ties.join(nodes.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    tied = scratch.keep(tied.distinct())
    if not tied.isEmpty():
        from .near import components

        comp = components(tied.unionAll(comp.select(F.col("id").alias("a"), F.col("comp").alias("b"))), scratch)
    classes = same.join(comp, same.rep == comp.id, "left").select("set_key", F.coalesce("comp", "rep").alias("class_id"))
    out = rows_.select("doc_id", "n", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component (its smallest doc_id), with all their columns."""
    gone = components_of(docs, words, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
