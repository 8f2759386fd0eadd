"""Index and statistics operators over a DataFrame of distinct triples (s, p, o)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept


def of_predicate(triples: DataFrame, p: str) -> DataFrame:
    return triples.where(F.col("p") == p)


def pair_counts(triples: DataFrame) -> DataFrame:
    """(p, n): distinct pairs of each predicate."""
    return triples.groupBy("p").agg(F.count("*").alias("n"))


def predicate_stats(triples: DataFrame) -> DataFrame:
    """(p, n, n_subj, n_obj, max_fan_spo, max_fan_pos): two-level aggregates, no distinct over raw pairs."""
    spo = triples.groupBy("p", "s").agg(F.count("*").alias("k")).groupBy("p").agg(F.sum("k").alias("n"), F.count("*").alias("n_subj"), F.max("k").alias("max_fan_spo"))
    pos = triples.groupBy("p", "o").agg(F.count("*").alias("k")).groupBy("p").agg(F.count("*").alias("n_obj"), F.max("k").alias("max_fan_pos"))
    return spo.join(pos, "p").select("p", "n", "n_subj", "n_obj", "max_fan_spo", "max_fan_pos")


def graph_stats(triples: DataFrame) -> DataFrame:
    """(n_triples, n_terms, n_predicates): terms of any position, each known by the first position that it is counted in."""
    each = triples.select(F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(0).alias("at")), F.struct(F.col("p").alias("t"), F.lit(1).alias("at")), F.struct(F.col("o").alias("t"), F.lit(2).alias("at")))).alias("x"))
    counted = each.groupBy("x.t").agg(F.sum(F.when(F.col("x.at") == 1, 1).otherwise(0)).alias("as_p"))
    return counted.agg(F.coalesce(F.sum("as_p"), F.lit(0)).alias("n_triples"), F.count("*").alias("n_terms"), F.count(F.when(F.col("as_p") > 0, 1)).alias("n_predicates"))


def terms(triples: DataFrame) -> DataFrame:
    """(term): the distinct terms; each row gives its three terms at once, so the triples are read once."""
    return triples.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct()


def dictionary(triples: DataFrame) -> DataFrame:
    """(id, term): an id for each term of any position. The table is kept, as ids follow the partitions."""
    return kept(terms(triples).select(F.monotonically_increasing_id().alias("id"), "term"))


#: Predicates whose names every task may hold.
FEW = 100_000


def predicate_names(triples: DataFrame, names: DataFrame) -> DataFrame | None:
    """The names of the predicates alone, for every task to hold, or None if there are too many."""
    found = triples.select(F.col("p").alias("term")).distinct()
    return F.broadcast(names.join(found, "term", "left_semi")) if found.count() <= FEW else None


def encode(triples: DataFrame, names: DataFrame, predicates: DataFrame | None = None) -> DataFrame:
    """Ids in place of terms. With the ``predicates``' own names no triple is dealt by its predicate, of which there are few."""
    for c in ("p", "s", "o"):
        known = predicates if c == "p" and predicates is not None else names
        triples = triples.join(known.select(F.col("id").alias(f"{c}_id"), F.col("term").alias(c)), c).drop(c)
    return triples.select(*(F.col(f"{c}_id").alias(c) for c in ("s", "p", "o")))


def decode(ids: DataFrame, names: DataFrame, predicates: DataFrame | None = None) -> DataFrame:
    for c in ("o", "s", "p"):
        known = predicates if c == "p" and predicates is not None else names
        ids = ids.join(known.select(F.col("id").alias(c), F.col("term").alias(f"{c}_term")), c).drop(c)
    return ids.select(*(F.col(f"{c}_term").alias(c) for c in ("s", "p", "o")))


def adjacency(triples: DataFrame, by: str = "s") -> DataFrame:
    """(p, key, neighbours): the sorted neighbours of each key in one direction."""
    other = "o" if by == "s" else "s"
    return triples.groupBy("p", F.col(by).alias("key")).agg(F.array_sort(F.collect_set(other)).alias("neighbours"))


def neighbours(triples: DataFrame, p: str, s: str | None = None, o: str | None = None) -> DataFrame:
    """Triples of a predicate with one end, both ends or none given."""
    rows = of_predicate(triples, p)
    for side, value in (("s", s), ("o", o)):
        if value is not None:
            rows = rows.where(F.col(side) == value)
    return rows.select("s", "o")


def self_loops(triples: DataFrame, p: str) -> DataFrame:
    return of_predicate(triples, p).where(F.col("s") == F.col("o")).select("s", "o")


def existing(probes: DataFrame, triples: DataFrame) -> DataFrame:
    """The probes (s, p, o) that are triples."""
    return probes.join(triples, ["s", "p", "o"], "left_semi")
