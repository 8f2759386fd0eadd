"""A knowledge graph from relational tables. Every term carries a type, so equal keys of different tables stay apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types whose values have one text each, so keys can be made distinct before they are terms.
PLAIN = ("tinyint", "smallint", "int", "bigint", "string")


def _pair(df: DataFrame, s: str, so: str, o: str, oo: str) -> DataFrame:
    """Distinct (s, o) of two key columns, the rows of a subject together and in order. Keys are dealt before they are made terms,
    as two numbers take less room in a shuffle than two texts; a table's own pairs can't equal those of other types."""
    types = dict(df.dtypes)
    key = lambda c: F.col(c) if types[c] in PLAIN else F.col(c).cast("string")
    term = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    keys = df.select(key(so).alias("a"), key(oo).alias("b")).where("a is not null and b is not null")
    found = keys.repartition("a").dropDuplicates(["a", "b"]).sortWithinPartitions("a", "b")
    return found.select(term(s, "a").alias("s"), term(o, "b").alias("o"))


def parts(spark: SparkSession, sf_dir: str, predicates: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Of each chosen predicate (all if None) the distinct (s, o)."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = lambda where=None: read("lineitem").where(where) if where else read("lineitem")
    makers = {
        "placedBy": lambda: _pair(read("orders"), "o", "o_orderkey", "c", "o_custkey"),
        "inNation": lambda: _pair(read("customer"), "c", "c_custkey", "n", "c_nationkey").unionAll(_pair(read("supplier"), "s", "s_suppkey", "n", "s_nationkey")),
        "inRegion": lambda: _pair(read("nation"), "n", "n_nationkey", "r", "n_regionkey"),
        "hasPart": lambda: _pair(lines(), "o", "l_orderkey", "p", "l_partkey"),
        "fromSupplier": lambda: _pair(lines(), "o", "l_orderkey", "s", "l_suppkey"),
        "suppliedBy": lambda: _pair(lines(), "p", "l_partkey", "s", "l_suppkey"),
        "returnedTo": lambda: _pair(lines("l_returnflag = 'R'"), "p", "l_partkey", "s", "l_suppkey"),
        "bulkFrom": lambda: _pair(lines("l_quantity >= 49"), "p", "l_partkey", "s", "l_suppkey"),
        "buysFrom": lambda: _pair(lines("l_quantity >= 49").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")), "c", "o_custkey", "s", "l_suppkey"),
    }
    return {p: makers[p]() for p in predicates or makers}

