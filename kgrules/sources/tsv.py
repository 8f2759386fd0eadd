"""Edge lists of three tab-separated columns, and Turtle written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def parse(lines: DataFrame, skip_malformed: bool = False) -> DataFrame:
    """(subject, predicate, object) of lines (value). Blank rows are skipped; rows of another width raise unless skipped."""
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = lines.select("value", cells.alias("c")).where(F.exists("c", lambda x: F.trim(x) != ""))
    good = F.size("c") == 3
    if skip_malformed:
        rows = rows.where(good)
    else:
        rows = rows.select(F.when(good, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("expected 3 columns: "), "value"))).alias("c"))
    return rows.select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("subject", "predicate", "object"))))


def turtle_lines(edges: DataFrame, naming: text.Naming = text.NAMING) -> DataFrame:
    """(value): a Turtle statement for each edge."""
    return edges.select(F.concat_ws(" ", text.entity(F.col("subject"), naming), text.predicate(F.col("predicate"), naming), text.entity(F.col("object"), naming), F.lit(".")).alias("value"))


def prefix_lines(naming: text.Naming = text.NAMING) -> list[str]:
    return [f"@prefix {k.prefix}: <{k.base}> ." for k in naming.kinds]


def write_turtle(edges: DataFrame, path: str, naming: text.Naming = text.NAMING) -> None:
    """Text files, each with the prefixes at its beginning so that it can be read alone."""
    write_statements(turtle_lines(edges, naming), path, prefix_lines(naming))


def write_statements(lines: DataFrame, path: str, head: list[str]) -> None:
    """Text files of lines (value), each with the lines of ``head`` at its beginning."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": head})
        yield from batches

    lines.mapInPandas(run, "value string").write.mode("error").text(path)


def triples(edges: DataFrame, naming: text.Naming = text.NAMING) -> DataFrame:
    """(s, p, o) in full terms."""
    s, p, o = text.entity(F.col("subject"), naming), text.predicate(F.col("predicate"), naming), text.entity(F.col("object"), naming)
    return edges.select(*(text.full(c, naming).alias(n) for c, n in ((s, "s"), (p, "p"), (o, "o"))))


def read(spark: SparkSession, path: str, skip_malformed: bool = False, naming: text.Naming = text.NAMING) -> DataFrame:
    return triples(parse(spark.read.text(path), skip_malformed), naming)


def first(spark: SparkSession, path: str, n: int = 100_000) -> DataFrame:
    """The first n well-formed edges of a file, in its order, or of a folder's files in the order of their names. A limit is the
    point of this operator."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("at"))
    cells = F.split("value", "\t")
    ok = lines.where(F.size(cells) == 3).orderBy("at").limit(n)
    return ok.select(*(F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(("subject", "predicate", "object"))))
