"""Shared helpers of the corpus operators: folds, scratch tables, id handling."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.store import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table, by whatever file system ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(modulus))


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about so many bytes, as Python's objects take several times the room of Arrow's."""
    for x in batches:
        rows = max(1, x.num_rows * size // max(x.get_total_buffer_size(), 1))
        for lo in range(0, x.num_rows, rows):
            yield x.slice(lo, rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores after them as it takes to differ from all columns of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables written to the shared folder. They cut the lineage, so that a lost executor costs a reread, not a recomputation.

    ``drop`` removes a table that later steps no longer read; what is left goes with the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        # hashes, keys and texts: dictionaries of their values would be built in vain
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        # the shuffle files of a finished step are only freed once the driver collects its garbage
        self.spark.sparkContext._jvm.System.gc()
        return out

    def counted(self, df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
        """``keep``, and how many rows meet the condition, counted as they are written."""
        seen = Observation()
        out = self.keep(df.observe(seen, F.count(F.when(F.expr(condition), 1)).alias("n")))
        return out, seen.get["n"]

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
