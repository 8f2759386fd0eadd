"""Tables kept in the shared folder, where a later step must see the very rows of an earlier one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a single machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='kept')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def kept(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again; with ``by`` in a folder for each value of that column.

    Rows are brought together by that column first, in parts that are neither tiny nor skewed, so a value has few files.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/kept-{uuid.uuid4().hex}"
    if by:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(*df.columns)


def kept_parts(spark: SparkSession, parts: Mapping[str, DataFrame], by: str) -> DataFrame:
    """Tables of one schema, each written to the folder of its value of the column ``by`` as it comes, and read as one."""
    path = f"{shared_root(spark)}/kept-{uuid.uuid4().hex}"
    for value, df in parts.items():
        df.write.parquet(f"{path}/{by}={quote(value, safe='')}")
    schema = next(iter(parts.values())).schema
    return spark.read.schema(StructType([*schema, StructField(by, StringType())])).parquet(path)
