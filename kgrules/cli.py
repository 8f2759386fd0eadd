"""``python -m kgrules.cli GRAPH RULES [--json]``: the measures of every rule; timing goes to standard error."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .graph import KnowledgeGraph
from .report import as_json, as_text
from .rules import parse_file


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("graph")
    args.add_argument("rules")
    args.add_argument("--json", action="store_true")
    given = args.parse_args(argv)
    spark = SparkSession.builder.appName("kgrules").config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m").getOrCreate()
    began = time.perf_counter()
    with KnowledgeGraph.load(spark, given.graph) as kg:
        # rules are metadata: thousands of lines at most
        text = "\n".join(r.value for r in spark.read.text(given.rules, wholetext=True).collect())
        measures = kg.measures(parse_file(given.rules, text, kg.prefixes)).orderBy("rule_id")
        if given.json:
            rows = as_json(measures).collect()
            print("[" + ",\n".join(r.value for r in rows) + "]")
        else:
            print(as_text(measures.collect(), time.perf_counter() - began))
    print(f"{time.perf_counter() - began:.1f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
