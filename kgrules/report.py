"""Reports over measured rules: text, JSON, summaries, comparisons of logged runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import number_after


def as_text(rows: Iterable, seconds: float | None = None) -> str:
    """A block of lines for each rule, in order; with ``seconds`` also the total time and the mean of a rule."""
    out, n = [], 0
    for r in rows:
        n += 1
        out.append(f"Rule {r['rule_id']}: {r['rule']}")
        out.append(f"  support {r['support']}, head size {r['head_size']}, head support {r['head_support']}, head coverage {r['head_coverage']:.6g}")
        out.append(f"  body size {r['body_size']}, confidence {r['confidence']:.6g}")
    if seconds is not None:
        out.append(f"Total {seconds:.3f} s, {seconds / max(n, 1):.3f} s a rule")
    return "\n".join(out)


def as_json(measures: DataFrame) -> DataFrame:
    """(value): a JSON object for each rule."""
    return measures.select(F.to_json(F.struct(*measures.columns)).alias("value"))


def summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, median, population deviation, least, greatest and 95th percentile (an element of the data)."""
    c = F.col(value).cast("double")
    aggs = [
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.median(c).alias("median"),
        F.stddev_pop(c).alias("stddev"),
        F.min(c).alias("least"),
        F.max(c).alias("greatest"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY CAST({value} AS DOUBLE))").alias("p95"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def body_length(rule: Column) -> Column:
    """Atoms in the body of a displayed rule: parentheses before the arrow (carets also occur in datatypes)."""
    return F.size(F.split(F.substring_index(rule, "=>", 1), r"\( ")) - 1


def runs(lines: DataFrame) -> DataFrame:
    """(impl, rule_id, support_ms, confidence_ms) of log lines (impl, value)."""
    found = lines.select("impl", F.regexp_extract("value", r"rule\s+([0-9]+)", 1).try_cast("int").alias("rule_id"), number_after(F.col("value"), "support ms").alias("support_ms"), number_after(F.col("value"), "confidence ms").alias("confidence_ms"))
    return found.where("rule_id is not null")


def repeated(times: DataFrame) -> DataFrame:
    """(impl, rule_id, n, least_ms, mean_ms, total_ms) over the runs of a rule that the logs hold."""
    ms = F.col("support_ms") + F.col("confidence_ms")
    return times.groupBy("impl", "rule_id").agg(F.count(ms).alias("n"), F.min(ms).alias("least_ms"), F.avg(ms).alias("mean_ms"), F.sum(ms).alias("total_ms"))


def speedup(times: DataFrame, base: str, other: str) -> DataFrame:
    """(rule_id, base_ms, other_ms, ratio): the two implementations' total times side by side."""
    total = times.select("rule_id", "impl", (F.col("support_ms") + F.col("confidence_ms")).alias("ms"))
    wide = total.groupBy("rule_id").pivot("impl", [base, other]).agg(F.min("ms"))
    ratio = F.when(F.col(other) > 0, F.col(base) / F.col(other)).otherwise(F.lit(0.0))
    return wide.select("rule_id", F.col(base).alias("base_ms"), F.col(other).alias("other_ms"), ratio.alias("ratio"))
