"""Knowledge graphs as DataFrames of distinct triples, their indexes and statistics, and the evaluation of rules."""

from __future__ import annotations

import time
import warnings
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .measures import SCHEMA
from .operators import index
from .operators.store import kept, kept_parts
from .plans import planner
from .rules import Rule, display, parse_json_rule, parse_line


class KnowledgeGraph:
    """A set of (s, p, o) triples. A context manager; ``close`` frees what is kept in memory."""

    def __init__(self, spark: SparkSession, triples: DataFrame, prefixes: Mapping[str, str] | None = None, persist: bool = False, distinct: bool = False):
        """``distinct``: the triples are distinct and without nulls already."""
        self.spark, self.prefixes = spark, dict(prefixes or {})
        self.triples = triples.select("s", "p", "o")
        if not distinct:
            self.triples = self.triples.where("s is not null and p is not null and o is not null").dropDuplicates(["s", "p", "o"])
        self._parts: dict[str, DataFrame] | None = None
        if persist:
            self.triples = self.triples.persist(StorageLevel.MEMORY_AND_DISK)
        self.persisted = persist
        self._sizes: dict[str, int] = {}
        self._fans: dict[str, planner.Stats] = {}
        self._stats: dict[str, planner.Stats] = {}

    @classmethod
    def load(cls, spark: SparkSession, path: str, persist: bool = True, **options) -> KnowledgeGraph:
        """A Turtle file or folder of files; names that end in .tsv are edge lists, read with the ``options`` of ``tsv.read``."""
        from .sources import tsv, turtle

        if path.endswith(".tsv"):
            return cls(spark, tsv.read(spark, path, **options), persist=persist)
        return cls(spark, turtle.read(spark, path), turtle.prefixes(spark, path), persist)

    @classmethod
    def of_parts(cls, spark: SparkSession, parts: Mapping[str, DataFrame]) -> KnowledgeGraph:
        """From the distinct (s, o) of each predicate, without nulls."""
        out = cls(spark, reduce(DataFrame.unionAll, [df.select("s", F.lit(p).alias("p"), "o") for p, df in parts.items()]), distinct=True)
        out._parts = dict(parts)
        return out

    def stored(self) -> KnowledgeGraph:
        """The same graph with its distinct triples written once to the shared folder, a folder for each predicate.

        Every atom then reads only its predicates' files, and nothing is made distinct again. Predicates that are known apart are
        written as they come; else all triples are brought together by predicate first.
        """
        out = KnowledgeGraph(self.spark, self.triples, self.prefixes, distinct=True)
        out.triples = kept_parts(self.spark, self._parts, "p").select("s", "p", "o") if self._parts else kept(self.triples, "p")
        out._sizes, out._fans, out._stats = dict(self._sizes), dict(self._fans), dict(self._stats)
        return out

    def __enter__(self) -> KnowledgeGraph:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.persisted:
            self.triples.unpersist()
            self.persisted = False

    def memory(self) -> int:
        """Bytes of the triples by the optimizer's estimate."""
        return int(str(self.triples._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def admit(self, most: int) -> KnowledgeGraph:
        """The graph itself, kept in memory if the estimate is within so many bytes; else as it is, with a warning, read from its
        source (or its stored files) by every atom."""
        need = self.memory()
        if need > most:
            warnings.warn(f"about {need} bytes of triples are beyond the {most} allowed; they stay on disk", stacklevel=2)
        elif not self.persisted:
            self.triples, self.persisted = self.triples.persist(StorageLevel.MEMORY_AND_DISK), True
        return self

    def sizes(self, predicates: Iterable[str]) -> dict[str, int]:
        """Distinct triples of each given predicate; one job for all that aren't known yet."""
        self.fans(predicates)
        return self._sizes

    def fans(self, predicates: Iterable[str]) -> dict[str, planner.Stats]:
        """Triples of each given predicate and about how many distinct ends, which no triple is dealt for; greatest fan-outs only
        where ``stats`` has counted them."""
        new = sorted(set(predicates) - self._fans.keys())
        if new:
            ends = [F.approx_count_distinct(c).alias(c) for c in ("s", "o")]
            rows = self.triples.where(F.col("p").isin(new)).groupBy("p").agg(F.count("*").alias("n"), *ends).collect()
            found = {r.p: planner.Stats(r.n, r.s, r.o) for r in rows}
            self._fans.update({p: found.get(p, planner.Stats()) for p in new})
            self._sizes.update({p: self._fans[p].n for p in new})
        return self._fans | self._stats

    def stats(self, predicates: Iterable[str]) -> dict[str, planner.Stats]:
        """Triples, distinct ends and greatest fan-outs of each given predicate; one row of each reaches the driver."""
        new = sorted(set(predicates) - self._stats.keys())
        if new:
            rows = index.predicate_stats(self.triples.where(F.col("p").isin(new))).collect()
            self._stats.update({r.p: planner.Stats(r.n, r.n_subj, r.n_obj, r.max_fan_spo, r.max_fan_pos) for r in rows})
            self._stats.update({p: planner.Stats() for p in new if p not in self._stats})
            self._sizes.update({p: self._stats[p].n for p in new})
        return self._stats

    # -- evaluation ----------------------------------------------------------------------------------------------------

    def rule(self, text: str | Rule) -> Rule:
        return text if isinstance(text, Rule) else parse_line(text, self.prefixes)

    def evaluate(self, rule: str | Rule, repeat: int = 1, **options) -> dict:
        """The measures of one rule, with the milliseconds taken: the least and the mean of so many runs."""
        took = []
        for _ in range(max(1, repeat)):
            began = time.perf_counter()
            row = self.measures([rule], **options).collect()[0].asDict()
            took.append((time.perf_counter() - began) * 1000)
        return row | {"ms": min(took), "ms_mean": sum(took) / len(took), "runs": len(took)}

    def evaluate_json(self, text: str, **options) -> dict:
        return self.evaluate(parse_json_rule(text, self.prefixes), **options)

    def measures(self, rules: Iterable[str | Rule], zero_support_body: str = "count", cross_limit: int | None = planner.CROSS, batch: bool = True, budget: float = planner.GROUNDINGS) -> DataFrame:
        """A row of measures for each rule, numbered in order. Rules, and rows of their measures, are few: thousands.

        ``zero_support_body``: "skip" reports a body size of 0 where the support is 0. ``cross_limit``: rows that the product of
        unconnected body parts may have by estimate (None: any). ``batch``: rules of one shape share their joins, so many
        at a time that the estimated groundings are within ``budget``.
        """
        listed = dict(enumerate(self.rule(r) for r in rules))
        named = {a.p for r in listed.values() for a in (*r.body, r.head)}
        stats, sizes = self.fans(named), self.sizes(named)
        together = {i: r for i, r in listed.items() if batch and planner.batchable(r)}
        counts = [planner.batched(self.triples, together, sizes, stats, budget)] if together else []
        for i, r in listed.items():
            if i not in together:
                counts += self._alone(i, r, sizes, cross_limit, stats)
        names = planner.given(self.spark, [(i, display(r), sizes[r.head.p]) for i, r in listed.items()], "rule_id int, rule string, head_size long")
        heads = self._head_support(listed, sizes)
        if counts:
            found = reduce(DataFrame.unionByName, counts).groupBy("rule_id").agg(F.sum("support").alias("support"), F.sum("body_size").alias("body_size"))
            names = names.join(F.broadcast(found), "rule_id", "left")
        else:
            names = names.withColumns({"support": F.lit(0), "body_size": F.lit(0)})
        out = names.join(F.broadcast(heads), "rule_id", "left")
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("support", "body_size", "head_support")})
        if zero_support_body == "skip":
            out = out.withColumn("body_size", F.when(F.col("support") > 0, F.col("body_size")).otherwise(F.lit(0).cast("long")))
        share = lambda d: F.when(F.col(d) > 0, F.col("support") / F.col(d)).otherwise(F.lit(0.0))
        out = out.withColumns({"head_coverage": share("head_size"), "confidence": share("body_size")})
        return out.select(*(x.split()[0] for x in SCHEMA.split(", ")))

    def _alone(self, i: int, r: Rule, sizes: Mapping[str, int], limit: int | None, stats: Mapping[str, planner.Stats]) -> list[DataFrame]:
        at, zero = F.lit(i).alias("rule_id"), F.lit(0).cast("long")
        if planner.batchable(r):
            return [planner.one_pass(self.triples, r, sizes, stats).select(at, "support", "body_size")]
        support, pairs = planner.general(self.triples, r, sizes, limit, stats)
        out = []
        if support is not None:
            out.append(support.agg(F.count("*").alias("support")).select(at, "support", zero.alias("body_size")))
        if pairs is not None:
            out.append(pairs.agg(F.count("*").alias("body_size")).select(at, zero.alias("support"), "body_size"))
        return out

    def _head_support(self, rules: Mapping[int, Rule], sizes: Mapping[str, int]) -> DataFrame:
        """(rule_id, head_support): by statistics for heads of variables, one job for all others."""
        rows = [(i, r.head.p, None if r.head.s.is_var else r.head.s.value, None if r.head.o.is_var else r.head.o.value) for i, r in rules.items()]
        free = planner.given(self.spark, [(i, sizes[p]) for i, p, s, o in rows if s is None and o is None], "rule_id int, head_support long")
        fixed = [x for x in rows if x[2] is not None or x[3] is not None]
        if not fixed:
            return free
        asked = planner.given(self.spark, fixed, "rule_id int, hp string, hs string, ho string")
        on = (F.col("p") == F.col("hp")) & (F.col("hs").isNull() | (F.col("s") == F.col("hs"))) & (F.col("ho").isNull() | (F.col("o") == F.col("ho")))
        return free.unionByName(self.triples.where(F.col("p").isin(sorted({x[1] for x in fixed}))).join(F.broadcast(asked), on).groupBy("rule_id").agg(F.count("*").alias("head_support")))

