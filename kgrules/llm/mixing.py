"""Mixing sources to target weights by iterative proportional fitting. DataFrame expressions only.

Token counts are raked to marginals of source, language and topic: ``tokens * a[source] * b[lang] * c[topic]`` with factors
such that each marginal has its target share. Then documents are drawn independently with probabilities proportional to
their factors, scaled so that the expected tokens are ``keep`` of all (where a probability reaches 1 the others rise).

Languages and topics are few (their values are checked against ``MOST``); sources may be many. So a row per source holds its
tokens by language and topic, each sweep reads those rows once, and only sums by language and topic go to the driver.

Targets are weights by value, in any unit: ``source``, ``lang`` and ``topic`` take mappings (``source`` a DataFrame of source and
weight, too, as sources may be many); values without a weight get none and are not drawn, weights of absent values are left
out. Without a mapping sources and languages are in proportion to the square root of their tokens, topics as they
are. A topic is any expression; by default the form of the text: prose, list, code, markup or empty.

Cases: null sources, languages or topics are a value of their own. A null or empty text has no tokens and is drawn with
the scale itself. Equal rows are drawn alike, as the draw hashes the doc_id; a null doc_id hashes as such. Other columns
are carried along, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty, unused

MOST, SWEEPS, TOLERANCE = 256, 30, 1e-6
NONE = "\x00null"


def tokens(text: Column) -> Column:
    """Words, split at ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("double")


def form(text: Column) -> Column:
    """The default topic."""
    return (
        F.when(F.trim(text) == "", "empty")
        .when(text.contains(" | "), "list")
        .when(text.contains("</"), "markup")
        .when(text.contains(";\n") | text.contains("{\n"), "code")
        .otherwise("prose")
    )


def _shares(sums: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power for k, v in sums.items() if v > 0}
    total = math.fsum(raised.values())
    return {k: v / total for k, v in raised.items()}


def _wanted(sums: dict[str, float], power: float, target: Mapping[str | None, float] | None) -> dict[str, float]:
    """The shares that the values with tokens are to have."""
    if target is None:
        return _shares(sums, power)
    given = {NONE if k is None else str(k): float(w) for k, w in target.items()}
    return _shares({k: given.get(k, 0.0) for k, v in sums.items() if v > 0}, 1.0)


def weights(
    docs: DataFrame,
    scratch: Scratch,
    by: Column | None = None,
    source: Mapping[str | None, float] | DataFrame | None = None,
    lang: Mapping[str | None, float] | None = None,
    topic: Mapping[str | None, float] | None = None,
    source_power: float = 0.5,
    lang_power: float = 0.5,
    topic_power: float = 1.0,
) -> tuple[DataFrame, list[str], DataFrame, dict, dict, float]:
    """The keyed documents and the names of their keys (source, language, topic, tokens), (s, cells, a) of each source, the
    factors of languages and topics, and all tokens. ``by``: the expression of topics."""
    text = text_or_empty()
    s_, l_, t_, n_ = keys = unused(docs, "mix_s", "mix_l", "mix_t", "mix_n")
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    keyed = docs.select("*", named(F.col("source")).alias(s_), named(F.col("lang")).alias(l_), named(by if by is not None else form(text)).alias(t_), tokens(text).alias(n_))
    cells = keyed.groupBy(F.col(s_).alias("s"), F.col(l_).alias("l"), F.col(t_).alias("t")).agg(F.sum(n_).alias("n")).where("n > 0")
    cells = scratch.keep(cells)
    langs, topics = ({r[0]: r[1] for r in cells.groupBy(c).agg(F.sum("n")).limit(MOST + 1).collect()} for c in ("l", "t"))
    if max(len(langs), len(topics)) > MOST:
        raise ValueError(f"more than {MOST} languages or topics")
    per = cells.groupBy("s").agg(F.collect_list(F.struct("l", "t", "n")).alias("cells"), F.pow(F.sum("n"), F.lit(source_power)).alias("w"))
    if source is not None:
        given = source if isinstance(source, DataFrame) else docs.sparkSession.createDataFrame([(k, float(w)) for k, w in source.items()] or [(None, 0.0)], "source string, weight double")
        given = given.select(named(F.col("source")).alias("s"), F.col("weight").cast("double").alias("given")).groupBy("s").agg(F.max("given").alias("given"))
        per = per.join(given, "s", "left").select("s", "cells", F.coalesce("given", F.lit(0.0)).alias("w"))
    per = scratch.keep(per)
    total, norm = math.fsum(langs.values()), per.agg(F.sum("w")).first()[0] or 1.0
    want = {"l": _wanted(langs, lang_power, lang), "t": _wanted(topics, topic_power, topic)}
    factor = {"l": dict.fromkeys(langs, 1.0), "t": dict.fromkeys(topics, 1.0)}

    def source_factor() -> Column:
        inner = F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + x["n"] * _at(factor["l"], x["l"]) * _at(factor["t"], x["t"]))
        return F.when(inner > 0, F.col("w") / norm * total / inner).otherwise(F.lit(0.0))

    for _ in range(SWEEPS):
        off = 0.0
        for side in ("l", "t"):
            if not factor[side]:
                continue
            flat = per.select(source_factor().alias("a"), F.explode("cells").alias("x"))
            share = flat.groupBy(F.col(f"x.{side}").alias("k")).agg(F.sum(F.col("a") * F.col("x.n") * _at(factor["l"], F.col("x.l")) * _at(factor["t"], F.col("x.t"))).alias("n"))
            for k, n in share.collect():  # a row for each language or topic
                ratio = want[side].get(k, 0.0) * total / n if n else 0.0
                factor[side][k] *= ratio
                off = max(off, abs(ratio - 1))
        if off < TOLERANCE:
            break
    return keyed, keys, per.select("s", "cells", source_factor().alias("a")), factor["l"], factor["t"], total


def _at(values: dict[str, float], key: Column) -> Column:
    """The value of a key in a small fixed map; 1 for keys without tokens."""
    if not values:
        return F.lit(1.0)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv)), key), F.lit(1.0))


def probabilities(docs: DataFrame, keep: float = 0.9, **targets) -> tuple[DataFrame, list[str]]:
    """``docs`` with four more columns, and their names: the tokens, the raked factor, the probability of the draw, the draw."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keyed, (s_, l_, t_, n_), sources, langs, topics, total = weights(docs, scratch, **targets)
    sources = scratch.keep(sources)
    cells = sources.select(F.col("a"), F.explode("cells").alias("x")).select((F.col("a") * _at(langs, F.col("x.l")) * _at(topics, F.col("x.t"))).alias("f"), F.col("x.n").alias("n"))
    scale = keep
    for _ in range(50):  # sum of n * min(1, scale * f) is piecewise linear and rises with the scale
        full, rest = cells.agg(F.sum(F.when(F.col("f") * scale >= 1, F.col("n"))), F.sum(F.when(F.col("f") * scale < 1, F.col("n") * F.col("f")))).first()
        if not rest:
            break
        new = max((keep * total - (full or 0.0)) / rest, scale)
        if new <= scale * (1 + 1e-9):
            break
        scale = new
    a_, f_, u_, p_ = unused(keyed, "mix_a", "mix_f", "mix_u", "mix_p")
    f = F.coalesce(a_, F.lit(1.0)) * _at(langs, F.col(l_)) * _at(topics, F.col(t_))
    f = F.when(F.col(n_) > 0, f).otherwise(F.lit(1.0))
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    joined = keyed.join(sources.select(F.col("s").alias(s_), F.col("a").alias(a_)), s_, "left").select(*docs.columns, n_, f.alias(f_), u.alias(u_))
    return joined.withColumn(p_, F.least(F.lit(1.0), F.col(f_) * scale)), [n_, f_, p_, u_]


def sample(docs: DataFrame, keep: float = 0.9, **targets) -> DataFrame:
    """The rows drawn, with the columns of ``docs``."""
    drawn, (_, _, p_, u_) = probabilities(docs, keep, **targets)
    return drawn.where(F.col(u_) < F.col(p_)).select(*docs.columns)
