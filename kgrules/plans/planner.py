"""Rules as DataFrame plans.

Semantics: triples are a set; different variables take different terms (a variable may equal a constant of the rule); no two
body atoms ground to the same triple; for the support no body atom grounds to the head triple either.

``general`` is right for every rule: the support is a left semi join of the head triples with the body, the body size a
distinct count of the body's head pairs. ``one_pass`` gets both from one enumeration of the body, for rules whose head has
two different variables that both occur in the body. ``batched`` does that for all rules of one shape together.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import Atom, Rule, Term


#: Rows that the product of a body's unconnected parts may have by estimate, unless the caller says otherwise.
CROSS = 1_000_000_000
#: Estimated groundings of the rules that are evaluated together; rules of a batch at most, as their parameters are broadcast.
GROUNDINGS, BATCH = 1e10, 20_000


class CrossProductError(ValueError):
    """A body of unconnected parts whose product is beyond the limit."""


def _all(conditions: Iterable[Column]) -> Column | None:
    found = list(conditions)
    return reduce(lambda a, b: a & b, found) if found else None


def v(name: str) -> str:
    return f"v_{name}"


@dataclass(frozen=True)
class Stats:
    """Of a predicate: triples, distinct subjects and objects, the most objects of a subject and subjects of an object (0 where
    only the means are known)."""

    n: int = 0
    subjects: int = 0
    objects: int = 0
    out: int = 0
    into: int = 0


def order(body: Sequence[Atom], sizes: Mapping[str, int], first: Iterable[str] = (), stats: Mapping[str, Stats] | None = None) -> list[int]:
    """A greedy join order: the atom with the most bound terms next; on ties the one with the smallest greatest fan-out from
    its bound end, or mean fan-out, as ``stats`` tells it, then the smaller predicate. ``first``: variables that are bound from
    the start."""
    bound, left, out = set(first), list(range(len(body))), []

    def fan(a: Atom, known: list[bool]) -> float:
        s = (stats or {}).get(a.p)
        if s is None or known[0] == known[1]:
            return 0
        return s.out or s.n / max(s.subjects, 1) if known[0] else s.into or s.n / max(s.objects, 1)

    while left:
        def rank(i: int) -> tuple:
            a = body[i]
            known = [not t.is_var or t.value in bound for t in (a.s, a.o)]
            joined = any(x in bound for x in a.variables)
            return (-joined if bound else 0, -sum(known), fan(a, known), sizes.get(a.p, 0), i)

        best = min(left, key=rank)
        left.remove(best)
        out.append(best)
        bound |= set(body[best].variables)
    return out


def groundings(body: Sequence[Atom], stats: Mapping[str, Stats]) -> float:
    """An estimate of a body's groundings in its order: mean fan-outs from bound ends, one in so many for bound pairs."""
    bound, rows = set(), 1.0
    for a in body:
        s = stats.get(a.p, Stats())
        known = [not t.is_var or t.value in bound for t in (a.s, a.o)]
        rows *= s.n / (max(s.subjects, 1) if known[0] else 1) / (max(s.objects, 1) if known[1] else 1)
        bound |= set(a.variables)
    return rows


def components(body: Sequence[Atom]) -> list[set[str]]:
    """The connected groups of the body's variables."""
    groups: list[set[str]] = []
    for a in body:
        own = set(a.variables)
        if not own:
            continue
        touching = [g for g in groups if g & own]
        groups = [g for g in groups if not g & own] + [own.union(*touching)]
    return groups


def scan(triples: DataFrame, atom: Atom) -> DataFrame:
    """Triples that match an atom alone, as columns of its variables; without variables, one row if the triple exists."""
    rows = triples.where(F.col("p") == atom.p)
    for side, t in (("s", atom.s), ("o", atom.o)):
        if not t.is_var:
            rows = rows.where(F.col(side) == t.value)
    if not atom.variables:
        return rows.select(F.lit(1).alias("exists")).limit(1)
    if atom.s.is_var and atom.o.is_var:
        rows = rows.where(F.col("s") == F.col("o") if atom.s == atom.o else F.col("s") != F.col("o"))
    named = {}
    for side, t in (("s", atom.s), ("o", atom.o)):
        if t.is_var:
            named[t.value] = F.col(side).alias(v(t.value))
    return rows.select(*named.values())


def _ground(t: Term) -> Column:
    return F.col(v(t.value)) if t.is_var else F.lit(t.value)


def _same(a: Term, b: Term) -> bool | Column:
    """Whether two terms of one rule take the same value: known beforehand, or a condition."""
    if a == b:
        return True
    if a.is_var == b.is_var:
        return False  # different variables are different terms, and so are different constants
    return _ground(a) == _ground(b)


def clash(a: Atom, b: Atom) -> bool | Column:
    """Whether two atoms ground to the same triple."""
    if a.p != b.p:
        return False
    s, o = _same(a.s, b.s), _same(a.o, b.o)
    if s is False or o is False:
        return False
    if s is True:
        return o
    return s if o is True else s & o


def body_rows(triples: DataFrame, rule: Rule, sizes: Mapping[str, int], limit: int | None = None, seed: DataFrame | None = None, given: Sequence[str] = (), stats: Mapping[str, Stats] | None = None) -> DataFrame | None:
    """All groundings of the body, a column for each variable; None if none can exist.

    ``seed``: rows that bind the ``given`` variables, which all groundings extend; its other columns are carried along.
    """
    atoms = [rule.body[i] for i in order(rule.body, sizes, given, stats)]
    clashes = [clash(a, b) for i, a in enumerate(atoms) for b in atoms[:i]]
    if any(c is True for c in clashes) or any(sizes.get(a.p, 0) == 0 for a in atoms):
        return None
    if limit is not None and len(components(atoms)) > 1:
        product = reduce(lambda x, g: x * max(1, min(sizes[a.p] for a in atoms if set(a.variables) & g)), components(atoms), 1)
        if product > limit:
            raise CrossProductError(f"about {product} rows; the limit is {limit}")
    rows, bound = seed, list(given)
    for a in atoms:
        own = scan(triples, a)
        if rows is None:
            rows, bound = own, list(a.variables)
            continue
        shared = [x for x in a.variables if x in bound]
        new = [x for x in a.variables if x not in bound]
        if not a.variables:
            rows = rows.join(F.broadcast(own), how="left_semi")  # one row
            continue
        own = own.toDF(*(f"r_{x}" for x in own.columns))
        on = [F.col(v(x)) == F.col(f"r_{v(x)}") for x in shared] + [F.col(v(x)) != F.col(f"r_{v(y)}") for y in new for x in bound]
        rows = rows.join(own, _all(on)) if on else rows.crossJoin(own)
        rows = rows.select(*(c for c in rows.columns if not c.startswith("r_")), *(F.col(f"r_{v(y)}").alias(v(y)) for y in new))
        bound += new
    keep = _all(~c for c in clashes if not isinstance(c, bool))
    return rows if keep is None else rows.where(keep)


def head_rows(triples: DataFrame, head: Atom, consistent: bool = True) -> DataFrame:
    """(hs, ho) of the head triples that match the constants; ``consistent``: and bind the variables as they must."""
    rows = triples.where(F.col("p") == head.p)
    for side, t in (("s", head.s), ("o", head.o)):
        if not t.is_var:
            rows = rows.where(F.col(side) == t.value)
    if consistent and head.s.is_var and head.o.is_var:
        rows = rows.where(F.col("s") == F.col("o") if head.s == head.o else F.col("s") != F.col("o"))
    return rows.select(F.col("s").alias("hs"), F.col("o").alias("ho"))


def supported(triples: DataFrame, rule: Rule, sizes: Mapping[str, int], limit: int | None = None, stats: Mapping[str, Stats] | None = None) -> DataFrame | None:
    """(hs, ho) of the head triples for which the body holds; None if there are none.

    The enumeration is seeded: it begins with the head triples, whose ends bind the head's variables, so atoms are joined in
    the order for these bindings and only groundings that agree with a head triple come about.
    """
    if sizes.get(rule.head.p, 0) == 0:
        return None
    heads = head_rows(triples, rule.head)
    if not rule.body:
        return heads
    at = {t.value: F.col(side).alias(v(t.value)) for side, t in (("hs", rule.head.s), ("ho", rule.head.o)) if t.is_var}
    body = body_rows(triples, rule, sizes, limit, heads.select("hs", "ho", *at.values()), list(at), stats)
    if body is None:
        return None
    for a in rule.body:
        if a.p == rule.head.p:
            body = body.where(~((_ground(a.s) == F.col("hs")) & (_ground(a.o) == F.col("ho"))))
    return body.select("hs", "ho").distinct()


def body_pairs(triples: DataFrame, rule: Rule, sizes: Mapping[str, int], limit: int | None = None, stats: Mapping[str, Stats] | None = None) -> DataFrame | None:
    """Distinct head pairs over all groundings of the body; None where the body size is 0 by definition."""
    h = rule.head
    if not rule.body or not (h.s.is_var and h.o.is_var) or not rule.safe:
        return None
    rows = body_rows(triples, rule, sizes, limit, stats=stats)
    return None if rows is None else rows.select(F.col(v(h.s.value)).alias("hs"), F.col(v(h.o.value)).alias("ho")).distinct()


def general(triples: DataFrame, rule: Rule, sizes: Mapping[str, int], limit: int | None = None, stats: Mapping[str, Stats] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    return supported(triples, rule, sizes, limit, stats), body_pairs(triples, rule, sizes, limit, stats)


def batchable(rule: Rule) -> bool:
    """Two different head variables, both in a connected body."""
    h = rule.head
    return bool(rule.body) and h.s.is_var and h.o.is_var and h.s != h.o and rule.safe and len(components(rule.body)) == 1 and all(a.variables for a in rule.body)


def one_pass(triples: DataFrame, rule: Rule, sizes: Mapping[str, int], stats: Mapping[str, Stats] | None = None) -> DataFrame:
    """(support, body_size) from one enumeration of the body."""
    assert batchable(rule)
    body, h = body_rows(triples, rule, sizes, stats=stats), rule.head
    if body is None:
        return triples.sparkSession.range(1).select(F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("body_size"))
    hits = [c for c in (clash(a, h) for a in rule.body) if c is not False]
    if any(c is True for c in hits):
        clean = F.lit(0)
    else:
        clean = F.lit(1) if not hits else F.when(_all(~c for c in hits), 1).otherwise(0)
    rows = body.select(F.col(v(h.s.value)).alias("hs"), F.col(v(h.o.value)).alias("ho"), clean.alias("clean"))
    pairs = rows.groupBy("hs", "ho").agg(F.max("clean").alias("clean"))
    heads = head_rows(triples, h).select(F.col("hs").alias("s"), F.col("ho").alias("o"))
    joined = pairs.join(heads, (F.col("hs") == F.col("s")) & (F.col("ho") == F.col("o")) & (F.col("clean") == 1), "left")
    return joined.agg(F.count("s").alias("support"), F.count("*").alias("body_size"))


def shape(rule: Rule, sizes: Mapping[str, int], stats: Mapping[str, Stats] | None = None) -> tuple[tuple, tuple]:
    """(pattern, parameters): the terms of the ordered body and the head with variables numbered and constants left open;
    predicates and constants in their order."""
    body = [rule.body[i] for i in order(rule.body, sizes, stats=stats)]
    number = {x: i for i, x in enumerate(dict.fromkeys(y for a in (*body, rule.head) for y in a.variables))}
    pattern, given = [], []
    for a in (*body, rule.head):
        pattern.append(tuple(number[t.value] if t.is_var else None for t in (a.s, a.o)))
        given += [a.p, *(t.value for t in (a.s, a.o) if not t.is_var)]
    return tuple(pattern), tuple(given)


def batched(triples: DataFrame, rules: Mapping[int, Rule], sizes: Mapping[str, int], stats: Mapping[str, Stats] | None = None, budget: float = GROUNDINGS) -> DataFrame:
    """(rule_id, support, body_size) of batchable rules; a set of joins for each shape, or for each part of its rules whose
    estimated groundings are within ``budget``. Rules that can't have a grounding get no row.
    """
    spark = triples.sparkSession
    groups: dict[tuple, list[tuple]] = {}
    for i, r in rules.items():
        assert batchable(r)
        if all(sizes.get(a.p, 0) for a in r.body):
            pattern, given = shape(r, sizes, stats)
            cost = groundings([r.body[k] for k in order(r.body, sizes, stats=stats)], stats) if stats else 0
            groups.setdefault(pattern, []).append((given, i, cost))
    parts = []
    for pattern, rows in groups.items():
        part, cost = [], 0.0
        for row in sorted(rows):  # rules with the same first atoms are neighbours
            if part and (cost + row[2] > budget or len(part) >= BATCH):
                parts.append(_shape_batch(spark, triples, pattern, part))
                part, cost = [], 0.0
            part.append((row[1], row[0]))
            cost += row[2]
        parts.append(_shape_batch(spark, triples, pattern, part))
    if not parts:
        return spark.createDataFrame([], "rule_id int, support long, body_size long")
    return reduce(DataFrame.unionByName, parts)


def _steps(pattern: tuple, rows: list[tuple]) -> tuple[list[list[tuple]], list[tuple]]:
    """Rules as a tree of their atoms' parameters: for each body atom the distinct (node before, node, predicate, constants), and
    (rule, last node, head predicate). Rules that begin alike share their nodes."""
    widths = [1 + sum(t is None for t in ends) for ends in pattern]
    levels: list[dict[tuple, int]] = [{} for _ in pattern[:-1]]
    heads = []
    for i, given in rows:
        at, node = 0, 0
        for level, wide in zip(levels, widths, strict=False):
            node = level.setdefault((node, *given[at : at + wide]), len(level))
            at += wide
        heads.append((i, node, given[at]))
    return [[(k[0], n, *k[1:]) for k, n in level.items()] for level in levels], heads


def given(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of parameters, made by the JVM from one literal."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def _shape_batch(spark, triples: DataFrame, pattern: tuple, rows: list[tuple[int, tuple]]) -> DataFrame:
    """One enumeration of the bodies of all rules of a shape. Rows carry the node of the tree of parameters that they have
    come to, so what rules share is joined once, and each atom reads its own predicates only."""
    levels, heads = _steps(pattern, rows)
    names = lambda i: [f"p{i}", *(f"c{i}{side}" for side, t in zip("so", pattern[i], strict=True) if t is None)]
    ends = lambda i: [f"c{i}{side}" if t is None else f"x{t}" for side, t in zip("so", pattern[i], strict=True)]
    last, (hs, ho) = len(levels), ends(len(pattern) - 1)
    carried: list[str] = []
    current, bound = None, []
    for i, level in enumerate(levels):
        s, o = ends(i)
        table = F.broadcast(given(spark, level, "above int, node int, " + ", ".join(f"{n} string" for n in names(i))))
        own = triples.where(F.col("p").isin(sorted({r[2] for r in level}))).select("p", F.col("s").alias("ts"), F.col("o").alias("to"))
        match, new = [F.col("p") == F.col(f"p{i}")], {}
        for side, t in (("ts", s), ("to", o)):
            if t[0] == "c" or t in bound:
                match.append(F.col(side) == F.col(t))
            elif t not in new:
                match += [F.col(side) != F.col(b) for b in bound]
                new[t] = F.col(side).alias(t)
        if s[0] == o[0] == "x":
            match.append(F.col("ts") == F.col("to") if s == o else F.col("ts") != F.col("to"))
        if current is None:
            current = own.join(table, _all(match))
        else:
            grown = current.withColumnRenamed("node", "above").join(table, "above").drop("above")
            current = grown.join(own, _all(match))
        carried += names(i)
        current = current.select("node", *carried, *bound, *new.values())
        bound += list(new)
    ground = lambda i: tuple(F.col(t) for t in ends(i))
    possible = lambda a, b: all(x == y or "c" in x[0] + y[0] for x, y in zip(ends(a), ends(b), strict=True))
    # no two atoms of a rule ground to the same triple
    apart = [~((F.col(f"p{a}") == F.col(f"p{b}")) & _equal(ground(a), ground(b))) for a in range(last) for b in range(a) if possible(a, b)]
    if apart:
        current = current.where(_all(apart))
    # atoms that ground to the head's triple where they have its predicate
    close = [i for i in range(last) if possible(i, last)]
    flags = [_equal(ground(i), (F.col(hs), F.col(ho))).alias(f"f{i}") for i in close]
    of = {i: {n: p for _, n, p, *_ in level} for i, level in enumerate(levels)}
    above = {i: {n: a for a, n, *_ in level} for i, level in enumerate(levels)}

    def along(node: int) -> dict[int, str]:
        found = {}
        for i in reversed(range(last)):
            found[i] = of[i][node]
            node = above[i][node]
        return found

    ways = {n: along(n) for n in {node for _, node, _ in heads}} if close else {}
    near = [tuple(k for k in close if ways[node][k] == p) for _, node, p in heads]
    sets = sorted(set(near))  # the atoms that may be the head's triple, as rules have them
    pairs = current.select("node", F.col(hs).alias("hs"), F.col(ho).alias("ho"), *flags)
    if len(bound) <= 3:
        # one way at most over each middle term, so pairs can be dealt as they are, in the one way that the heads need as well
        pairs = pairs.repartition("hs", "ho")
    clean = [F.max(_all(~F.col(f"f{k}") for k in x) if x else F.lit(True)).alias(f"clean{j}") for j, x in enumerate(sets)]
    pairs = pairs.groupBy("node", "hs", "ho").agg(*clean)
    asked = sorted({p for *_, p in heads})
    true = triples.where(F.col("p").isin(asked)).where("s <> o")
    # a pair that is a triple of several predicates counts once for the body
    true = true.withColumn("nth", F.row_number().over(Window.partitionBy("s", "o").orderBy("p")) if len(asked) > 1 else F.lit(1))
    joined = pairs.join(true, (F.col("hs") == F.col("s")) & (F.col("ho") == F.col("o")), "left")
    hits = [F.count_if(F.col("p").isNotNull() & F.col(f"clean{j}")).alias(f"n{j}") for j in range(len(sets))]
    found = joined.groupBy("node", "p").agg(F.count_if(F.col("nth").isNull() | (F.col("nth") == 1)).alias("size"), *hits)
    counted = F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", F.array(*(f"n{j}" for j in range(len(sets))))).alias("x")))
    found = found.groupBy("node").agg(F.sum("size").alias("body_size"), F.map_from_entries(counted).alias("hits"))
    rules = F.broadcast(given(spark, [(i, node, p, sets.index(x)) for (i, node, p), x in zip(heads, near, strict=True)], "rule_id int, node int, hp string, near int"))
    support = F.coalesce(F.get(F.try_element_at("hits", F.col("hp")), F.col("near")), F.lit(0)).cast("long")
    return found.join(rules, "node").select("rule_id", support.alias("support"), "body_size")


def _equal(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] == b[0]) & (a[1] == b[1])
