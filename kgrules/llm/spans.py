"""Positions of regular-expression matches as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaps(text: Column, pattern: str | Column) -> Column:
    """What lies between the leftmost non-overlapping matches: one piece more than there are matches."""
    return F.split(text, pattern, -1)


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(group))


#: Matches whose positions are summed at a time.
RUN = 64


def starts(gap: Column, match: Column) -> Column:
    """Start of each match in code points, from the lengths of the gaps and matches before it.

    Lengths are summed within runs of RUN matches and the runs' sums before them, so a text's cost grows with the square of a
    run's length, and of the runs' number, instead of with that of its matches.
    """
    empty = F.array().cast("array<int>")
    own = F.zip_with(F.slice(gap, F.lit(1), F.size(match)), match, lambda g, m: F.struct(F.length(g).alias("g"), (F.length(g) + F.length(m)).alias("both")))

    def cut(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda i: F.slice(xs, i * RUN + 1, F.lit(RUN)))

    def before(sizes: Column, start: Column) -> Column:
        """The sum of all sizes before each."""
        grow = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["s"], F.array(acc["at"])).alias("s"))
        return F.aggregate(sizes, F.struct(start.alias("at"), empty.alias("s")), grow, lambda acc: acc["s"])

    def placed(runs: Column) -> Column:
        totals = F.transform(runs, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["both"]))
        return F.flatten(F.zip_with(before(totals, F.lit(0)), runs, lambda base, xs: F.zip_with(before(F.transform(xs, lambda x: x["both"]), base), xs, lambda at, x: at + x["g"])))

    return F.when(F.size(match) > 0, once(once(own, cut), placed)).otherwise(empty)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is computed once; an expression that stands in several places would be at each."""
    return F.element_at(F.transform(F.array(value), then), 1)
