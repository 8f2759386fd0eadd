"""Secrets: fixed patterns, and a randomness test battery over long tokens. DataFrame expressions, beside a small fixed reference on the driver.

Base spans are the leftmost non-overlapping matches of three patterns. The method adds spans of kind ``random``: runs of 20
or more token characters whose characters can't be told from uniform draws. The encoding (decimal, hex, base32, base64)
is inferred from the characters; three tests follow - chi-squared uniformity over the alphabet, runs about the alphabet's
middle, lag-1 serial correlation - and Fisher's method combines them to the probability p of so uneven a draw.

Length-aware false-discovery control: what p natural strings reach depends on their length and encoding, so each class of
lengths (powers of two) and encoding has its own null: ``REFERENCE`` strings of that length made of words, the same whatever
the corpus (above 255 characters those of 128 to 255, which reach larger p). A token's chance under the null is the share of
those with as large a p; Benjamini and Hochberg's rule at ``rate`` then picks the class's threshold. Counts are kept on a grid
of p, so the rule needs a bounded table whatever the corpus.

Cases: a null text counts as empty; an empty text has no spans. Rows are independent, so repeated ids and null ids give a
row each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty
from .spans import gaps, matches, starts

# The patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
GRID, CLASSES = 400, 12
#: Strings of the null for each class of lengths and style, and the last class that has its own.
REFERENCE, LAST = 1000, 7
# Common words of several languages, of which natural strings are made.
WORDS = """the and that have with this from they will would there their what about which when make like time just know take people into year good
some could them other than then look only come over think also back after work first well even want because these give most config service manager
request response handler server client index data value user name file path list table error message version update create delete default module
und der die das nicht eine auch wird nach bei oder haben werden mehr zwischen les des une dans pour que pas sur avec plus tout faire comme mais
los las una por para con como pero sus este entre cuando muy sobre todo tambien hasta desde donde quien che non per sono della anche questo come
dat het een van voor niet zijn maar naar page image article content category document section history number system group public world house
country language school water music information development international government university environment""".split()

# Alphabets in the order of their digits.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the three patterns; kind is the position in KINDS."""

    def of(kind: int, pattern: str, least: int = 0, group: int = 0) -> Column:
        m = matches(text, pattern)
        rows = F.arrays_zip(starts(gaps(text, pattern), m).alias("s"), m.alias("m"), matches(text, pattern, group).alias("g"))
        full = F.transform(F.filter(rows, lambda x: F.length(x["g"]) >= least), lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).alias("end")))
        return F.when(text.rlike(pattern), full).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    # an assignment has '=' or ':', which costs far less to look for than the pattern
    assign = F.when(text.contains("=") | text.contains(":"), of(0, ASSIGN, 8, 2)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return F.array_sort(F.concat(assign, of(1, ACCESS), of(2, HEX)))


def normal_cdf(z: Column) -> Column:
    """A logistic approximation of the normal distribution function, good to 2e-4."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def two_sided(z: Column) -> Column:
    return F.greatest(2 * (1 - normal_cdf(F.abs(z))), F.lit(1e-12))


def encoding(token: Column) -> Column:
    t = F.regexp_replace(token, "=+$", "")
    return (
        F.when(t.rlike("^[0-9]+$"), "decimal")
        .when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(t.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )


def battery(token: Column, kind: Column) -> Column:
    """Fisher's combined p of the three tests, for a token in the inferred encoding."""
    # the url-safe signs of base64 stand for the last two digits; hex may be in capitals
    t = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    t = F.when(kind == "hex", F.lower(t)).otherwise(t)
    alphabet = F.element_at(F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv)), kind)
    m = F.length(alphabet).cast("double")
    return _tests(F.transform(F.split(t, ""), lambda c: F.call_function("locate", c, alphabet) - 1), m)


def _tests(drawn: Column, m: Column) -> Column:
    # a struct's field is computed once; the columns below would repeat the string work at each use
    box = F.transform(F.array(F.struct(F.filter(drawn, lambda v: v >= 0).alias("v"), m.alias("m"))), lambda b: _combined(b["v"], b["m"]))
    return F.element_at(box, 1)


def _combined(v: Column, m: Column) -> Column:
    n = F.size(v).cast("double")
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    # uniformity: so many equal bins of the alphabet that each expects about five draws
    bins = F.greatest(F.lit(2.0), F.least(m, F.floor(n / 5).cast("double")))
    symbols = lambda b: F.ceil((b + 1) * m / bins) - F.ceil(b * m / bins)
    cell = lambda b: F.size(F.filter(v, lambda x: F.floor(x * bins / m) == b)).cast("double")
    chi = F.aggregate(F.sequence(F.lit(0), bins.cast("int") - 1), F.lit(0.0), lambda a, b: a + F.pow(cell(b) - n * symbols(b) / m, F.lit(2.0)) / (n * symbols(b) / m))
    df = bins - 1
    wilson = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p1 = F.greatest(1 - normal_cdf(wilson), F.lit(1e-12))
    # runs about the middle
    up = F.transform(v, lambda x: (x.cast("double") * 2 >= m).cast("int"))
    n1 = F.aggregate(up, F.lit(0), lambda a, x: a + x).cast("double")
    n2 = n - n1
    steps = lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    runs = 1.0 + F.size(F.filter(steps(up), lambda s: s["x"] != s["y"])).cast("double")
    mean = 2 * n1 * n2 / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p2 = F.when(spread > 0, two_sided((runs - mean) / F.sqrt(spread))).otherwise(F.lit(1e-12))
    # serial correlation
    mu = total(lambda x: x) / n
    var = total(lambda x: x * x) / n - mu * mu
    lagged = F.aggregate(steps(v), F.lit(0.0), lambda a, s: a + (s["x"] - mu) * (s["y"] - mu)) / n
    p3 = F.when(var > 0, two_sided(lagged / var * F.sqrt(n))).otherwise(F.lit(1e-12))
    half = -(F.log(p1) + F.log(p2) + F.log(p3))
    fisher = F.exp(-half) * (1 + half + half * half / 2)
    return F.when(n >= 8, F.least(F.greatest(fisher, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


CANDIDATE = "array<struct<start:int,end:int,p:double,cls:int,enc:string>>"


def class_of(token: Column) -> Column:
    return F.least(F.floor(F.log2(F.length(token).cast("double"))).cast("int"), F.lit(CLASSES))


def cell_of(p: Column) -> Column:
    return F.least(F.floor(p * GRID), F.lit(GRID - 1)).cast("int")


def candidates(text: Column) -> Column:
    """array<struct<start, end, p, cls, enc>> of the long tokens."""
    m = matches(text, TOKEN)
    rows = F.arrays_zip(starts(gaps(text, TOKEN), m).alias("s"), m.alias("m"))
    full = F.transform(
        rows,
        lambda x: F.struct(
            x["s"].alias("start"),
            (x["s"] + F.length(x["m"])).alias("end"),
            battery(x["m"], encoding(x["m"])).alias("p"),
            class_of(x["m"]).alias("cls"),
            encoding(x["m"]).alias("enc"),
        ),
    )
    return F.when(text.rlike(TOKEN), full).otherwise(F.array().cast(CANDIDATE))


def _cdf(z: float) -> float:
    return 1 / (1 + math.exp(min(-(1.5976 * z + 0.07056 * z**3), 700)))


def natural_p(token: str, kind: str) -> float:
    """The battery for one token, on the driver: the expressions take too long for the thousands of the reference."""
    alphabet = ALPHABETS[kind]
    v = np.array([x for x in (alphabet.find(c) for c in token.rstrip("=").translate(str.maketrans("-_", "+/"))) if x >= 0], float)
    n, m = len(v), len(alphabet)
    bins = max(2, min(m, n // 5))
    b = np.arange(bins)
    expected = n * (np.ceil((b + 1) * m / bins) - np.ceil(b * m / bins)) / m
    chi, df = ((np.bincount((v * bins / m).astype(int), minlength=bins) - expected) ** 2 / expected).sum(), bins - 1
    p1 = max(1 - _cdf(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))), 1e-12)
    two = lambda z: max(2 * (1 - _cdf(abs(z))), 1e-12)
    up = v * 2 >= m
    n1 = up.sum()
    mean = 2 * n1 * (n - n1) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p2 = two((1 + (up[1:] != up[:-1]).sum() - mean) / math.sqrt(spread)) if spread > 0 else 1e-12
    d = v - v.mean()
    var = (d * d).mean()
    p3 = two((d[1:] * d[:-1]).sum() / n / var * math.sqrt(n)) if var > 0 else 1e-12
    half = -(math.log(p1) + math.log(p2) + math.log(p3))
    return min(max(math.exp(-half) * (1 + half + half * half / 2), 0), 1)


@functools.cache
def reference() -> list[tuple[int, str, int, int]]:
    """(cls, enc, cell, null): how many natural strings of each class and encoding have a p in each cell of the grid.

    Styles: lower case, capitals, camel case, and words and numbers with signs between. Decimal and hex digits, of which words
    have none, share the null of base64.
    """
    rng, seen = random.Random(1), Counter()
    for cls in range(4, LAST + 1):
        for i in range(REFERENCE * 4):
            n, sign, t = rng.randrange(max(20, 1 << cls), 2 << cls), rng.choice("-_/"), ""
            while len(t) < n:
                w = rng.choice(WORDS)
                t += (w, w.upper(), w.capitalize(), (w if rng.random() < 0.8 else str(rng.randrange(2100))) + sign)[i % 4]
            kind = "base32" if i % 4 == 1 else "base64"
            cell = min(int(natural_p(t[:n], kind) * GRID), GRID - 1)
            for k in (kind,) if kind == "base32" else (kind, "decimal", "hex"):
                for c in (cls,) if cls < LAST else range(LAST, CLASSES + 1):
                    seen[c, k, cell] += 1
    return [(*k, n) for k, n in seen.items()]


def thresholds(found: DataFrame, rate: float) -> DataFrame:
    """(cls, enc, least): the smallest grid cell of p that the rule accepts in each class of lengths and encoding."""
    each = found.select(F.explode("cands").alias("c")).select("c.cls", "c.enc", cell_of(F.col("c.p")).alias("cell"))
    null = found.sparkSession.createDataFrame(reference(), "cls int, enc string, cell int, null long").withColumn("k", F.lit(0).cast("long"))
    found_ = each.groupBy("cls", "enc", "cell").agg(F.count("*").alias("k")).withColumn("null", F.lit(0).cast("long"))
    cells = found_.unionByName(null).groupBy("cls", "enc", "cell").agg(F.sum("null").alias("null"), F.sum("k").alias("k"))
    up = Window.partitionBy("cls", "enc").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("cls", "enc")
    tail = cells.select("cls", "enc", "cell", F.sum("null").over(up).alias("null_tail"), F.sum("k").over(up).alias("k_tail"), F.sum("null").over(everything).alias("nulls"), F.sum("k").over(everything).alias("ks"))
    chance = (F.col("null_tail") + 1) / (F.col("nulls") + 1)
    return tail.where((F.col("k_tail") > 0) & (chance <= rate * F.col("k_tail") / F.col("ks"))).groupBy("cls", "enc").agg(F.min("cell").alias("least"))


def find(docs: DataFrame, rate: float = 0.1) -> DataFrame:
    """(doc_id, base, added): the base spans and the spans that the battery adds, apart from the base ones."""
    scratch = Scratch(docs.sparkSession, "secrets")
    text = text_or_empty()
    found = scratch.keep(docs.select("doc_id", base_spans(text).alias("base"), candidates(text).alias("cands")))
    # a row for each class of lengths and encoding, of which there are 4 * CLASSES at most
    least = {(r.cls, r.enc): r.least for r in thresholds(found, rate).collect()}
    tables = {e: F.array(*(F.lit(least.get((c, e), GRID)) for c in range(CLASSES + 1))) for e in ALPHABETS}

    def limit(c: Column) -> Column:
        out = F.lit(GRID)
        for e, cells in tables.items():
            out = F.when(c["enc"] == e, F.get(cells, c["cls"])).otherwise(out)
        return out

    accepted = F.filter("cands", lambda c: cell_of(c["p"]) >= limit(c))
    apart = F.filter(accepted, lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return found.select("doc_id", "base", F.transform(apart, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, rate: float = 0.1) -> DataFrame:
    found = find(docs, rate)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
