"""Approximate nearest neighbours by largest inner product: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample (``SAMPLE`` distinct vectors, those of
the smallest hash); every vector is indexed. A query's k-th best among ``PIVOTS`` vectors of the sample is a bar that its k
nearest don't fall below; it visits the lists that may reach the bar, by centroid and greatest residual or greatest length.
Lists are packed into blocks of about ``BLOCK`` entries, a list beyond that into several; a query goes to each block that has
one of its lists, once. There the centroid's inner product and the asymmetric tables of the residual codes score the entries of
its lists; the ``SHORT`` best of a block are scored exactly in double precision on the original vectors, which may raise the
bar, and so are all others that may reach it, by their score and the length of what their code leaves out. The best k of all
blocks are the result. So nothing is missed, whatever the rows; rows without clusters are visited and scored more often.
Equal vectors are one entry of the index that carries its k + 1 smallest ids, so a vector that a third of the rows share costs
as much as one. A given number of ``probes`` visits that many lists instead, which may miss some.

Cases: vectors that are null, empty, zero or hold null or non-finite components, rows with a null vec_id, and vectors not of
the commonest dimension take no part. Ties go to the smaller vec_id. Rows that repeat a vec_id and vector count once.
Fewer than k candidates: all of them. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SAMPLE, PIVOTS, MAX_LISTS, SUBSPACES, SHORT, BLOCK = 16_384, 4096, 1024, 16, 128, 8192
#: Pairs that are scored exactly at once, and what sums in double precision may be off by, as a share of the lengths' product.
PAIRS, ROUNDING = 1 << 16, 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


class Index:
    """The fitted quantisers."""

    def __init__(self, sample: np.ndarray, lists: int):
        d = sample.shape[1]
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(d), min(SUBSPACES, d))
        self.books = [kmeans(np.ascontiguousarray(rest[:, s]), 256, 6, i + 1) for i, s in enumerate(self.cuts)]
        self.pivots = sample[:PIVOTS]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector its list, its codes, and the lengths of its residual and of what the codes leave out of that."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.stack([nearest(np.ascontiguousarray(rest[:, s]), b).astype(np.uint8) for s, b in zip(self.cuts, self.books, strict=True)], axis=1)
        left = rest.copy()
        for j, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            left[:, s] -= b[codes[:, j]]
        return at, codes, np.linalg.norm(rest, axis=1), np.linalg.norm(left, axis=1)

    def bars(self, q: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that at least k + 1 vectors reach."""
        if len(self.pivots) <= k:
            return np.full(len(q), -np.inf)
        return np.partition(q @ self.pivots.T, len(self.pivots) - k - 1, axis=1)[:, len(self.pivots) - k - 1]

    def probed(self, q: np.ndarray, bar: np.ndarray, reach: np.ndarray, probes: int | None) -> np.ndarray:
        """For each query and list whether it is visited: it may hold a vector that reaches the query's bar, or it is among the
        nearest so many. ``reach``: greatest residual and greatest length in each list."""
        near = q @ self.coarse.T
        if probes:
            out = np.zeros(near.shape, bool)
            np.put_along_axis(out, np.argpartition(-near, min(probes, near.shape[1]) - 1, axis=1)[:, :probes], True, axis=1)
            return out
        size = np.linalg.norm(q, axis=1)[:, None]
        most = np.minimum(near + size * reach[0], size * reach[1])
        return ~(most + ROUNDING * size * reach.sum(0) < bar[:, None])

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, s] @ b.T for s, b in zip(self.cuts, self.books, strict=True)]


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The (k + 1)-th largest of each row, -inf where there are fewer."""
    n = scores.shape[1]
    return np.partition(scores, n - k - 1, axis=1)[:, n - k - 1] if n > k else np.full(len(scores), -np.inf)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    ok = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    ok = ok.where(F.forall("v", fine)).where(F.exists("v", lambda e: e != 0))
    size = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    found = size.collect()
    return ok.where(F.size("v") == found[0].d) if found else ok


def packed(sizes: dict[int, int]) -> tuple[dict[int, int], dict[int, int], int]:
    """The first block of each list, its blocks, and the number of blocks: small lists share one, large lists have several."""
    first, parts, at, room = {}, {}, -1, 0
    for i, n in sorted(sizes.items()):
        parts[i] = -(-n // BLOCK)
        if parts[i] > 1 or n > room:
            at += 1
            first[i], room = at, BLOCK - n if parts[i] == 1 else 0
            at += parts[i] - 1
        else:
            first[i], room = at, room - n
    return first, parts, at + 1


def search(vectors: DataFrame, every: int = 20, k: int = 20, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.keep(usable(vectors).distinct())
    by = Window.partitionBy("v")
    members = rows.withColumn("rn", F.row_number().over(by.orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    members = scratch.keep(members.withColumn("rep", F.min("vec_id").over(by)))
    reps = members.where("rn = 1").select("rep", "v")
    asked = scratch.keep(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").join(reps, "v").select("query_id", "rep", "v"))
    total = reps.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r.v for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()])
    lists = max(1, int(min(MAX_LISTS, len(sample) // 16, 2 * total**0.5)))
    shared = spark.sparkContext.broadcast(Index(sample, lists))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                v = _matrix(x.column("v"))
                at, codes, off, left = shared.value.encode(v)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), x.column("rep"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(left), pa.array(np.linalg.norm(v, axis=1)), x.column("v")], ["list", "rep", "codes", "off", "left", "size", "v"])

    entries = scratch.keep(reps.mapInArrow(index, "list int, rep long, codes binary, off double, left double, size double, v array<double>"))
    # a row for each list, MAX_LISTS at most
    found = entries.groupBy("list").agg(F.count("*").alias("n"), F.max("off").alias("off"), F.max("size").alias("size")).collect()
    first, parts, blocks = packed({r.list: r.n for r in found})
    reach = np.zeros((2, len(shared.value.coarse)))
    for r in found:
        reach[:, r.list] = r.off, r.size
    where = F.broadcast(spark.createDataFrame([(i, first[i], parts[i]) for i in first], "list int, first int, parts int"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.zeros((len(shared.value.coarse), blocks), np.uint8)
        for i in first:
            spread[i, first[i] : first[i] + parts[i]] = 1
        for x in batches:
            for lo in range(0, x.num_rows, 1024):
                y = x.slice(lo, 1024)
                q = _matrix(y.column("v"))
                bar = shared.value.bars(q, k)
                row, block = np.nonzero(shared.value.probed(q, bar, reach, probes).astype(np.float32) @ spread)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), y.column("rep").take(take), pa.array(bar[row]), y.column("v").take(take)], ["block", "rep", "bar", "v"])

    visits = asked.select("rep", "v").dropDuplicates(["rep"]).mapInArrow(visit, "block int, rep long, bar double, v array<double>")
    # a block meets the queries in parts of about BLOCK
    queries = max(1, -(-asked.count() // BLOCK))
    left = entries.join(where, "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    left = left.select("block", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))).alias("part"), "list", "rep", "codes", "left", "size", "v")
    right = visits.select("block", F.pmod(F.xxhash64("rep"), F.lit(queries)).cast("int").alias("part"), "rep", "bar", "v")

    def rank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        codes, v = np.stack([np.frombuffer(c, np.uint8) for c in a["codes"]]), np.stack(a["v"].to_numpy())
        ids, own, out = a["rep"].to_numpy(), a["list"].to_numpy(), []
        left, size, short = a["left"].to_numpy(), a["size"].to_numpy(), min(SHORT, len(v))
        for lo in range(0, len(b), 256):
            q, bar = np.stack(b["v"].to_numpy()[lo : lo + 256]), b["bar"].to_numpy()[lo : lo + 256]
            near = (q @ shared.value.coarse.T)[:, own]
            for j, t in enumerate(shared.value.tables(q)):
                near += t[:, codes[:, j]]
            near[~shared.value.probed(q, bar, reach, probes)[:, own]] = -np.inf
            best = np.argpartition(-near, short - 1, axis=1)[:, :short]
            exact, r = np.full(near.shape, -np.inf), np.arange(len(q))[:, None]
            exact[r, best] = np.einsum("qd,qcd->qc", q, v[best])
            exact[np.isneginf(near)] = -np.inf
            near[r, best] = -np.inf
            bar = np.maximum(bar, kth(exact, k))
            long = np.linalg.norm(q, axis=1)
            near += long[:, None] * (left + ROUNDING * size)
            for part in np.array_split(np.flatnonzero(~(near < bar[:, None]) & ~np.isneginf(near)), max(1, near.size // PAIRS)):
                x, y = np.divmod(part, len(v))
                exact[x, y] = np.einsum("nd,nd->n", q[x], v[y])
            x, y = np.nonzero((exact >= kth(exact, k)[:, None]) & ~np.isneginf(exact))
            score = exact[x, y]
            order = np.lexsort((ids[y], -score, x))
            x, y, score = x[order], y[order], score[order]
            keep = np.arange(len(x)) - np.searchsorted(x, x) <= k
            out.append(pd.DataFrame({"q": b["rep"].to_numpy()[lo : lo + 256][x[keep]], "c": ids[y[keep]], "score": score[keep]}))
        return pd.concat(out)

    hits = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(rank, "q long, c long, score double")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    hits = hits.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= k + 1).drop("rn")
    named = hits.join(members.select(F.col("rep").alias("c"), "vec_id"), "c")
    out = asked.select("query_id", F.col("rep").alias("q")).join(named, "q").where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
