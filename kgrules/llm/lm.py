"""Language-model scores: a hashed maximum-entropy model with class-factored softmax beside add-one unigram scores.

Tokens are the words of a text (A-Z lower-cased, split at ASCII white space) and one end. Counts cover all learning documents.
The commonest words, the head, are leaves of a tree; all other words are dealt into groups by their hash, which are leaves too.
The tree is the factored softmax: classes at the root, classes of classes below, ``WIDE`` ways each, as shallow as a leaf is
common. P(leaf | context) is the product along its path, and a word of a group has its add-one share of the group, in which
one more share is left to unknown words; so the model sums to one over the known words and one unknown word of each group.
Context features are the word before, the two words before, and the word before that (skipping one). Each is hashed to a bucket
of the node, a row of ``WIDE`` weights; a node has buckets in proportion to its tokens. Head and groups grow with the cube root
of the tokens, buckets with the fourth root, so that what is broadcast is far smaller than the input.

Training are synchronous gradient rounds: the gradient of a row is what was observed less what the model expects, both summed
over all partitions, and the update moves each weight by the logarithm of their smoothed ratio, after a row's gradient is shrunk
by the part of it that chance explains. The first round takes the
gradient of the unigram model, whose expectations are known from the counts, over the folds of ``ROUNDS[0]``; the next one
that of the weights so far over the remaining folds. So every learning document is used once, and the result doesn't
depend on how rows are dealt to partitions (but for the rounding of sums).

Cases: a null or empty text has the end as its only token. Rows are told apart by position, so null ids (remainder of '') and
repeated ids give a row each. Without learning documents all counts are 0. Words are known by a 64-bit hash. Other columns
are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remainder, slices, text_or_empty

WIDE, TEMPLATES, FLUSH = 32, 3, 500_000
#: Words of the head and groups, as multiples of the cube root of the tokens; buckets, of their fourth root.
HEAD, GROUPS, BUCKETS = 64, 2, 512
#: Strength of the prior in counts, size of the steps, and the largest one.
PRIOR, RATES, CLIP = 20.0, (0.8, 0.5), 4.0
#: Places of the learning folds, in order of their remainders, that each round takes.
ROUNDS = ((0, 1, 2, 3), (4, 5))
#: Tokens of a batch, tokens of a task between two reports, rows of a block of them.
BATCH, REPORT, BLOCK = 1 << 16, 1 << 23, 4096
#: No word holds a space.
END, START = (xxhash.xxh3_64_intdigest(b) for b in (b" end", b" start"))
LOG10 = math.log(10)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


class Table:
    """Open addressing from 64-bit hashes to positions; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(len(keys), 1)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.values[at[left]] < 0
            first = np.unique(at[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            out[left] = self.values[at[left]]
            left = left[(out[left] >= 0) & (self.keys[at[left]] != keys[left])]
        return out


class Tree:
    """Leaves below nodes of at most WIDE children, such that the mean depth is least.

    ``path``, ``turn``: node and child of each leaf at each level from the root, child -1 below its depth; ``bias``: log shares
    of each node's children; ``first``, ``size``: a node's buckets, of ``rows`` in all.
    """

    def __init__(self, weights: np.ndarray, buckets: int):
        n = len(weights)
        heap = [(0.0, i - WIDE, -1) for i in range(-(n - 1) % (WIDE - 1))] + [(w, i, i) for i, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        nodes = -(-(n - 1) // (WIDE - 1))
        above, place, mass = np.full(n + nodes, -1), np.zeros(n + nodes, np.int64), np.zeros(nodes)
        share = np.zeros((nodes, WIDE))
        for k in range(nodes):
            children = [heapq.heappop(heap) for _ in range(WIDE)][::-1]
            for j, (w, _, i) in enumerate(children):
                share[k, j] = w
                if i >= 0:
                    above[i], place[i] = k, j
            mass[k] = sum(w for w, _, _ in children)
            heapq.heappush(heap, (mass[k], n + k, n + k))
        up, at = [], np.arange(n)
        while (alive := at >= 0).any() and nodes:
            here = np.where(alive, at, 0)
            parent = np.where(alive, above[here], -1)
            if (parent < 0).all():
                break
            up.append((parent, np.where(parent >= 0, place[here], -1)))
            at = np.where(parent >= 0, n + parent, -1)
        depth = sum(((p >= 0).astype(np.int64) for p, _ in up), np.zeros(n, np.int64))
        self.path, self.turn = np.zeros((n, len(up)), np.int32), np.full((n, len(up)), -1, np.int8)
        for k, (parent, j) in enumerate(up):
            on = np.flatnonzero(parent >= 0)
            self.path[on, depth[on] - 1 - k], self.turn[on, depth[on] - 1 - k] = parent[on], j[on]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.bias = np.maximum(np.log(share / share.sum(axis=1, keepdims=True)), -60).astype(np.float32)
        self.size = np.maximum(1, buckets * mass / max(mass.sum(), 1)).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.rows = int(self.size.sum())

    def node_of_rows(self) -> np.ndarray:
        return np.tile(np.repeat(np.arange(len(self.size)), self.size), TEMPLATES)


@dataclass
class Shared:
    """What goes to the executors: the head's words and counts, the groups' masses, the tree and the weights."""

    hashes: np.ndarray
    counts: np.ndarray
    mass: np.ndarray
    tree: Tree
    weights: np.ndarray
    table: Table | None = field(default=None, compare=False)

    def leaves(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each token, and whether that is a group."""
        if self.table is None:
            self.table = Table(self.hashes)
        rank = self.table.find(h)
        tail = rank < 0
        return np.where(tail, len(self.hashes) + group_of(h, len(self.mass)), rank), tail

    def levels(self, h: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level of the tree: the tokens that reach it, the rows of their features, their nodes and their children."""
        tree = self.tree
        keys = (_mixed(h[at - 1], h[at - 2]) >> np.uint64(32)).astype(np.int64)
        base = np.arange(TEMPLATES) * tree.rows
        for k in range(tree.path.shape[1]):
            on = np.flatnonzero(tree.turn[leaf, k] >= 0)
            if not len(on):
                return
            own = leaf[on]
            node = tree.path[own, k]
            yield on, ((keys[on] * tree.size[node][:, None]) >> 32) + (tree.first[node][:, None] + base), node, tree.turn[own, k].astype(np.int64)

    def logits(self, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
        z = self.tree.bias.take(node, axis=0)
        for j in range(TEMPLATES):
            z += self.weights.take(rows[:, j], axis=0)
        return z


def group_of(h: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(signed(h), groups)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key for each template (n, 3), from the word before and the one before that."""
    return np.stack([a, b * np.uint64(0xC2B2AE3D27D4EB4F) + (a >> np.uint64(1)), b], axis=1) * np.uint64(0x9E3779B97F4A7C15)


def log_probs(s: Shared, h: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Natural logs of P(leaf | context)."""
    out = np.zeros(len(at))
    for on, rows, node, child in s.levels(h, at, leaf):
        z = s.logits(rows, node)
        own = z[np.arange(len(on)), child]
        out[on] += own - np.log(np.exp(z, out=z).sum(axis=1))
    return out


def _stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with two starts before each text and an end after it, positions of tokens, text of each token)."""
    parts, sizes = [], []
    digest = xxhash.xxh3_64_intdigest
    edge = np.array([START, START], np.uint64)
    for t in texts:
        w = words(t)
        parts += [edge, np.fromiter(map(digest, w), np.uint64, len(w)), np.array([END], np.uint64)]
        sizes.append(len(w) + 1)
    h = np.concatenate(parts)
    n = np.array(sizes)
    text = np.repeat(np.arange(len(n)), n)
    return h, np.arange(len(text)) + 2 * (text + 1), text


def _chunks(texts: list[str | None], chars: int = 400_000) -> Iterator[tuple[int, list[str | None]]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or i == len(texts) - 1:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, ends = Counter(), 0

    def flush() -> pa.RecordBatch:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["h", "c"])

    for x in slices(batches):
        for t in x.column("text").to_pylist():
            seen.update(words(t))
            ends += 1
        if len(seen) > FLUSH:
            yield flush()
            seen.clear()
    if seen:
        yield flush()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.array([END]))), pa.array([ends], pa.int64())], ["h", "c"])


def counts(docs: DataFrame) -> DataFrame:
    """(h, c): the count of each token, by its hash."""
    return docs.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _add(table: np.ndarray, rows: np.ndarray, values: np.ndarray, few: int = 16) -> None:
    """Adds values[i] to table[rows[i]]; rows may repeat. The k-th values of all rows are added at a time, what a row has beyond
    ``few`` as a block, as ``reduceat`` over rows of few columns is slow."""
    by = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")  # 16 bits sort fastest
    own = rows[by]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    size = np.diff(np.append(first, len(own)))
    order = np.argsort(-size, kind="stable")  # those with a k-th value come first
    first, size = first[order], size[order]
    own, more = own[first], [int(np.searchsorted(-size, -k, side="left")) for k in range(few + 1)]
    sums = values.take(by[first], axis=0)
    for k in range(1, few):
        sums[: more[k]] += values.take(by[first[: more[k]] + k], axis=0)
    for i in range(more[few]):
        sums[i] += values.take(by[first[i] + few : first[i] + size[i]], axis=0).sum(axis=0)
    sums += table.take(own, axis=0)
    table[own] = sums


REPORTED = "block int, rows binary, n binary, o binary, e binary"


def _sums(shared, expect: bool):
    """Observed and, with ``expect``, expected children of each row over a partition's tokens, in blocks of rows."""

    def report(o: np.ndarray, e: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        n = o.sum(axis=1)
        for lo in range(0, len(o), BLOCK):
            rows = np.flatnonzero(n[lo : lo + BLOCK])
            if len(rows):
                at = lo + rows
                share = lambda x: (x[at] / n[at, None]).astype(np.float16).tobytes()  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array([lo // BLOCK], pa.int32()), *(pa.array([v], pa.binary()) for v in (rows.astype(np.uint16).tobytes(), n[at].tobytes(), share(o), None if e is None else share(e)))], ["block", "rows", "n", "o", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        o = e = None
        seen = 0
        for x in slices(batches):
            for _, part in _chunks(x.column("text").to_pylist()):
                if o is None:
                    o, e = np.zeros(s.weights.shape, np.float32), np.zeros(s.weights.shape, np.float32) if expect else None
                h, every, _ = _stream(part)
                leaf, _ = s.leaves(h[every])
                for lo in range(0, len(every), BATCH):
                    for _, rows, node, child in s.levels(h, every[lo : lo + BATCH], leaf[lo : lo + BATCH]):
                        if expect:
                            p = s.logits(rows, node)
                            np.exp(p, out=p)
                            p /= p.sum(axis=1, keepdims=True)
                            for j in range(TEMPLATES):
                                _add(e[j * s.tree.rows : (j + 1) * s.tree.rows], rows[:, j] - j * s.tree.rows, p)
                        np.add.at(o.reshape(-1), (rows * WIDE + child[:, None]).ravel(), np.float32(1))
                seen += len(every)
                if seen >= REPORT:
                    yield from report(o, e)
                    o, seen = None, 0
        if o is not None:
            yield from report(o, e)

    return run


def _added(t: pa.Table) -> pa.Table:
    n, o, e = np.zeros(BLOCK), np.zeros((BLOCK, WIDE)), np.zeros((BLOCK, WIDE))
    both = t.column("e").null_count == 0
    for r in t.to_pylist():
        rows, k = np.frombuffer(r["rows"], np.uint16), np.frombuffer(r["n"], np.float32).astype(np.float64)
        n[rows] += k
        o[rows] += np.frombuffer(r["o"], np.float16).reshape(-1, WIDE) * k[:, None]
        if both:
            e[rows] += np.frombuffer(r["e"], np.float16).reshape(-1, WIDE) * k[:, None]
    rows = np.flatnonzero(n)
    share = lambda x: (x[rows] / n[rows, None]).astype(np.float16).tobytes()
    return pa.table({"block": t.column("block")[:1], "rows": pa.array([rows.astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([n[rows].astype(np.float32).tobytes()], pa.binary()), "o": pa.array([share(o)], pa.binary()), "e": pa.array([share(e) if both else None], pa.binary())})


def train(docs: DataFrame, fold: str, shared: Shared, tokens: int, scratch: Scratch) -> Shared:
    """``shared`` with trained weights. ``docs``: (text, and the place of the document's fold)."""
    context = docs.sparkSession.sparkContext
    node = shared.tree.node_of_rows()
    # so many tasks that what they report is less than the input, whose tokens take some two bytes each
    most = max(4, 2 * tokens // (len(ROUNDS) * shared.weights.size * 3))
    for k, (places, rate) in enumerate(zip(ROUNDS, RATES, strict=True)):
        own = docs.where(F.col(fold).isin(*places)).select("text")
        parts = own.coalesce(most).mapInArrow(_sums(context.broadcast(shared), k > 0), REPORTED)
        parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(most)))))
        # two levels: neither task gathers all reports of a block
        level = parts.groupBy("g", "block").applyInArrow(_added, REPORTED)
        done = scratch.keep(level.groupBy("block").applyInArrow(_added, REPORTED))
        weights = shared.weights.copy()
        for r in done.toLocalIterator():  # the table of weights, a block at a time
            at = r.block * BLOCK + np.frombuffer(r.rows, np.uint16).astype(np.int64)
            n = np.frombuffer(r.n, np.float32).astype(np.float64)[:, None]
            o = np.frombuffer(r.o, np.float16).reshape(-1, WIDE).astype(np.float64)
            e = np.exp(shared.tree.bias[node[at]].astype(np.float64)) if r.e is None else np.frombuffer(r.e, np.float16).reshape(-1, WIDE).astype(np.float64)
            o, e = o * n, e * n
            # the part of what was observed that chance does not explain (James and Stein's shrinkage, cells of one count at least)
            chance, seen = (e / (e + 1)).sum(axis=1, keepdims=True), ((o - e) ** 2 / (e + 1)).sum(axis=1, keepdims=True)
            o = e + np.maximum(0, 1 - chance / np.maximum(seen, 1e-9)) * (o - e)
            ratio = (o + PRIOR * e / n + 1e-9) / (e + PRIOR * e / n + 1e-9)
            weights[at] += (rate * np.clip(np.log(ratio), -CLIP, CLIP)).astype(np.float32)
        shared = Shared(shared.hashes, shared.counts, shared.mass, shared.tree, weights)
    return shared


def score(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """The scores of every row; learns from rows whose remainder modulo ``modulus`` isn't ``held``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rest_of = remainder("doc_id", modulus)
    # the learning folds in order, dealt to the places of the rounds
    folds = [r for r in range(modulus) if r != held]
    place = F.element_at(F.array(*(F.lit(folds.index(r) * sum(map(len, ROUNDS)) // len(folds) if r in folds else -1) for r in range(modulus))), (rest_of + 1).cast("int"))
    learning = docs.where(rest_of != held).select(text_or_empty().alias("text"), place.alias("place"))
    table = scratch.keep(counts(learning))
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    root = max(total, 1) ** (1 / 3)
    top = table.orderBy(F.desc("c"), "h").limit(math.ceil(HEAD * root)).toArrow()
    hashes, c = (top.column(k).to_numpy() for k in ("h", "c"))
    hashes = hashes.view(np.uint64)
    groups = math.ceil(GROUPS * root)
    least = (int(c[-1]), int(hashes[-1].view(np.int64))) if len(top) else (0, 0)
    rest = table.where((F.col("c") < least[0]) | (F.col("c") == least[0]) & (F.col("h") > least[1]))
    # a count of one more for each word, and one unknown word in each group
    mass = np.ones(groups)
    for r in rest.groupBy(F.pmod("h", F.lit(groups).cast("long")).alias("g")).agg(F.sum(F.col("c") + 1).alias("n")).collect():
        mass[r.g] += r.n
    tree = Tree(np.concatenate([c + 1.0, mass]), math.ceil(BUCKETS * max(total, 1) ** 0.25))
    model = Shared(hashes, c, mass, tree, np.zeros((TEMPLATES * tree.rows, WIDE), np.float32))
    if total:
        model = train(learning, "place", model, total, scratch)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        log_c, log_mass = np.log10(s.counts + 1.0), np.log10(s.mass)
        for x in slices(batches):
            n, known, base, model, rare, tf = [], [], [], [], [], []
            for _, part in _chunks(x.column("text").to_pylist()):
                h, at, text = _stream(part)
                leaf, tail = s.leaves(h[at])
                lp = np.concatenate([log_probs(s, h, at[i : i + BATCH], leaf[i : i + BATCH]) for i in range(0, len(at), BATCH)]) / LOG10
                lp[tail] -= log_mass[leaf[tail] - len(s.hashes)]
                head = ~tail
                add = lambda v, on: np.bincount(text[on], v, len(part)).tolist()  # noqa: E731, B023
                n += np.bincount(text, minlength=len(part)).tolist()
                known += np.bincount(text[head], minlength=len(part)).tolist()
                base += add(log_c[leaf[head]], head)
                model += add(lp, slice(None))
                # each tail word of a text once, with its count
                of, w = text[tail], h[at[tail]]
                by = np.lexsort((w, of))
                of, w = of[by], w[by]
                first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (w[1:] != w[:-1]))[: len(w)])
                cut = pa.array(np.searchsorted(of[first], np.arange(len(part) + 1)).astype(np.int32))
                rare.append(pa.ListArray.from_arrays(cut, pa.array(signed(w[first]))))
                tf.append(pa.ListArray.from_arrays(cut, pa.array(np.diff(np.append(first, len(w))).astype(np.int32))))
            lists = lambda v, k: pa.concat_arrays(v) if v else pa.array([], pa.list_(k))
            yield pa.RecordBatch.from_arrays(
                [x.column("doc_id"), x.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64()), lists(rare, pa.int64()), lists(tf, pa.int32())],
                ["doc_id", "held_out", "n_tokens", "known", "base", "model", "rare", "tf"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>, tf array<int>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (rest_of == held).alias("held_out"), text_or_empty().alias("text")).mapInArrow(run, schema)
    rows = scratch.keep(rows.withColumn("rid", F.monotonically_increasing_id()))
    each = rows.select("rid", F.inline(F.arrays_zip("rare", "tf"))).withColumnRenamed("rare", "h")
    found = each.join(table, "h")  # words without a count add log10(1) = 0
    more = found.groupBy("rid").agg(F.sum("tf").alias("k"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("s"))
    out = rows.select("rid", "doc_id", "held_out", "n_tokens", "known", "base", "model").join(more, "rid", "left")
    s = F.coalesce("s", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + s - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("model") + s).alias("score"),
    )
