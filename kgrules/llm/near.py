"""Near-duplicate linking shared by document and line deduplication.

Circulant MinHash: a permutation ``sigma`` scatters the shingles over D places and one further permutation ``pi`` is
read at shifted places, ``h_k(x) = pi[(sigma(x) + k) mod D]``. So two permutations give all signature coordinates, and
the K coordinates of one shingle are K neighbouring entries of ``pi``: one row gather and one vectorised minimum.

Links are found in rounds that never list all pairs of a bucket:

1. every member is verified against the smallest leader of its buckets (a bucket's leader is its smallest id), and then
   against those other leaders of its buckets from which it is still apart;
2. for the pairs left over - members of one bucket, no leader, different components so far - members that buckets
   connect make a family, and families are compared as matrices; of the links a spanning forest comes out. Buckets
   whose members all fell into one component, as large groups of copies do, leave nobody. Chains of buckets join ever
   more members as the corpus grows, so a family beyond one block is compared bucket by bucket, and a bucket beyond one
   in blocks.

A pair of one bucket is thus compared on full sets or already connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of signature rows that are gathered at a time; keys that a partition holds before it passes them on; keys of a range.
CHUNK, HELD, RANGE = 1 << 19, 1 << 20, 1 << 18
#: Members of a block in the comparison of what the stars leave.
BLOCK = 512
#: Members, of several small families, that are compared in one call.
GROUP = 256
#: Edges that one task joins.
FEW = 1 << 17


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (xor-shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xA0761D6478BD642F)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k values of h, in their order: of runs of 2, 4, 8, ..., and of two that overlap at the end."""
    acc, width = h, 1
    while width < k:
        step = min(width, k - width)
        acc = acc[:-step] * MIX + acc[step:]
        acc ^= acc >> np.uint64(31)
        acc *= ODD
        width += step
    return acc ^ (acc >> np.uint64(32)) if k > 1 else mix64(h)


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the runs of k values of h, sorted; of the whole of h where it is shorter."""
    runs = np.sort(_runs(h, min(k, len(h))))
    return runs[np.append(True, runs[1:] != runs[:-1])]


def char_runs(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with at least k code points each: the hashes of all runs of the texts laid end to end, the position of
    each text's first run, how many it has, and how many distinct ones.

    Distinct runs are told apart by 48 bits here, as the text's number takes the other 16.
    """
    assert len(texts) <= 1 << 16
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    runs = _runs(flat, k)
    seen = runs >> np.uint64(16)
    seen |= np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(48), size)[: len(runs)]
    inside = np.ones(len(runs), bool)  # runs across the end of a text don't count
    inside[(start[1:, None] - np.arange(1, k)).ravel()] = False
    seen = np.sort(seen[inside])
    fresh = np.append(True, seen[1:] != seen[:-1])
    return runs, start, size - k + 1, np.bincount((seen[fresh] >> np.uint64(48)).astype(np.int64), minlength=len(texts))


def word_shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, A-Z lower-cased, words split at ASCII white space.

    Fewer than k words: one shingle of all of them; no words or null: empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return _rolled(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), k)


def char_shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k code points; the whole text where it is shorter; null or '': empty."""
    if not text:
        return np.empty(0, np.uint64)
    return _rolled(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), k)


class Circulant:
    """Band keys of shingle sets. ``places``: D; ``rows`` coordinates make a band key, of which there are ``bands``."""

    def __init__(self, bands: int, rows: int, places: int = 1 << 22, seed: int = 7):
        assert places & (places - 1) == 0
        self.bands, self.rows, self.places, self.seed = bands, rows, places, seed

    @property
    def tables(self) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        return _tables(self.places, self.bands * self.rows, self.seed)

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """int64 array of shape (len(sets), bands); rows of empty sets mean nothing."""
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        return self.keys_of(np.concatenate([*sets, np.empty(0, np.uint64)]), np.cumsum(size) - size, size)

    def keys_of(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same of the sets ``flat[start : start + size]``; members may repeat.

        Sets of about one size are taken together, so that a minimum is that of whole blocks.
        """
        sigma, windows, odd = self.tables
        k = self.bands * self.rows
        sig = np.zeros((len(size), k), windows.dtype)
        at = ((flat >> np.uint64(7)) & np.uint64(self.places - 1)).view(np.int64)
        if sigma is not None:
            at = sigma.take(at)
        short, begin = size.astype(np.int32) - 1, start.astype(np.int32)
        order = np.argsort(size, kind="stable")
        order = order[np.searchsorted(size[order], 1) :]
        most, lo, sizes = max(1, CHUNK // (k * windows.itemsize)), 0, size[order].tolist()
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * sizes[hi] <= most:
                hi += 1
            own, longest = order[lo:hi], sizes[hi - 1]
            low = None
            for first in range(0, longest, most):
                place = np.minimum(np.arange(first, min(first + most, longest), dtype=np.int32)[:, None], short[own]) + begin[own]
                rows = at.take(place.ravel())
                block = windows.take(rows, axis=0) if windows.flags.c_contiguous else windows[rows]
                block = np.minimum.reduce(block.reshape(len(place), -1), axis=0).reshape(len(own), k)
                low = block if low is None else np.minimum(low, block)
            sig[own] = low
            lo = hi
        h = (sig.reshape(len(size), self.bands, self.rows).astype(np.uint64) * odd[: self.rows]).sum(axis=2, dtype=np.uint64)
        return mix64(h + np.arange(1, self.bands + 1, dtype=np.uint64) * MIX).view(np.int64)


@lru_cache(2)
def _tables(places: int, k: int, seed: int) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    kind = np.uint16 if places <= 1 << 16 else np.uint32
    sigma, pi = rng.permutation(places), rng.permutation(places).astype(kind)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
    if places <= 1 << 16:  # small enough to hold; rows are gathered faster from a copy, in the order of sigma's arguments
        sigma, windows = None, windows[sigma]
    return sigma, windows, rng.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_key(s: np.ndarray) -> bytes:
    """128-bit identity of a shingle set."""
    return xxhash.xxh3_128_digest(s.tobytes())


Shingler = Callable[[str], np.ndarray]


STAR = "key long, id long, n int, lead long, lead_n int, near boolean"


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key, 0 to ranges - 1; rises with the key."""
    return (((keys >> 32) + (1 << 31)) * ranges) >> 32


def _led(keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members by key and then id, each once; which are a bucket's first, and the position of each one's first."""
    order = np.argsort(keys)
    keys, ids, n = keys[order], ids[order], n[order]
    same = keys[1:] == keys[:-1]
    many = np.flatnonzero(np.append(False, same)[: len(keys)] | np.append(same, False)[: len(keys)])  # few: most are alone
    by = np.lexsort((ids[many], keys[many]))
    ids[many], n[many] = ids[many[by]], n[many[by]]
    once = np.append(True, ~same | (ids[1:] != ids[:-1]))[: len(keys)]
    keys, ids, n = keys[once], ids[once], n[once]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    return keys, ids, n, first, np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))


def _packed(ranges: int, bands: int):
    """Partitions' members as sorted arrays by ranges of keys: a bucket's smallest id of each, and its other members with that one."""

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, n, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, ids, n, first, lead = _led(keys, np.repeat(ids, bands), np.repeat(n, bands))
        rest = np.flatnonzero(~first)
        rows = []
        if len(rest):
            rows.append((int(_ranges(mix64(ids[rest[:1]].view(np.uint64)).view(np.int64), ranges)[0]), keys[rest], ids[rest], n[rest], ids[lead[rest]], n[lead[rest]]))
        keys, ids, n = keys[first], ids[first], n[first]
        of = _ranges(keys, ranges)
        cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        rows += [(int(of[i]), keys[i:j], ids[i:j], n[i:j], None, None) for i, j in zip(cut, cut[1:], strict=False)]
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array(r[:1], pa.int32()), *(pa.array([None if a is None else a.tobytes()], pa.binary()) for a in r[1:])], ["range", "keys", "ids", "ns", "leads", "lead_ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in batches:
            if not len(x):
                continue
            held.append((x.column("id").to_numpy(), x.column("n").to_numpy().astype(np.int32), np.frombuffer(b"".join(x.column("bands").to_pylist()), np.int64)))
            size += len(held[-1][2])
            if size >= HELD:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _stars(t: pa.Table) -> pa.Table:
    """The members of one range of keys, each with its bucket's smallest id; members met in their partition keep that one's."""
    out = []
    own, passed = t.filter(pa.compute.is_null(t.column("leads"))), t.filter(pa.compute.is_valid(t.column("leads")))
    arrays = lambda part, c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind)
    keys, ids, n, first, lead = _led(arrays(own, "keys", np.int64), arrays(own, "ids", np.int64), arrays(own, "ns", np.int32))
    rest = np.flatnonzero(~first)
    out.append((keys[rest], ids[rest], n[rest], ids[lead[rest]], n[lead[rest]], np.zeros(len(rest), bool)))
    if len(passed):
        some = [arrays(passed, c, k) for c, k in (("keys", np.int64), ("ids", np.int64), ("ns", np.int32), ("leads", np.int64), ("lead_ns", np.int32))]
        out.append((*some, np.ones(len(some[0]), bool)))
    return pa.table({c: np.concatenate(x) for c, x in zip(("key", "id", "n", "lead", "lead_n", "near"), zip(*out, strict=True), strict=True)})


def stars(nodes: DataFrame, bands: int, scratch: Scratch) -> DataFrame:
    """(key, id, n, lead, lead_n) of every member of a bucket of two or more but its leader, the smallest id.

    ``nodes``: (id, n, bands binary), rows may repeat. Keys travel as arrays by ranges, whose number grows with the keys.
    A partition sends only its smallest id of a bucket to the bucket's range; its other members stay apart, and learn
    their leader by a join, so a bucket that all share is in no single task.
    """
    ranges = max(1, -(-nodes.count() * bands // RANGE))
    packed = nodes.select("id", "n", "bands").mapInArrow(_packed(ranges, bands), "range int, keys binary, ids binary, ns binary, leads binary, lead_ns binary")
    found = scratch.keep(packed.groupBy("range").applyInArrow(_stars, STAR))
    far = found.where("not near").drop("near")
    # the leaders grow with the corpus: the join is a merge at every size, not a broadcast at some
    lead = scratch.keep(far.groupBy("key").agg(F.min("lead").alias("l"), F.min_by("lead_n", "lead").alias("ln")))
    near = found.where("near").join(lead.hint("merge"), "key", "left")
    return far.unionByName(near.select("key", "id", "n", F.coalesce("l", "lead").alias("lead"), F.coalesce("ln", "lead_n").alias("lead_n")))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sets without repeats share."""
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def verify(pairs: DataFrame, texts: DataFrame, shingler: Shingler) -> DataFrame:
    """(a, b, inter, uni): sizes of the intersection and union of the full shingle sets of each pair's texts."""
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = lru_cache(64)(shingler)
        for x in slices(batches):
            inter, uni = [], []
            for s, t in zip(x.column("ta").to_pylist(), x.column("tb").to_pylist(), strict=True):
                s, t = cached(s), cached(t)
                n = _overlap(s, t)
                inter.append(n)
                uni.append(len(s) + len(t) - n)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(inter, pa.int64()), pa.array(uni, pa.int64())], ["a", "b", "inter", "uni"])

    return pairs.join(tb.hint("merge"), "b").join(ta.hint("merge"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, inter long, uni long")


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest id that each id of a few edges reaches: union by the smaller root."""
    pairs = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches if len(x)]
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)].tolist(), flat[len(a) :].tolist()
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in zip(a, b, strict=True):
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[[find(i) for i in range(len(ids))]])], ["id", "root"])


def components(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """(id, comp): the smallest id that can be reached from each id with a link. ``edges``: (a, b) longs.

    Each round hooks every vertex to its smallest neighbour, doubles the pointers until they are roots, and contracts
    the edges to the roots; at least every second vertex with an edge goes, so rounds grow with the logarithm of the ids.
    Once at most ``few`` edges are left, one task joins them.
    """
    left, n = scratch.counted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    done, empty = None, left
    while n:
        if n <= few:
            hooked = left.coalesce(1).mapInArrow(_rooted, "id long, root long")
        else:
            both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hooked = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
            moved = 1
            while moved:
                up = hooked.select(F.col("id").alias("root"), F.col("root").alias("above"))
                further, moved = scratch.counted(hooked.join(up, "root").select("id", F.col("above").alias("root"), (F.col("root") != F.col("above")).alias("moved")), "moved")
                scratch.drop(hooked)
                hooked = further.select("id", "root")
                hooked._scratch_path = further._scratch_path
        if done is None:
            done = scratch.keep(hooked) if n <= few else hooked
        else:
            nxt = hooked.select(F.col("id").alias("root"), F.col("root").alias("above"))
            done = scratch.keep(done.join(nxt, "root", "left").select("id", F.coalesce("above", "root").alias("root")))
        if n <= few:
            break
        ra, rb = hooked.select(F.col("id").alias("a"), F.col("root").alias("ra")), hooked.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        left, n = scratch.counted(left.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if done is None:
        return empty.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return done.select("id", F.col("root").alias("comp"))


def link(nodes: DataFrame, bands: int, texts: Callable[[DataFrame], DataFrame], shingler: Shingler, percent: int, scratch: Scratch) -> DataFrame:
    """(id, comp) of the ids that are linked with another: 100 * intersection >= percent * union of their shingle sets.

    ``nodes``: (id long, n long, bands binary: so many keys as int64), rows may repeat; ``texts`` gives (id, text) of ids (id).
    """
    star = scratch.keep(stars(nodes.where("n > 0"), bands, scratch))
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    good = lambda x: x.where(100 * F.col("inter") >= percent * F.col("uni")).select("a", "b")

    got = scratch.keep(texts(star.select(F.explode(F.array("id", "lead")).alias("id")).distinct()))

    def verified(pairs: DataFrame) -> DataFrame:
        return scratch.keep(verify(pairs, got, shingler))

    def of(comp: DataFrame, c: str) -> DataFrame:
        return comp.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))

    def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs that aren't in one component yet."""
        joined = pairs.join(of(comp, "a"), "a", "left").join(of(comp, "b"), "b", "left")
        return joined.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")

    # every member with the smallest of its leaders, then with the other leaders from which that left it apart
    led = scratch.keep(star.where(fits(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    checked = verified(led.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    comp = components(good(checked), scratch)
    more = verified(apart(led.join(checked, ["a", "b"], "left_anti"), comp))
    checked = checked.unionAll(more)
    if not good(more).isEmpty():
        comp = components(good(checked), scratch)

    # what the stars leave: members of one bucket, no leader, not connected yet
    member = star.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = member.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    member, n = scratch.counted(member.join(mixed, "key", "left_semi").select("key", "id", "comp", "lead").distinct())
    if not n:
        return comp
    family = components(member.select(F.col("lead").alias("a"), F.col("id").alias("b")), scratch)
    more, n = scratch.counted(blocked(grouped(member, family, scratch), got, shingler, percent, scratch))
    return components(good(checked).unionAll(more), scratch) if n else comp


def grouped(member: DataFrame, family: DataFrame, scratch: Scratch, most: int = BLOCK) -> DataFrame:
    """(id, comp, family): who is to be compared. Families of at most ``most`` members stay as they are; in place of a larger
    one come its buckets, of those with the same members one.

    ``member``: (key, id, comp) of buckets, rows differ; ``family``: (id, comp: the family).
    """
    member = scratch.keep(member.join(family.select("id", F.col("comp").alias("family")), "id").select("key", "id", "comp", "family"))
    wide = member.select("family", "id").distinct().groupBy("family").agg(F.count("*").alias("k")).where(F.col("k") > most).select("family")
    wide = scratch.keep(wide)
    whole = member.join(wide, "family", "left_anti").select("id", "comp", "family").distinct()
    rest = member.join(wide, "family", "left_semi")
    same = (F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    one = rest.groupBy("key").agg(*same).groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key")
    # written once: the comparison reads it three times
    return scratch.keep(whole.unionAll(rest.join(one, "key", "left_semi").select("id", "comp", F.col("key").alias("family"))))


def blocked(members: DataFrame, texts: DataFrame, shingler: Shingler, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between members (id, comp, family) of one family and different components, that connect what all such
    links connect; a comparison of n members gives fewer than n of them.

    A family is dealt into blocks of about BLOCK members, large components into blocks of their own, and pairs of blocks are
    compared as matrices of members by shared shingles. Blocks of one large component meet no
    other of it. A family within one block, as nearly all are, is one pair; a group of Spark's holds several of these.
    """
    sizes = members.groupBy("family", "comp").agg(F.count("*").alias("k")).withColumn("big", F.when(F.col("k") >= BLOCK, F.col("comp")))
    parts = sizes.groupBy("family", "big").agg(F.ceil(F.sum("k") / BLOCK).cast("int").alias("parts"))
    dealt = members.join(sizes.select("family", "comp", "big"), ["family", "comp"]).join(parts.withColumnRenamed("big", "of"), "family").where(F.col("big").eqNullSafe(F.col("of")))
    dealt, n = scratch.counted(dealt.select("id", "comp", "family", "big", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")))
    blocks = dealt.select("family", "big", "part").distinct()
    x, y = (blocks.select("family", F.col("big").alias(f"big{i}"), F.col("part").alias(f"part{i}")) for i in (0, 1))
    order = lambda i: F.struct(F.coalesce(f"big{i}", F.lit(-(1 << 63))).alias("b"), F.col(f"part{i}").alias("p"))
    pairs = x.join(y, "family").where((order(0) <= order(1)) & (F.col("big0").isNull() | ~F.col("big0").eqNullSafe(F.col("big1"))))
    two = ~(F.col("big0").eqNullSafe(F.col("big1")) & (F.col("part0") == F.col("part1")))
    pairs, crossed = scratch.counted(pairs.withColumn("pair", F.monotonically_increasing_id()).withColumn("two", two), "two")
    sides = []
    for i in (0, 1):
        p = pairs if i == 0 else pairs.where("two")
        p = p.select("family", F.col(f"big{i}").alias("of"), F.col(f"part{i}").alias("part"), "pair")
        sides.append(dealt.join(p, ["family", "part"]).where(F.col("big").eqNullSafe(F.col("of"))).select("pair", F.lit(i).alias("side"), "id", "comp"))
    rows = sides[0].unionAll(sides[1]).join(texts.select("id", "text").hint("merge"), "id")
    groups = max(1, (n + 2 * BLOCK * crossed) // GROUP)

    def links(t: pa.Table) -> pa.Table:
        t = t.sort_by("pair")
        pair, ids, comps, side = (t.column(c).to_numpy() for c in ("pair", "id", "comp", "side"))
        cut = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
        found = [np.empty((2, 0), np.int64)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            sets = [shingler(x) for x in t.column("text").slice(lo, hi - lo).to_pylist()]
            found.append(ids[lo:hi][_linked(sets, comps[lo:hi], side[lo:hi], percent)])
        a, b = np.concatenate(found, axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy(F.pmod(F.xxhash64("pair"), F.lit(groups)).alias("of")).applyInArrow(links, "a long, b long")


def _linked(sets: list[np.ndarray], comps: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Positions of the linked members of side 0 (first row) and of side 1, or of side 0 again where there is no side 1:
    of all links as many as connect the components that they connect."""
    n = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    row, column = row[shared], (np.cumsum(seen > 1) - 1)[column[shared]]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    inter = np.zeros((len(left), len(right)), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    tokens = int((seen > 1).sum())
    for lo in range(0, tokens, 8192):
        at = slice(*np.searchsorted(column, (lo, lo + 8192)))
        dense = np.zeros((len(sets), min(8192, tokens - lo)), np.float32)
        dense[row[at], column[at] - lo] = 1
        inter += dense[left] @ dense[right].T
    uni = n[left][:, None] + n[right][None, :] - inter
    i, j = np.nonzero((100 * inter >= percent * uni) & (comps[left][:, None] != comps[right][None, :]))
    i, j = left[i], right[j]
    if len(i) > 1:
        of = np.unique(comps, return_inverse=True)[1]
        one = _forest(of[i], of[j])
        i, j = i[one], j[one]
    return np.stack([i, j])


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links, fewer than what they join, that reach all that the links a - b reach. ``a``, ``b``: small numbers that differ.

    Each round hooks every root with a smaller neighbour to its smallest one.
    """
    root, at, out = np.arange(max(a.max(), b.max()) + 1), np.arange(len(a)), []
    while True:
        x, y = root[a[at]], root[b[at]]
        apart = x != y
        if not apart.any():
            return np.sort(np.concatenate(out))
        at, low, high = at[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        by = np.lexsort((low, high))
        by = by[np.append(True, high[by][1:] != high[by][:-1])]
        out.append(at[by])
        root[high[by]] = low[by]
        while (root != (up := root[root])).any():
            root = up
