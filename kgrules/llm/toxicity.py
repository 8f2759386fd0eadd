"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier.

Fitting uses a bounded sample of labelled rows of the learning folds (``MOST`` of each label, those of the smallest hash).
1. Terms - words, words with look-alike signs undone, and word beginnings - whose share among the toxic documents
   of the sample stands out make the lexicons (``TERMS`` at most). Documents are in two halves: a half is voted on by the
   lexicons of the other, so no vote on a document comes from its own label.
2. Voters: the lexicons' terms are dealt into ``LEXICONS`` small lexicons of words and as many of beginnings; each votes toxic if one
   of its terms occurs. Patterns vote too: several hits, dense hits, look-alike signs, no hit at all (clean).
   The annotator's label is one more voter.
3. The label model has a latent label and, given it, each voter's rate of each vote, the annotator's too. Expectation
   maximisation estimates the rates, starting from the annotator's labels at a trust of 0.98; from the posterior the
   correlations that remain between voters given the label are estimated, and each voter's evidence is divided by the
   sum of its correlations, so voters that repeat each other count once.
4. A logistic regression on the terms and votes of the lexicons of the whole sample is fitted to the posterior labels.
Scoring is one pass over whole texts. Labels, lang, source and doc_id are no input of a score.

Cases: a null text counts as empty; an empty text gets the score of a text without any term. Rows are independent of their
ids, so null ids (held out by the remainder of '') and repeated ids give a row each. Labels of unknown or null documents
are unused; a document with several labels is learned once for each. Without labels of both kinds every score is 0.
Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remainder, slices, text_or_empty

MOST, TERMS, LEXICONS, PREFIXES = 6000, 2000, 8, (4, 5)
COUNTS = ("a0", "b0", "a1", "b1")
#: Runs whose terms a scorer remembers, and terms that a partition counts before it passes them on.
KNOWN = 1 << 16
WORD = re.compile(r"\w+")
# Words with the look-alike signs in and beside them; no match of WORD or SIGNS goes beyond one.
RUN, SIGN = re.compile(r"[\w@$!|]+"), re.compile(r"[@$!|\d]")
SIGNS = re.compile(r"\w*[^\W\d_][\w@$!|]*[@$!|\d][\w@$!|]*[^\W\d_]\w*")
# Look-alike signs and the letters that they stand for.
UNDO = str.maketrans("013457@$!|", "oieastasil")


def terms(text: str) -> set[str]:
    """Distinct words; of longer words the beginnings, marked "^"; and words whose look-alike signs are undone, marked "~"."""
    out: set[str] = set()
    for run in set(RUN.findall(text.lower())):
        words = WORD.findall(run)
        out.update(words)
        out.update(f"^{w[:n]}" for w in words for n in PREFIXES if len(w) > n)
        if SIGN.search(run):
            out.update(f"~{w.translate(UNDO)}" for w in SIGNS.findall(run))
    return out


@dataclass
class Model:
    """``slot``: position of each term; ``voter``: the lexicon that it belongs to; weights of terms, then of votes, then the bias."""

    slot: dict[str, int]
    voter: np.ndarray
    weights: np.ndarray
    known: dict[str, tuple[tuple[int, ...], bool]] = field(default_factory=dict)

    def _of(self, run: str) -> tuple[tuple[int, ...], bool]:
        """Terms of a run of word characters and signs; whether a sign stands for a letter in it."""
        if (got := self.known.get(run)) is None:
            signed = SIGNS.findall(run) if SIGN.search(run) else []
            words = [*WORD.findall(run), *(w.translate(UNDO) for w in signed)]
            names = [*words, *(f"^{w[:n]}" for w in words for n in PREFIXES if len(w) > n)]
            got = tuple({self.slot[x] for x in names if x in self.slot}), bool(signed)
            if len(run) <= 64:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[run] = got
        return got

    def hits(self, text: str) -> tuple[list[int], bool]:
        """Terms of the text, and whether it has look-alike signs."""
        found, signed = set(), False
        for slots, sign in map(self._of, set(RUN.findall(text.lower()))):
            found.update(slots)
            signed |= sign
        return sorted(found), signed

    def votes(self, text: str, hits: list[int], signed: bool) -> np.ndarray:
        """1 toxic, -1 clean, 0 none; lexicons first, then the patterns."""
        v = np.zeros(self.voters, np.int8)
        v[self.voter[hits]] = 1
        n = len(hits)
        if not n:
            v[-4] = -1
        else:
            v[-3] = n >= 3
            v[-2] = n * 400 >= len(text)
            v[-1] = signed
        return v

    @property
    def voters(self) -> int:
        return 2 * LEXICONS + 4

    def score(self, text: str) -> float:
        hits, signed = self.hits(text)
        z = self.weights[-1] + self.weights[hits].sum() + self.weights[len(self.slot) : -1] @ self.votes(text, hits, signed)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def label_model(votes: np.ndarray, gold: np.ndarray, trust: float = 0.98, weight: float = 0.1, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of the label 1 for each row, accuracy of each voter where it votes, correlations given the label).

    The annotator, whose labels are ``gold``, is the last voter. ``trust`` is what its accuracy starts from, and counts in the
    estimate like ``weight`` times the rows. It reads texts by itself, so its evidence isn't divided.
    """
    votes = np.column_stack([votes, np.where(gold == 1, 1, -1)])
    n, m = votes.shape
    kinds = np.stack([votes == k for k in (-1, 0, 1)]).astype(float)
    post = np.where(gold == 1, trust, 1 - trust)
    rates = np.empty((2, 3, m))
    for _ in range(rounds):
        for y, w in enumerate((1 - post, post)):
            rates[y] = (np.einsum("n,knm->km", w, kinds) + 0.5) / (w.sum() + 1.5)
            more = weight * w.sum() * np.array([1 - trust, 0, trust] if y else [trust, 0, 1 - trust])
            rates[y, :, -1] = (w @ kinds[:, :, -1].T + 0.5 + more) / (w.sum() + 1.5 + more.sum())
        prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        evidence = np.einsum("knm,km->nm", kinds, np.log(rates[1]) - np.log(rates[0]))
        # correlations that remain given the label
        expected = np.outer(1 - post, rates[0, 2] - rates[0, 0]) + np.outer(post, rates[1, 2] - rates[1, 0])
        rest = votes - expected
        cov = rest.T @ rest / n + 1e-9 * np.eye(m)
        d = np.sqrt(np.diag(cov))
        corr = cov / np.outer(d, d)
        share = np.append(1 / np.clip(np.abs(corr[:-1, :-1]), 0, 1).sum(axis=1), 1)
        z = np.log(prior / (1 - prior)) + evidence @ share
        post = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    right = (kinds[2] * post[:, None] + kinds[0] * (1 - post[:, None])).sum(0) / np.maximum(kinds[2].sum(0) + kinds[0].sum(0), 1)
    return post, right, corr


def logistic(rows: list[np.ndarray], width: int, y: np.ndarray, l2: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Weights of a logistic regression on sparse rows of (index, value) with a bias at the end; Adam, full gradient."""
    size = np.array([r.shape[1] for r in rows])
    flat = np.concatenate(rows, axis=1) if rows else np.empty((2, 0))
    at, value, row = flat[0].astype(np.int64), flat[1], np.repeat(np.arange(len(rows)), size)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(np.clip(y.mean(), 1e-4, 1 - 1e-4) / (1 - np.clip(y.mean(), 1e-4, 1 - 1e-4)))
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[at], len(rows)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
        grad = np.append(np.bincount(at, value * g[row], width), g.sum()) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic and clean documents of each half)."""
    seen = [Counter() for _ in range(4)]

    def flush() -> pa.RecordBatch:
        names = list(dict.fromkeys(w for c in seen for w in c))
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in seen)], ["term", *COUNTS])
        for c in seen:
            c.clear()
        return out

    for x in slices(batches):
        for t, y, half in zip(x.column("text").to_pylist(), x.column("toxic").to_pylist(), x.column("half").to_pylist(), strict=True):
            seen[2 * half + (not y)].update(terms(t))
        if sum(map(len, seen)) > KNOWN:
            yield flush()
    yield flush()


def lexicon(names: list[str]) -> Model:
    """A model without weights whose terms are dealt into the lexicons in their order."""
    slot = {w: i for i, w in enumerate(dict.fromkeys(w.removeprefix("~") for w in names))}
    voter, dealt = np.empty(len(slot), np.int64), [0, 0]
    for w, i in slot.items():
        side = w[0] == "^"
        voter[i] = side * LEXICONS + dealt[side] % LEXICONS
        dealt[side] += 1
    return Model(slot, voter, np.zeros(len(slot) + 2 * LEXICONS + 5))


def chosen(counts: DataFrame, a: Column, b: Column, n1: int, n0: int) -> list[str]:
    """The terms that stand out, the most significant first. ``a``, ``b``: toxic and clean documents with the term."""
    ratio = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    z = ratio / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    best = counts.where(a >= 3).select("term", z.alias("z"), ratio.alias("ratio")).where("z >= 3 and ratio >= 2.3")
    return [r.term for r in best.orderBy(F.desc("z"), "term").limit(TERMS).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The fitted model, or None without labels of both kinds. ``labels``: (doc_id, toxic) of learning rows."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(MOST).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(2 * MOST))
    picked = picked.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2)).cast("int"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    # bounded: 3 * MOST rows
    sample = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id"))
    size = {(r.toxic, r.half): r["count"] for r in picked.groupBy("toxic", "half").count().collect()}
    n1, n0 = (sum(size.get((y, h), 0) for h in (0, 1)) for y in (1, 0))
    if not n1 or not n0:
        return None
    counts = sample.select("text", "toxic", "half").mapInArrow(_counted, "term string, a0 long, b0 long, a1 long, b1 long")
    counts = scratch.keep(counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in COUNTS)).where("a0 + a1 >= 3"))
    model = lexicon(chosen(counts, F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1"), n1, n0))
    # a half's voters: the lexicons of the other half
    other = [lexicon(chosen(counts, F.col(f"a{1 - h}"), F.col(f"b{1 - h}"), size.get((1, 1 - h), 0), size.get((0, 1 - h), 0))) for h in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast((model, *other))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, *halves = shared.value
        for x in slices(batches):
            rows: list[tuple] = []
            for t, half in zip(x.column("text").to_pylist(), x.column("half").to_pylist(), strict=True):
                hits, signed = full.hits(t)
                rows.append((hits, full.votes(t, hits, signed).tolist(), halves[half].votes(t, *halves[half].hits(t)).tolist()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("toxic"), x.column("half"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "toxic", "half", "hits", "votes", "crossed"])
        for m in shared.value:
            m.known.clear()

    rows = sample.select("doc_id", "toxic", "half", "text").mapInArrow(voted, "doc_id long, toxic int, half int, hits array<int>, votes array<tinyint>, crossed array<tinyint>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.toxic, r.hits))
    votes, gold, half = np.array([r.votes for r in rows], np.int8), np.array([r.toxic for r in rows]), np.array([r.half for r in rows])
    post = gold.astype(float)
    for h in (0, 1):
        own = np.flatnonzero(half == h)
        if len(own):
            post[own] = label_model(np.array([rows[i].crossed for i in own], np.int8), gold[own])[0]
    sparse = []
    for r, v in zip(rows, votes, strict=True):
        on = np.flatnonzero(v)
        sparse.append(np.array([[*r.hits, *(len(model.slot) + on)], [*[1.0] * len(r.hits), *v[on]]]))
    model.weights = logistic(sparse, len(model.slot) + model.voters, post)
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learns from labels whose remainder modulo 5 isn't 0."""
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    held = (remainder("doc_id", 5) == 0).alias("held_out")
    if model is None:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            s = np.array([shared.value.score(t) for t in x.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, text_or_empty().alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    if model is None:
        return docs
    shared, k = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            yield x.filter(pa.array([shared.value.score(t or "") < 0.5 for t in x.column(k).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
