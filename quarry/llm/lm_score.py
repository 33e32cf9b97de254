"""Masked pseudo-likelihood of texts under a bidirectional window network, trained and run in numpy.

Words (letters and digits, A-Z lower-cased) become symbols: the TOP commonest of the corpus each their own, the others by
hash into buckets; the count of every word of every document decides which are common. The network predicts each
symbol from SIDE symbols on its left and as many on its right: a table per position, their sum through tanh, and a softmax.
The softmax is factored by classes: a word's probability is that of its symbol, times the word's share of all that the
corpus holds in that bucket, so the vocabulary is every word of the corpus and grows with it. A document's score is the sum
over its words of log p(symbol | both sides) + log p(word | symbol); texts that read like the corpus score higher per word.

Shares of words that make up at least SHARE of the corpus (at most 1 / SHARE words) go to all executors; the others come by
a join with the counts, where no word is frequent enough to load one task. They are added up in fixed point.

Training: documents are dealt by a digest of id and text to shards of about SHARD words, whatever the partitions of the input,
and stand there in the order of the digest. All shards start from one model and train over all their words, slice after slice
of text at a falling rate; their models are averaged by their words. Models are added up FAN at a time, in the order of the
shards, so reruns agree and neither a task nor the driver holds more than FAN of them.

Edge cases: null and empty texts have no words, log_prob 0 and null mean; repeated rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import Alphabet, map_arrow, stage, text_slices, unstage, words

TOP, BUCKETS, SIDE, HIDDEN = 96, 31, 2, 16
SYMBOLS = 1 + TOP + BUCKETS  # 0 stands beyond the text's ends
SHARE = 1e-6
SHARD, FAN = 2_000_000, 64
BATCH, RATE = 1024, 0.01
_ABC = Alphabet(fold=True, punctuation=True)
_FIX = float(1 << 24)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): words of the partition by hash."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, inv = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inv, np.concatenate([n for _, n in held])).astype(np.int64)

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    for t in text_slices(batches):
        w = words(t.data, t.off, _ABC)
        if len(w.hash):
            held.append(np.unique(w.hash, return_counts=True))
        if len(held) >= 16:
            held = [merged()]
            if len(held[0][0]) > 3_000_000:
                yield out(*held[0])
                held = []
    if held:
        yield out(*merged())


class Vocabulary(NamedTuple):
    top: np.ndarray  # hashes of the TOP commonest words, ascending
    known: np.ndarray  # hashes of the other words of at least SHARE, ascending
    inside: np.ndarray  # log share of each of these in its bucket, in fixed point
    totals: np.ndarray  # words of the corpus in each bucket
    least: int  # count from which on words are known
    words: int  # of the corpus


def count_words(docs: DataFrame) -> DataFrame:
    """(key, n): every word of all documents by hash, staged."""
    return stage(map_arrow(docs.select("text"), _count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm_counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    first = counts.orderBy(F.desc("n"), "key").limit(TOP).collect()
    top = np.sort(np.array([r["key"] % (1 << 64) for r in first], np.uint64))
    words_ = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(SHARE * words_))
    common = counts.where(F.col("n") >= least).toArrow()
    key, n = common["key"].to_numpy().view(np.uint64), common["n"].to_numpy()
    totals = np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy(_bucket().alias("b")).agg(F.sum("n").alias("n")).collect():
        totals[r["b"]] = r["n"]
    for r in first:
        totals[(r["key"] % (1 << 64) >> 40) % BUCKETS] -= r["n"]
    bucket = ((key >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
    own = np.isin(key, top)
    order = np.flatnonzero(~own)[np.argsort(key[~own])]
    inside = np.round(np.log(n[order] / totals[bucket[order]]) * _FIX).astype(np.int64)
    return Vocabulary(top, key[order], inside, totals, least, words_)


def _bucket() -> F.Column:
    return F.shiftrightunsigned("key", 40) % BUCKETS


def symbols(h: np.ndarray, top: np.ndarray) -> np.ndarray:
    out = (1 + TOP + (h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
    if len(top):
        at = np.minimum(np.searchsorted(top, h), len(top) - 1)
        out = np.where(top[at] == h, 1 + at, out)
    return out


def windows(data: np.ndarray, off: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets, contexts (words x 2 * SIDE), row and hash of each word."""
    w = words(data, off, _ABC)
    s, n = symbols(w.hash, top), len(w.hash)
    context = np.zeros((n, 2 * SIDE), np.int64)
    for k in range(1, SIDE + 1):
        if n > k:
            same = w.doc[k:] == w.doc[:-k]
            context[k:, SIDE - k] = np.where(same, s[:-k], 0)
            context[:-k, SIDE + k - 1] = np.where(same, s[k:], 0)
    return s, context, w.doc, w.hash


class Network:
    """Parameters as one flat vector: position tables, hidden bias, output weights, output bias."""

    SHAPES = ((2 * SIDE, SYMBOLS, HIDDEN), (HIDDEN,), (HIDDEN, SYMBOLS), (SYMBOLS,))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray | None = None, seed: int = 0):
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.2, self.SIZE)
            flat[-SYMBOLS:] = 0
        self.flat = flat.astype(np.float32)
        self.parts, i = [], 0
        for s in self.SHAPES:
            n = int(np.prod(s))
            self.parts.append(self.flat[i : i + n].reshape(s))
            i += n
        self.moments: list[np.ndarray] | None = None
        self.steps = 0

    def hidden(self, context: np.ndarray) -> np.ndarray:
        tables, bias = self.parts[0], self.parts[1]
        pre = tables[0][context[:, 0]] + bias
        for k in range(1, 2 * SIDE):
            pre += tables[k][context[:, k]]
        return np.tanh(pre, out=pre)

    def softmax(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials and their sums; |logits| stay small, as weights are clipped."""
        z = h @ self.parts[2]
        z += self.parts[3]
        np.exp(z, out=z)
        return z, z.sum(axis=1)

    def log_probs(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        for i in range(0, len(target), 8192):
            z, total = self.softmax(self.hidden(context[i : i + 8192]))
            out[i : i + 8192] = np.log(z[np.arange(len(z)), target[i : i + 8192]]) - np.log(total)
        return out

    def step(self, target: np.ndarray, context: np.ndarray, rate: float) -> None:
        n = len(target)
        h = self.hidden(context)
        z, total = self.softmax(h)
        z *= (1 / (n * total))[:, None]
        z[np.arange(n), target] -= np.float32(1 / n)
        pre = (z @ self.parts[2].T) * (1 - h * h)
        grads = np.empty_like(self.flat)
        i = 0
        each = np.arange(HIDDEN)
        for k in range(2 * SIDE):
            m = SYMBOLS * HIDDEN
            grads[i : i + m] = np.bincount((context[:, k, None] * HIDDEN + each).ravel(), pre.ravel(), minlength=m)
            i += m
        for g in (pre.sum(axis=0), h.T @ z, np.ones(n, np.float32) @ z):
            grads[i : i + g.size] = g.ravel()
            i += g.size
        if self.moments is None:
            self.moments = [np.zeros_like(self.flat), np.zeros_like(self.flat)]
        self.steps += 1
        m, v = self.moments
        m += 0.1 * (grads - m)
        v += 0.001 * (grads * grads - v)
        self.flat -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        np.clip(self.flat, -4, 4, out=self.flat)

    def train(self, target: np.ndarray, context: np.ndarray, batch: int, rate: float) -> None:
        """All words, in batches of nearly equal size."""
        cuts = np.linspace(0, len(target), max(1, round(len(target) / batch)) + 1).astype(int)
        for i, j in zip(cuts[:-1], cuts[1:]):
            self.step(target[i:j], context[i:j], rate)


def _tune(flat: np.ndarray, top: np.ndarray):
    """(s, n, w) of the partition: its number, its words, and the parameters times the words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total = Network(flat.copy()), 0
        for k, t in enumerate(text_slices(batches)):
            target, context, *_ = windows(t.data, t.off, top)
            if len(target):
                # words of one text follow each other; a batch takes from all of the slice
                order = np.random.default_rng(len(target)).permutation(len(target))
                net.train(target[order], context[order], BATCH, RATE / (1 + k))
                total += len(target)
        if total:
            yield _model(TaskContext.get().partitionId(), total, net.flat.astype(float) * total)

    return run


def _model(s: int, n: int, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["s", "n", "w"])


def _sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of runs of (g, s, n, w) with equal g."""
    held = None
    for batch in batches:
        for g, _, n, w in zip(*(c.to_pylist() for c in batch.columns)):
            mine = np.frombuffer(w)
            if held is not None and held[0] != g:
                yield _model(*held)
                held = None
            held = (g, n, mine) if held is None else (g, held[1] + n, held[2] + mine)
    if held is not None:
        yield _model(*held)


def _averaged(models: DataFrame) -> np.ndarray | None:
    """models(s, n, w): the mean of the parameters by words, added up FAN at a time in the order of s."""
    models = stage(models, "lm_models")
    while models.count() > FAN:
        groups = models.select(F.floor(F.col("s") / FAN).alias("g"), "s", "n", "w")
        some = groups.repartition("g").sortWithinPartitions("g", "s")
        old, models = models, stage(map_arrow(some, _sum, "s long, n long, w binary"), "lm_models")
        unstage(old)
    rows = sorted(models.collect(), key=lambda r: r["s"])  # at most FAN models
    unstage(models)
    if not rows:
        return None
    return (sum(np.frombuffer(r["w"]) for r in rows) / sum(r["n"] for r in rows)).astype(np.float32)


def train(docs: DataFrame, top: np.ndarray, total: int) -> np.ndarray:
    """Parameters from all documents, which hold ``total`` words; none is left out."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5("text")))
    dealt = docs.where("text is not null").select(digest.alias("o"), "text")
    every = dealt.repartition(max(1, math.ceil(total / SHARD)), "o").sortWithinPartitions("o").select("text")
    got = _averaged(map_arrow(every, _tune(Network().flat, top), "s long, n long, w binary"))
    return Network().flat if got is None else got


def _score(v: Vocabulary, flat: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat.copy())
        for t in text_slices(batches):
            target, context, doc, h = windows(t.data, t.off, v.top)
            docs = len(t.off) - 1
            n = np.bincount(doc, minlength=docs) if len(doc) else np.zeros(docs, np.int64)
            total = np.bincount(doc, net.log_probs(target, context), minlength=docs) if len(doc) else np.zeros(docs)
            # words in buckets: those known here, and those that the join brings
            other = np.flatnonzero(target > TOP)
            at = np.minimum(np.searchsorted(v.known, h[other]), max(len(v.known) - 1, 0))
            here = v.known[at] == h[other] if len(v.known) else np.zeros(len(other), bool)
            inside = np.zeros(docs, np.int64)
            np.add.at(inside, doc[other[here]], v.inside[at[here]])
            rare = other[~here]
            off = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=docs))]) if len(rare) else np.zeros(docs + 1)
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h[rare].view(np.int64)))
            yield pa.RecordBatch.from_arrays([t.rows.column(0), pa.array(n.astype(np.int64)), pa.array(total), pa.array(inside), lists], ["doc_id", "n_words", "total", "inside", "rare"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob for every row of docs."""
    counts = count_words(docs)
    v = vocabulary(counts)
    flat = train(docs, v.top, v.words)
    scored = map_arrow(docs.select("doc_id", "text"), _score(v, flat), "doc_id long, n_words long, total double, inside long, rare array<long>")
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()), "lm_scored")
    totals = F.element_at(F.array(*[F.lit(int(x)) for x in v.totals]), (_bucket() + 1).cast("int"))
    shares = counts.where(F.col("n") < v.least).select("key", F.round(F.log(F.col("n") / totals) * _FIX).cast("long").alias("share"))
    rest = scored.select("row", F.explode("rare").alias("key")).join(shares, "key").groupBy("row").agg(F.sum("share").alias("rest"))
    total = F.col("total") + (F.col("inside") + F.coalesce("rest", F.lit(0))) / F.lit(_FIX)
    out = scored.drop("rare").join(rest, "row", "left").select("doc_id", "n_words", (F.round(total, 3) + 0.0).alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.round(F.col("log_prob") / F.col("n_words"), 5)))
