"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes the document's score.

A sentence's probability is a logistic function of the weights of its words and their stems (first 4 to 6 letters, for
words that the sample lacks); a document is toxic with probability
1 - product(1 - p). Only documents carry labels, so the gradient of the document's log loss reaches each sentence in
proportion to its share in the noisy-or, and the sentences that explain the label are found without sentence labels.

Training uses at most ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` labelled rows whose crc32 remainder is not the held-out one,
first by digests of id and text, and at most ``MAX_CHARS`` characters of them; classes are weighted back to their true share,
which is counted over all labelled rows. Scoring reads every whole text once: bytes are folded by a table, split into
sentences and words, and summed.

Edge cases: null and empty texts score 0; null doc_id has no label and is not held out; rows of labels with a null label
or repeated ids are taken once, with the largest label; documents that repeat an id with another text all have its label;
repeated rows get equal results and train once; without labelled rows of both classes all scores are 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import map_arrow, text_slices

MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 3000, 5000, 48_000_000
#: Words enter the model by a two-proportion z score over documents, so that the thousands of rare ones can't be learnt by heart.
MIN_DOCS, MIN_Z, EPOCHS, L2 = 3, 4.0, 300, 1e-5
THRESHOLD, FOLDS, HELD = 0.7, 3, 1

#: Lower case; ends of sentences to \n; other ASCII punctuation and controls to spaces.
FOLD = bytes(10 if chr(c) in "\n.!?" else (c + 32 if 65 <= c <= 90 else (c if c >= 128 or chr(c).isalnum() else 32)) for c in range(256))


def sentences(text: bytes) -> list[list[bytes]]:
    return [w for s in text.translate(FOLD).split(b"\n") if (w := s.split())]


STEMS = (4, 5, 6)


def features(word: bytes) -> list[bytes]:
    """A word's own feature and one for each of its stems."""
    letters = word.decode("utf-8", "replace")
    return [word, *(letters[:n].encode() + b"-" for n in STEMS if len(letters) > n)]


def held_out(folds: int = FOLDS, held: int = HELD) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: dict[int, int], chars: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Labelled texts outside the held-out fold, bounded by class and in characters, and the count of each class.

    Rows are chosen by their lengths alone, first by a digest of the id, then of the text; only chosen texts are fetched.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds, held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where("y in (0, 1)")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")))
    pick = None
    for y, n in most.items():
        part = known.where(F.col("y") == y).withColumn("o", order).orderBy("o").limit(n)
        pick = part if pick is None else pick.union(part)
    pick = F.broadcast(pick.select(F.col("doc_id").alias("id"), "y", "o"))  # at most sum(most) rows of three columns
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("t", F.md5("text")).join(pick, F.col("doc_id") == F.col("id"))
    chosen, left = {}, chars
    # repeated rows count once
    for r in rows.groupBy("o", "t").agg(F.max(F.length("text")).alias("n")).orderBy("o", "t").limit(sum(most.values())).collect():
        left -= r["n"]
        if left < 0 and chosen:
            break
        chosen[(r["o"], r["t"])] = None
    if not chosen:
        return [], counts
    want = F.broadcast(docs.sparkSession.createDataFrame(list(chosen), "o1 string, t1 string"))
    got = rows.join(want, (F.col("o") == F.col("o1")) & (F.col("t") == F.col("t1"))).groupBy("o", "t").agg(F.first("text").alias("text"), F.first("y").alias("y"))
    for r in got.toLocalIterator():
        chosen[(r["o"], r["t"])] = (r["text"], r["y"])
    return [x for x in chosen.values() if x], counts


def train(rows: list[tuple[str, int]], counts: dict[int, int]) -> tuple[dict[bytes, float], float]:
    """Word weights (without zeros) and bias."""
    docs = [sentences(t.encode()) for t, _ in rows]
    y = np.array([v for _, v in rows], float)
    if not docs or y.min(initial=1) == y.max(initial=0):
        return {}, -1000.0
    df = {1: Counter(), 0: Counter()}
    for d, v in zip(docs, y):
        df[int(v)].update({x for w in {w for s in d for w in s} for x in features(w)})
    n1, n0 = int(y.sum()), int((1 - y).sum())

    def z(w: bytes) -> float:
        a, b = df[1][w], df[0][w]
        p = (a + b) / (n1 + n0)
        return (a / n1 - b / n0) / max(1e-9, (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5)

    vocab = {w: i for i, w in enumerate(sorted(w for w in df[1] if df[1][w] >= MIN_DOCS and z(w) >= MIN_Z))}
    idx, sent, of = [], [], []
    k = 0
    for d, ss in enumerate(docs):
        for s in ss:
            got = [vocab[x] for w in s for x in features(w) if x in vocab]
            idx.extend(got)
            sent.extend([k] * len(got))
            of.append(d)
            k += 1
    idx, sent, of = np.array(idx, np.int64), np.array(sent, np.int64), np.array(of, np.int64)
    have = {0: max(1, int((y == 0).sum())), 1: max(1, int((y == 1).sum()))}
    weight = np.where(y == 1, counts.get(1, 1) / have[1], counts.get(0, 1) / have[0])
    weight /= weight.mean()
    n, dims = len(docs), len(vocab)
    w, b = np.zeros(dims), -5.0
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = np.bincount(sent, w[idx], minlength=k) + b
        # log(1 - p) of a sentence, and of its document
        lq = -np.logaddexp(0, z)
        log_none = np.bincount(of, lq, minlength=n)
        some = np.maximum(-np.expm1(log_none), 1e-12)
        # d loss / d log_none
        g = weight * np.where(y == 1, np.exp(log_none) / some, -1.0) / n
        gz = -g[of] / (1 + np.exp(-z))
        gw = np.bincount(idx, gz[sent], minlength=dims) + L2 * w
        gb = gz.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        rate = 0.15 if step < EPOCHS * 2 // 3 else 0.03
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return {x: float(w[i]) for x, i in vocab.items() if w[i] != 0}, float(b)


class _Weights(dict):
    """Sums of weights by word, kept as words are met."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        x = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return x


def _score(weights: dict[bytes, float], bias: float, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _Weights(weights).__getitem__
        for t in text_slices(batches):
            raw = t.data.tobytes().translate(FOLD)
            score, worst, where = [], [], []
            for d in range(len(t.off) - 1):
                zs = [sum(map(get, s.split())) for s in raw[t.off[d] : t.off[d + 1]].split(b"\n") if s and not s.isspace()]
                if zs:
                    z = np.array(zs) + bias
                    score.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                    k = int(z.argmax())
                    worst.append(float(1 / (1 + np.exp(-z[k]))))
                    where.append(k)
                else:
                    score.append(0.0)
                    worst.append(None)
                    where.append(None)
            got = np.clip(np.array(score), 0, 1)
            yield pa.RecordBatch.from_arrays([t.rows.column(0), t.rows.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32)), pa.array(where, pa.int32()), pa.array(worst, pa.float64())], ["doc_id", "held_out", "score", "predicted", "worst_sentence", "worst_score"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the number (among those with a word) and probability of the worst sentence."""
    rows, counts = sample(docs, labels, "toxic", FOLDS, HELD, {1: MAX_POSITIVE, 0: MAX_NEGATIVE}, MAX_CHARS)
    weights, bias = train(rows, counts)
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_arrow(slim, _score(weights, bias, threshold), "doc_id long, held_out boolean, score double, predicted int, worst_sentence int, worst_score double")
