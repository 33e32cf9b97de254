"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words (hashed), the shapes of its words and of neighbouring words (runs of small and capital letters,
digits, punctuation, symbols; hashed), how many words equal the one 1 to ``LAGS`` places before, and how many belong to
words that occur once, 2 to 3, 4 to 7, ... times; each by the square root of its count. The terms of a bounded sample of
labelled rows (at most ``MAX_ROWS``, first by digest of the id, at most ``MAX_CHARS`` characters; never from the held-out
fold) are weighted by inverse document frequency and factored (truncated SVD) into ``DIMS`` latent dimensions. The labelled
vectors, at most MAX_ROWS * DIMS floats, go to every executor. Each document's vector is multiplied with all of them in
blocks; the exact ``NEIGHBOURS`` nearest by cosine vote with similarity ** POWER as weight, classes weighted to their share
over all labelled rows. Terms were chosen by four folds of the rows that aren't held out.

Edge cases: texts without words, null and empty ones have the zero vector and score the labelled share of 1; null doc_id has
no label and is not held out; rows of labels with null or repeated ids count once, with the largest label; documents that
repeat an id with another text all have its label; repeated rows get equal results and train once; without labels all scores
are 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._common import Alphabet, map_arrow, mix64, text_slices, words
from quarry.llm.toxicity import held_out, sample

MAX_ROWS, MAX_CHARS = {0: 1500, 1: 2500}, 24_000_000
DIMS, NEIGHBOURS, POWER, BLOCK = 48, 25, 4, 512
THRESHOLD, FOLDS, HELD = 0.3, 5, 0
WORDS, SHAPES, LAGS, OCTAVES = 2048, 256, 8, 12
TERMS = WORDS + 2 * SHAPES + LAGS + OCTAVES

_RAW = Alphabet()
#: Kinds of characters by their bytes: small letters (with all beyond ASCII), capitals, digits, punctuation, symbols.
_KIND = np.full(256, 4, np.int64)
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[128:] = 0
_KIND[list(b".,;:'\"-()!?")] = 3


def _hashed(x: np.ndarray, n: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n


def terms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Dense term matrix of a run of texts, float32."""
    docs = len(off) - 1
    w = words(data, off, _RAW)
    h, doc, n = w.hash, w.doc, len(w.hash)
    if not n:
        return np.zeros((docs, TERMS), np.float32)
    # a shape is the kinds of a word's runs of characters, the first seven each by its place
    kind = _KIND[data]
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    run = np.cumsum(inside[:-1]) > 0
    run[1:] &= kind[1:] != kind[:-1]
    run[w.start] = True
    at = np.flatnonzero(run)
    of = np.searchsorted(w.start, at, "right") - 1
    nth = np.minimum(np.arange(len(at)) - np.searchsorted(at, w.start)[of], 6)
    shape = np.bincount(of, (kind[at] + 1) * 7.0**nth, minlength=n).astype(np.uint64)
    _, first, times = np.unique(h ^ mix64(doc.astype(np.uint64)), return_index=True, return_counts=True)
    after = np.flatnonzero(doc[1:] == doc[:-1])
    found = [
        (doc, (h >> np.uint64(20)).astype(np.int64) % WORDS),
        (doc, WORDS + _hashed(shape + np.uint64(1), SHAPES)),
        (doc[after], WORDS + SHAPES + _hashed(shape[after + 1] * np.uint64(1_000_003) + shape[after], SHAPES)),
    ]
    for k in range(1, min(LAGS, n - 1) + 1):
        same = np.flatnonzero((h[k:] == h[:-k]) & (doc[k:] == doc[:-k]))
        found.append((doc[same], np.full(len(same), WORDS + 2 * SHAPES + k - 1)))
    octave = np.minimum(np.log2(times).astype(np.int64), OCTAVES - 1)
    found.append((np.repeat(doc[first], times), np.repeat(TERMS - OCTAVES + octave, times)))
    code = np.concatenate([d * TERMS + x for d, x in found])
    return np.sqrt(np.bincount(code, minlength=docs * TERMS)).astype(np.float32).reshape(docs, TERMS)


class Model:
    def __init__(self, rows: list[tuple[str, int]], counts: dict[int, int]):
        total = sum(counts.values())
        self.prior = counts.get(1, 0) / total if total else 0.5
        y = np.array([v for _, v in rows], float)
        self.labels = y
        if len(rows) < 2:
            self.basis = None
            return
        raw = [t.encode() for t, _ in rows]
        off = np.cumsum([0, *map(len, raw)])
        x = np.concatenate([terms(np.frombuffer(b"".join(raw[i : i + 200]), np.uint8), off[i : i + 201] - off[i]) for i in range(0, len(raw), 200)])
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.2).astype(np.float32)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        # truncated SVD by the eigenvectors of the smaller side, after a seeded range finder
        g = np.random.default_rng(3).standard_normal((TERMS, min(DIMS + 16, len(x)))).astype(np.float32)
        q = np.linalg.qr(x @ g)[0]
        for _ in range(3):
            q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
        _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
        self.basis = np.ascontiguousarray(vt[:DIMS].T.astype(np.float32))
        self.vectors = self._unit(x @ self.basis)
        have = {c: max(1, int((y == c).sum())) for c in (0, 1)}
        self.weights = np.where(y == 1, counts.get(1, 0) / have[1], counts.get(0, 0) / have[0]).astype(np.float32)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def nearest(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text whether it has words, its nearest labelled rows, in no order, and their cosines."""
        x = terms(data, off)
        sim = self._unit((x * self.idf) @ self.basis) @ self.vectors.T
        k = min(NEIGHBOURS, sim.shape[1])
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        return x.any(axis=1), top, np.take_along_axis(sim, top, 1)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        docs = len(off) - 1
        out = np.full(docs, self.prior)
        if self.basis is None:
            return out
        for i in range(0, docs, BLOCK):
            j = min(i + BLOCK, docs)
            some, top, sim = self.nearest(data[off[i] : off[j]], off[i : j + 1] - off[i])
            s = np.clip(sim, 0, 1) ** POWER * self.weights[top]
            share = (s * self.labels[top]).sum(axis=1) / np.maximum(s.sum(axis=1), 1e-12)
            out[i:j] = np.where(some & (s.sum(axis=1) > 0), share, self.prior)
        return np.clip(out, 0, 1)


def _score(model: Model, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            s = model.score(t.data, t.off)
            yield pa.RecordBatch.from_arrays([t.rows.column(0), t.rows.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = Model(*sample(docs, labels, "quality", FOLDS, HELD, MAX_ROWS, MAX_CHARS))
    slim = docs.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), "text")
    return map_arrow(slim, _score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
