"""Benchmark decontamination by edit distance over words, found by CGK embeddings and bit-sampling LSH.

Texts and items are words: letters and digits, A-Z lower-cased, without ASCII punctuation. A document is contaminated by
an item of L words if some passage of it is within floor(MAX_SHARE * L) word edits of the item.

Every window of an item's size, at every word of every text, is a candidate, unless exact bounds rule it out: k edits leave
all but k of an item's words, and all but k of the different rare ones among them (those that few items have). So a window
is only looked up where that many rare words of one item lie close enough, and where enough of its words occur in any item;
running sums over all words tell both, and no match is lost. The rest are embedded by CGK random walks: at step j the walk emits the word it stands on and moves on if a random
bit of (walk, j, word) says so, which turns edit distance into Hamming distance. Each table samples one position of an
embedding (the first DENSE positions of a walk, half of the others); an item is in those that lie within twice its size.
Windows that meet an item in a table are verified exactly by bit-parallel
dynamic programming over the passage with its margins.

Agreement falls as items grow and by the kind of edits, so it is measured for each item size at the most edits allowed
(`walks`: words changed, dropped and added, scattered and in one block), and the size gets as many walks as reach the target
recall for the worst kind. Where even the most walks miss it (items of some 60 words and more), every passage that passes the
exact bounds is verified instead.

The benchmark is taken in blocks of at most BLOCK_CHARS characters (or one longer item); each block goes to the executors and
is run against all documents before the next is read, so any benchmark size works.

Edge cases: null texts and null items count as empty; items without words are skipped; those of fewer than 1 / MAX_SHARE words
are found where they occur word for word (a script without spaces is one word from one ASCII separator to the next);
repeated rows are scored each; items with equal ids are told apart by text and reported once, with the least distance; an
empty benchmark or table gives an empty result; other columns are ignored (``drop``: pass through).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import Alphabet, Texts, map_arrow, mix64, stage, text_slices, unstage, words

MAX_SHARE = 0.2
TARGET_RECALL, DENSE, WALKS = 0.999, 16, (8, 16, 32, 64)
#: Items of more words aren't measured: long before, the most walks miss the target.
MEASURED = 512
BLOCK_CHARS = 2_000_000
RARE, LEAST_KEPT, CHUNK = 0.02, 3, 2048
_ABC = Alphabet(fold=True, punctuation=True)
_FILTER_BITS = 20
_PAD = np.uint64(0x5851F42D4C957F2D)


def embed(rows: np.ndarray, length: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """CGK embedding of sequences of word hashes (rows x width): 2 * length steps x rows, and where each step stood.

    A step doesn't look ahead, so the embedding of a row's first L words is that of the row up to where it stands at L.
    """
    n, width = rows.shape
    at = np.zeros(n, np.int64)
    base = np.arange(n) * width
    flat = rows.ravel()
    steps = 2 * length
    odd = np.random.default_rng(1000 + walk).integers(1, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out, stood = np.empty((steps, n), np.uint64), np.empty((steps, n), np.int32)
    for j in range(steps):
        got = flat[base + np.minimum(at, width - 1)]
        out[j], stood[j] = got, at
        at += ((got * odd[j]) >> np.uint64(63)).astype(np.int64)
    return out, stood


def positions(length: int, walk: int) -> np.ndarray:
    """The positions of embeddings of so many words that a walk's tables sample."""
    draw = np.random.default_rng(5000 + walk).random(2 * length)
    return np.flatnonzero((np.arange(2 * length) < DENSE) | (draw < 0.5))


def keys(emitted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key for each position and row."""
    return mix64(emitted[at] + at[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _edited(items: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Items (rows of words) after k edits of each kind, with other words behind them; as wide as an item."""
    n, size = items.shape
    new = lambda width: rng.integers(1, 1 << 63, (n, width), dtype=np.uint64)
    out = []

    def add(keep: np.ndarray, extra: np.ndarray, swap: np.ndarray) -> None:
        """Drop words that aren't kept, put a word before those of ``extra``, change those of ``swap``."""
        body = np.where(swap, new(size), items)
        both = np.stack([new(size), body], axis=2).reshape(n, 2 * size)
        there = np.stack([extra, keep], axis=2).reshape(n, 2 * size)
        order = np.argsort(~there, axis=1, kind="stable")[:, :size]
        out.append(np.where(np.take_along_axis(there, order, 1), np.take_along_axis(both, order, 1), new(size)))

    none = np.zeros((n, size), bool)
    drawn = np.argsort(rng.random((n, size)), axis=1).argsort(axis=1)
    some, kind = drawn < k, drawn % 3
    add(~some, none, none)
    add(~none, some, none)
    add(~none, none, some)
    add(~(some & (kind == 0)), some & (kind == 1), some & (kind == 2))
    for at in (0, (size - k) // 2):
        block = none.copy()
        block[:, at : at + k] = True
        add(~block, none, none)
        if at:
            add(~none, block, none)
            add(~none, none, block)
    return out


def _recalls(size: int, k: int, trials: int = 100) -> Iterator[float]:
    """After each walk the chance that the tables so far find an item of so many words after k edits, of the kind that they
    find least."""
    rng = np.random.default_rng(size)
    items = rng.integers(1, 1 << 63, (trials, size), dtype=np.uint64)
    kinds = np.stack(_edited(items, k, rng))
    missed = np.ones(kinds.shape[:2])
    for walk in range(WALKS[-1]):
        own, _ = embed(items, size, walk)
        rows, _ = embed(kinds.reshape(-1, size), size, walk)
        # beyond the item's end both are padding only where both stand there; counted as different
        agree = (rows.reshape(2 * size, *missed.shape) == own[:, None, :]).mean(axis=0)
        missed *= (1 - agree) ** len(positions(size, walk))
        yield float(1 - missed.mean(axis=1).max())


@lru_cache(None)
def walks(size: int, k: int) -> int:
    """The walks that reach the target recall at this size, or 0."""
    if size > MEASURED:
        return 0
    for n, got in enumerate(_recalls(size, k), 1):
        if n in WALKS and got >= TARGET_RECALL:
            return n
    return 0


def infix_distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of pattern to any part of text, and the end of the first best part (Myers' bit vectors)."""
    m = len(pattern)
    at: dict[int, int] = {}
    for i, x in enumerate(pattern):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, x in enumerate(text):
        eq = at.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (full & ~(xh | plus))
        hm = plus & xh
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = (hp << 1) & full
        hm = (hm << 1) & full
        plus = hm | (full & ~(xv | hp))
        minus = hp & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """Items by size, with their keys, and a filter of the words that occur in any."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.share = share
        self.sizes: dict[int, list[tuple[int, np.ndarray]]] = {}
        raw = [(t or "").encode() for _, t in items]
        w = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), _ABC)
        for k, (item, _) in enumerate(items):
            h = w.hash[w.first[k] : w.first[k + 1]]
            if len(h):
                self.sizes.setdefault(len(h), []).append((item, h))
        used = [h for xs in self.sizes.values() for _, h in xs]
        self.vocabulary = np.unique(np.concatenate(used)) if used else np.zeros(0, np.uint64)
        # rare: in few items; any choice keeps the bounds exact
        flat = [(size, y, np.searchsorted(self.vocabulary, np.unique(h))) for size, xs in self.sizes.items() for y, (_, h) in enumerate(xs)]
        n = np.bincount(np.concatenate([v for *_, v in flat]), minlength=len(self.vocabulary)) if flat else np.zeros(0, np.int64)
        rare = n <= max(2, RARE * len(used))
        self.size = np.array([size for size, *_ in flat], np.int64)
        # where an item has too few rare words, its next rarest serve as such
        chosen = [v[np.argsort(n[v], kind="stable")][: max(int(rare[v].sum()), int(share * size) + LEAST_KEPT)] for size, _, v in flat]
        # different rare words that a match of each item keeps; where that is none, the item is looked up everywhere
        self.keeps = np.array([len(v) - int(share * size) for (size, *_), v in zip(flat, chosen)], np.int64)
        self.everywhere = sorted({size for size, keeps in zip(self.size.tolist(), self.keeps.tolist()) if keeps < 1})
        pairs = np.concatenate([np.column_stack([v, np.full(len(v), i)]) for i, v in enumerate(chosen)]) if flat else np.zeros((0, 2), np.int64)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.items_of = pairs[:, 1]
        self.first_of = np.searchsorted(pairs[:, 0], np.arange(len(self.vocabulary) + 1))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.vocabulary >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.walks = {size: n for size in self.sizes if (n := walks(size, int(share * size)))}
        self.whole = self.sizes.keys() - self.walks.keys()
        self.longest = max(self.walks, default=0)
        self.sets = {size: [frozenset(h.tolist()) for _, h in xs] for size, xs in self.sizes.items()}
        self.nth = [y for _, y, _ in flat]
        self.words = [np.unique(self.sizes[size][y][1]) for size, y, _ in flat]
        self.name = uuid.uuid4().hex
        self._made: list[tuple] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": []}  # tables are made where they are used

    def tables(self, walk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tables of a walk as one: sorted keys, the items in that order, and a filter of the keys."""
        while len(self._made) <= walk:
            nth = len(self._made)
            mine = [i for i, size in enumerate(self.size.tolist()) if nth < self.walks.get(size, 0)]
            rows = [np.pad(self.sizes[size][y][1], (0, self.longest - size), constant_values=_PAD) for i in mine for size, y in [(int(self.size[i]), self.nth[i])]]
            emitted, stood = embed(np.stack(rows), self.longest, nth)
            at = positions(self.longest, nth)
            size = self.size[mine]
            there = (at[:, None] < 2 * size) & (stood[at] < size)
            key, item = keys(emitted, at)[there], np.broadcast_to(np.array(mine, np.int32), there.shape)[there]
            order = np.argsort(key, kind="stable")
            filter_ = np.zeros(1 << _FILTER_BITS, bool)
            filter_[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self._made.append((key[order], item[order], filter_))
        return self._made[walk]

    def known(self, h: np.ndarray) -> np.ndarray:
        """Number in the vocabulary of each word, or -1."""
        out = np.full(len(h), -1)
        some = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
            out[some] = np.where(self.vocabulary[at] == h[some], at, -1)
        return out

    def _close(self, number: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
        """Items and positions such that enough different rare words of the item lie from there on, within its size and k."""
        at = np.flatnonzero(number >= 0)
        times = self.first_of[number[at] + 1] - self.first_of[number[at]]
        pos = np.repeat(at, times)
        nth = np.arange(len(pos)) - np.repeat(np.cumsum(times) - times, times)
        item = self.items_of[np.repeat(self.first_of[number[at]], times) + nth]
        order = np.lexsort([pos, item])
        pos, item = pos[order], item[order]
        if not len(pos):
            return item, pos
        span = len(number) + 1
        key = item * span + pos
        size = self.size[item]
        reach = np.minimum(pos + size + (self.share * size).astype(np.int64), w.first[1:][w.doc[pos]]) - 1
        last = np.searchsorted(key, item * span + reach, "right")
        # a word that repeats the one before, among the item's, is no other word
        other = np.ones(len(pos), bool)
        other[1:] = (number[pos[1:]] != number[pos[:-1]]) | (item[1:] != item[:-1])
        changes = np.concatenate([[0], np.cumsum(other)])
        here = np.arange(len(pos))
        keeps = self.keeps[item]
        ok = (keeps > 0) & (last - here >= keeps) & (changes[last] - changes[here + 1] + 1 >= keeps)
        return item[ok], pos[ok]

    def _passages(self, item: np.ndarray, pos: np.ndarray, w) -> Iterator[tuple[int, int, int]]:
        """(item, first word, word after the last): joined ranges that hold all passages around close positions."""
        if len(pos):
            reach = self.size[item] + (self.share * self.size[item]).astype(np.int64)
            lo = np.maximum(pos - reach + 1, w.first[w.doc[pos]])
            hi = np.minimum(pos + reach, w.first[w.doc[pos] + 1])
            new = np.ones(len(pos), bool)
            new[1:] = (item[1:] != item[:-1]) | (lo[1:] >= hi[:-1])
            at = np.flatnonzero(new)
            yield from zip(item[at].tolist(), lo[at].tolist(), hi[np.append(at[1:], len(pos)) - 1].tolist())
        for i in np.flatnonzero(self.keeps < 1).tolist():
            if int(self.size[i]) in self.whole:
                yield from ((i, int(a), int(b)) for a, b in zip(w.first[:-1], w.first[1:]) if a < b)

    def hits(self, t: Texts) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, distance, item's words, first word, word after the last), the best of each row and item."""
        w = words(t.data, t.off, _ABC)
        n = len(w.hash)
        if not n or not self.sizes:
            return []
        number = self.known(w.hash)
        ahead = np.concatenate([[0], np.cumsum(number >= 0)])
        stop = w.first[1:][w.doc]
        spots: dict[int, list[np.ndarray]] = {size: [np.flatnonzero(number >= 0)] for size in self.everywhere if size not in self.whole}
        close, near = self._close(number, w)
        whole = np.isin(self.size[close], list(self.whole))
        for item, p in zip(close[~whole].tolist(), near[~whole].tolist()):
            size = int(self.size[item])
            if size not in self.everywhere:
                spots.setdefault(size, []).append(np.arange(max(int(w.first[w.doc[p]]), p - size - int(self.share * size) + 1), p + 1))
        starts: dict[int, np.ndarray] = {}
        for size, parts in spots.items():
            # a best passage begins with an equal word; of its first size words at least size - k are equal ones
            where = np.unique(np.concatenate(parts))
            where = where[number[where] >= 0]
            where = where[ahead[np.minimum(where + size, stop[where])] - ahead[where] >= size - int(self.share * size)]
            if len(where):
                starts[size] = where
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        if starts:
            every = np.unique(np.concatenate(list(starts.values())))
            for i in range(0, len(every), CHUNK):
                self._windows(every[i : i + CHUNK], starts, stop, w, best)
        for item, lo, hi in self._passages(close[whole], near[whole], w):
            self._search(item, lo, hi, w, best)
        return [(d, item, *x) for (d, item), x in best.items()]

    def _search(self, i: int, lo: int, hi: int, w, best: dict) -> None:
        """Verify an item against all words from lo to hi of one text."""
        size = int(self.size[i])
        k, mine = int(self.share * size), self.words[i]
        item, h = self.sizes[size][self.nth[i]]
        text = w.hash[lo:hi]
        # a passage has at most size + k words, of which at least size - k are the item's
        held = np.concatenate([[0], np.cumsum(mine[np.minimum(np.searchsorted(mine, text), len(mine) - 1)] == text)])
        last = np.minimum(np.arange(len(text)) + size + k, len(text))
        if (held[last] - held[:-1]).max(initial=0) >= size - k:
            self._measure(item, h, k, lo, text.tolist(), w, int(w.doc[lo]), best)

    @staticmethod
    def _measure(item: int, h: np.ndarray, k: int, lo: int, text: list[int], w, doc: int, best: dict) -> None:
        d, e = infix_distance(h.tolist(), text)
        if d <= k:
            _, b = infix_distance(h[::-1].tolist(), text[:e][::-1])
            first = int(w.first[doc])
            got = (d, len(h), lo + e - b - first, lo + e - first)
            if (doc, item) not in best or got < best[(doc, item)]:
                best[(doc, item)] = got

    def _windows(self, at: np.ndarray, starts: dict, stop: np.ndarray, w, best: dict) -> None:
        """Look up all windows that start at ``at``."""
        fit = {size: there for size, p in starts.items() if (there := np.isin(at, p, assume_unique=True)).any()}
        numbers = np.full(self.longest + 1, 0)
        numbers[list(fit)] = np.arange(1, len(fit) + 1)
        fits = np.stack([np.zeros(len(at), bool), *fit.values()])
        cols = at[:, None] + np.arange(max(fit))
        rows = np.where(cols < stop[at][:, None], w.hash[np.minimum(cols, len(w.hash) - 1)], _PAD)
        met = []
        for walk in range(max(self.walks[size] for size in fit)):
            sorted_, order, filter_ = self.tables(walk)
            emitted, stood = embed(rows, max(fit), walk)
            j = positions(self.longest, walk)
            j = j[j < len(emitted)]
            key = keys(emitted, j)
            y, x = np.nonzero(filter_[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            key = key[y, x]
            lo, hi = np.searchsorted(sorted_, key), np.searchsorted(sorted_, key, "right")
            times = hi - lo
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            item = order[np.repeat(lo, times) + nth]
            y, x = np.repeat(y, times), np.repeat(x, times)
            size = self.size[item]
            ok = fits[numbers[size], x] & (stood[j[y], x] < size)
            met.append(np.unique(item[ok].astype(np.int64) * len(at) + x[ok]))
        for code in np.unique(np.concatenate(met)).tolist():
            self._verify(code // len(at), int(at[code % len(at)]), rows[code % len(at)], stop, w, best)

    def _verify(self, i: int, start: int, row: np.ndarray, stop: np.ndarray, w, best: dict) -> None:
        size, doc = int(self.size[i]), int(w.doc[start])
        k, mine = int(self.share * size), self.sets[size][self.nth[i]]
        item, h = self.sizes[size][self.nth[i]]
        if best.get((doc, item), (1,))[0] == 0 or sum(v in mine for v in row[:size].tolist()) < size - k:
            return
        lo = max(int(w.first[doc]), start - k)
        self._measure(item, h, k, lo, w.hash[lo : min(start + size + k, int(stop[start]))].tolist(), w, doc, best)


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items of each block, and whether there are several blocks."""
    sized = benchmark.select(F.col("item_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_CHARS))
    for b in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = [(r["item_id"], r["text"]) for r in part.collect()]
        if rows:
            yield sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])), n > 1


SCHEMA = "doc_id long, item_id long, distance int, item_words int, first_word int, end_word int"


_HELD: list[Index] = []


def _held(index: Index) -> Index:
    """The index that this process already has by the same name, with its tables."""
    if not _HELD or _HELD[0].name != index.name:
        _HELD[:] = [index]
    return _HELD[0]


def _find(given: Index):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _held(given)
        for t in text_slices(batches):
            hits = sorted(index.hits(t), key=lambda x: (x[0], x[1] is None, x[1] or 0))
            ids = t.rows.column(0).to_pylist() if hits else []
            if hits:
                cols = list(zip(*hits))
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], ["doc_id", "item_id", "distance", "item_words", "first_word", "end_word"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, share: float = MAX_SHARE) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, item_words, first_word, end_word."""
    slim = docs.select("doc_id", "text")
    out = None
    for part, several in _blocks(benchmark):
        found = map_arrow(slim, _find(Index(part, share)), SCHEMA)
        found = stage(found, "dc_found") if several else found
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _without(given: Index, at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _held(given)
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            i = 0
            for t in text_slices([pa.RecordBatch.from_arrays([batch.column(at)], ["text"])]):
                for hit in index.hits(t):
                    ok[i + hit[0]] = False
                i += t.rows.num_rows
            yield batch.filter(pa.array(ok))

    return run


def drop(docs: DataFrame, benchmark: DataFrame, share: float = MAX_SHARE) -> DataFrame:
    """The rows of docs that hold no item, all columns; one pass per block of the benchmark."""
    at, old = docs.columns.index("text"), None
    for part, several in _blocks(benchmark):
        docs = map_arrow(docs, _without(Index(part, share), at), docs.schema)
        if several:  # no block's index stays at the driver
            docs = stage(docs, "dc_kept")
            if old is not None:
                unstage(old)
            old = docs
    return docs
