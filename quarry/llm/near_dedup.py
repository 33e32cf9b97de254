"""MinHash near-duplicate detection: universal hash minima, banding, signature and exact verification, star components.

Definition. A text's words are the runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. Its set holds its distinct
``width``-word shingles; a text with fewer words has one, its whole word sequence; null and empty texts have none and are
linked with nothing. Two documents are linked if 100 * |intersection| >= percent * |union|.

Plan. Equal texts are one node, named by the MD5 of the text, so copies cost one row each and no pairs; a node keeps its
signature. Nodes that share a band of it are a bucket. First every node is verified against one other only, the least head
(first node) of its buckets; that joins most copies at the price of one text a node. Then buckets whose nodes lie in
several components are compared in full, in blocks: a task of a pair of blocks tells by signatures which nodes have a
partner in another component, and only these nodes' texts follow for the exact comparison, which returns a spanning forest
of the links that it confirms. So neither rows out nor memory grow with the square of a bucket. The bands go in chunks:
links are merged by large-star and small-star before the next, which then skips buckets that lie in one component.

Recall: with 20 bands of 4 minima, a pair at similarity 0.85 shares no band with probability (1 - 0.85**4)**20 = 4e-7.

Edge cases: a null doc_id takes part in links but is never a component's id (null if all of its ids are null); repeated
rows get the same component; rows with equal doc_id and different texts are different nodes; an empty table gives an
empty result; columns other than doc_id and text are ignored (``keep_one``: pass through, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import Alphabet, Texts, connected_components, join_one, map_arrow, mix64, packed, stage, text_slices, unstage, words

BANDS, ROWS = 20, 4
#: Bands in each chunk that is compared in full.
CHUNKS = ((0, 5), (5, 20))
#: A block of a bucket has about so many nodes or shingles at most; so many nodes at most meet one copy of their head.
BLOCK_NODES, BLOCK_SHINGLES, HEAD_NODES = 2048, 4_000_000, 256

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ABC = Alphabet(fold=True)


def shingle_sets(t: Texts, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    w = words(t.data, t.off, _ABC)
    n = len(w.hash)
    odd = [np.uint64(0x9FB21C651E98DF25 + 2 * k * 0x5851F42D) | np.uint64(1) for k in range(width)]
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            full = full * odd[k] + w.hash[k : k + len(full)]
        full = mix64(full)
        for d in range(len(w.first) - 1):
            a, b = w.first[d], w.first[d + 1]
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                h = np.uint64(b - a)
                for x in w.hash[a:b]:
                    h = h * odd[0] + x
                yield mix64(np.array([h], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """uint32 minima of BANDS * ROWS universal hashes."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 16384):
        x = s[None, i : i + 16384] * _A[:, None]
        x += _B[:, None]
        np.minimum(out, (x.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A key for each row and band; its last five bits are the band's number."""
    band = np.arange(BANDS, dtype=np.uint64)
    h = np.broadcast_to(band + np.uint64(1), (len(sigs), BANDS)).copy()
    for k in range(ROWS):
        h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + sigs.reshape(-1, BANDS, ROWS)[:, :, k])
    return ((h & ~np.uint64(31)) | band).view(np.int64)


def _scan(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            ns, sigs = [], []
            for s in shingle_sets(t, width):
                ns.append(len(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([t.rows.column(0), t.rows.column(1), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "h", "n_shingles", "sig"])

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), BANDS * ROWS)


def _flat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, size): a row for each node and band."""
    for batch in batches:
        keys = band_keys(_signatures(batch.column(2)))
        each = [np.repeat(batch.column(x).to_numpy(), BANDS) for x in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *map(pa.array, each)], ["key", "id", "size"])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _star(width: int, percent: int):
    """Rows (head, nb, salt, other, id, text), the head first in each group: links of the others with it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, mine = None, None, np.zeros(0, np.uint64)
        for t in text_slices(batches):
            found = []
            rows = zip(*(t.rows.column(x).to_pylist() for x in range(5)))
            for (h, nb, salt, other, node), s in zip(rows, shingle_sets(t, width)):
                if not other:
                    key, head, mine = (h, nb, salt), node, s
                elif key == (h, nb, salt) and _linked(mine, s, percent):
                    found.append((node, head))
            if found:
                yield _pairs(found)

    return run


def _blocks(batches: Iterable[pa.RecordBatch], held_columns: list[str]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """The rows of each (key, i, j), which follow each other."""
    parts: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([batch.column(x).to_numpy() for x in range(3)])
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
            now = tuple(k[a].tolist())
            if now != key and parts:
                yield key, pa.Table.from_batches(parts).select(held_columns)
                parts = []
            key = now
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, pa.Table.from_batches(parts).select(held_columns)


def _partners(key: tuple[int, int, int], mine: np.ndarray, code: np.ndarray, size: np.ndarray, sig: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each node of the left block those that it may be linked with, in other components; the likeliest first."""
    band, two = key[0] & 31, key[1] != key[2]
    left = np.flatnonzero(mine == key[1]) if two else np.arange(len(mine))
    right = np.flatnonzero(mine == key[2])
    for at, i in enumerate(left.tolist()):
        js = right if two else right[at + 1 :]
        js = js[(code[js] != code[i]) & (100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))]
        if not len(js):
            continue
        same = sig[js] == sig[i]
        est = same.sum(axis=1)
        ok = est * 2 >= same.shape[1]  # a pair at 0.8 falls under one half with probability under 1e-9
        if band:  # a pair is compared in the first band that it shares
            ok &= ~same[:, : band * ROWS].reshape(len(js), band, ROWS).all(axis=2).any(axis=1)
        if ok.any():
            yield i, js[ok][np.argsort(-est[ok], kind="stable")]


_HELD = ["mine", "id", "comp", "size", "sig"]


def _candidates(percent: int):
    """Rows (key, i, j, mine, id, comp, size, sig) of those nodes that have a partner by their signatures."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _blocks(batches, _HELD):
            mine, node, comp, size = (rows.column(x).to_numpy() for x in range(4))
            if comp.min() == comp.max():
                continue
            need = np.zeros(len(mine), bool)
            for i, js in _partners(key, mine, comp, size, _signatures(rows.column(4).combine_chunks()), percent):
                need[i] = True
                need[js] = True
            if need.any():
                some = rows.filter(pa.array(need)).combine_chunks().to_batches()[0]
                n = some.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int32()), pa.array([key[2]] * n, pa.int32()), *some.columns], ["key", "i", "j", *_HELD])

    return run


def _verify(width: int, percent: int):
    """A spanning forest of the confirmed links between components, for the nodes of each pair of blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _blocks(batches, [*_HELD, "text"]):
            mine, node, comp, size = (rows.column(x).to_numpy() for x in range(4))
            code = np.unique(comp, return_inverse=True)[1]
            parent = list(range(int(code.max()) + 1))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            sets = [s for t in text_slices(rows.select(["text"]).to_batches()) for s in shingle_sets(t, width)]
            found = []
            for i, js in _partners(key, mine, code, size, _signatures(rows.column(4).combine_chunks()), percent):
                for j in js.tolist():
                    a, b = root(int(code[i])), root(int(code[j]))
                    if a != b and _linked(sets[i], sets[j], percent):
                        parent[max(a, b)] = min(a, b)
                        found.append((int(node[i]), int(node[j])))
            if found:
                yield _pairs(found)

    return run


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """labels(node, label) after the links found(a, b); what is merged already stands for itself by its label."""
    new = stage(found, "nd_links")
    if not new.isEmpty():
        edges = new if labels is None else new.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        old, labels = labels, connected_components(edges)
        if old is not None:
            unstage(old)
    unstage(new)
    return labels


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; see the module's text."""
    return _components(docs, width, percent).drop("h", "group")


def _digest() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """With h, the text's digest, and group, a number for each component (null without shingles); staged."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", _digest().alias("h"), "text")
    scan = stage(map_arrow(texts, _scan(width), "doc_id long, h binary, n_shingles long, sig binary"), "nd_scan")
    nodes = scan.where("n_shingles > 0").groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("size"), F.any_value("sig").alias("sig"))
    nodes = stage(nodes.withColumn("id", F.monotonically_increasing_id()), "nd_nodes")
    flat = map_arrow(nodes.select("id", "size", "sig"), _flat, "key long, id long, size long")
    heads = flat.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("cnt")).where("cnt > 1")
    buckets = stage(flat.join(heads, "key"), "nd_buckets")
    # the texts of nodes in buckets, from the row of each that has the least doc_id
    need = buckets.select("id").distinct().join(nodes.select("id", "h", "rep"), "id").select("id", F.col("h").alias("h1"), "rep")
    held = texts.join(need, (texts["h"] == need["h1"]) & texts["doc_id"].eqNullSafe(need["rep"])).groupBy("id").agg(F.any_value("text").alias("text"))
    held = stage(held, "nd_texts")

    # each node against one head
    first = buckets.where("id <> head").groupBy("id").agg(F.min("head").alias("head"), F.max("cnt").alias("cnt"))
    first = first.withColumn("nb", F.ceil(F.col("cnt") / HEAD_NODES).cast("long")).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("nb")))
    both = first.select("head", "nb", "salt", F.lit(True).alias("other"), "id").union(first.select("head", "nb", "salt").distinct().select("head", "nb", "salt", F.lit(False), F.col("head")))
    group = ["head", "nb", "salt"]
    full = both.join(held, "id").select(*group, "other", "id", "text").repartition(*group).sortWithinPartitions(*group, "other", "id")
    labels = _merged(None, map_arrow(full, _star(width, percent), "a long, b long"))

    # buckets that hold several components, in full
    for lo, hi in CHUNKS:
        b = buckets.where((F.col("key").bitwiseAND(31) >= lo) & (F.col("key").bitwiseAND(31) < hi)).select("key", "id", "size")
        if labels is None:
            b = b.withColumn("comp", F.col("id"))
        else:
            b = b.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")
        open_ = b.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("cnt"), F.sum("size").alias("all")).where("c0 <> c1")
        nb = F.greatest(F.ceil(F.col("cnt") / BLOCK_NODES), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
        b = b.join(open_.select("key", nb.alias("nb")), "key").withColumn("mine", F.pmod(F.xxhash64("id", "key"), F.col("nb")).cast("int"))
        b = b.select("key", "id", "comp", "mine", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
        b = b.select("key", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "mine", "id", "comp").join(nodes.select("id", "size", "sig"), "id")
        order = ["key", "i", "j"]
        b = b.select(*order, *_HELD).repartition(*order).sortWithinPartitions(*order, "mine", "id")
        some = stage(map_arrow(b, _candidates(percent), "key long, i int, j int, mine int, id long, comp long, size long, sig binary"), "nd_some")
        full = some.join(held, "id").select(*order, *_HELD, "text").repartition(*order).sortWithinPartitions(*order, "mine", "id")
        labels = _merged(labels, map_arrow(full, _verify(width, percent), "a long, b long"))
        unstage(some)
    unstage(held)
    unstage(buckets)

    named = nodes.select("id", "h", "rep", "copies")
    if labels is None:
        named = named.select("h", F.col("id").alias("group"), F.col("rep").alias("cid"), "copies")
    else:
        mine = labels.withColumnRenamed("node", "id").join(nodes.select("id", "rep"), "id")
        mine = mine.join(mine.groupBy("label").agg(F.min("rep").alias("least")), "label").select("id", "label", "least", F.lit(True).alias("in"))
        named = named.join(mine, "id", "left").select("h", F.coalesce("label", "id").alias("group"), F.expr("case when `in` then least else rep end").alias("cid"), "copies")
    named = stage(named, "nd_named")
    # a text that many rows share is one row on the right
    out = join_one(scan.select("doc_id", "h", "n_shingles"), named, "h", "copies", scan.count())
    cid = F.when(F.col("n_shingles") > 0, F.col("cid")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "h", "group", "n_shingles", cid.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    out = stage(out, "nd_rows")
    for x in (scan, nodes, named, labels):
        if x is not None:
            unstage(x)
    return out


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, and all rows without words; all columns.

    A component keeps its least doc_id; of several texts under that id the one with the least digest, and of repeated rows
    the one whose columns have the least hash.
    """
    found = _components(docs, width, percent)
    some = found.where("n_shingles > 0")
    least = some.groupBy("group").agg(F.min(F.when(F.col("kept"), F.col("h"))).alias("h0"), F.count("*").alias("weight"))
    rows = join_one(some.groupBy("group", "doc_id", "h", "kept").agg(F.count("*").alias("times")), stage(least, "nd_least"), "group", "weight", some.count())
    rows = stage(rows.select(F.col("doc_id").alias("id1"), F.col("h").alias("h1"), "times", F.coalesce(F.col("kept") & (F.col("h") == F.col("h0")), F.lit(False)).alias("stays")), "nd_keys")
    unstage(found)
    mine = packed(docs, "doc_id", "text").withColumn("h", _digest())
    same = lambda keys: mine["doc_id"].eqNullSafe(keys["id1"]) & (mine["h"] == keys["h1"])
    out = mine.join(gone := rows.where("times > 1 or not stays"), same(gone), "left_anti").select("row.*")
    again = rows.where("times > 1 and stays")
    if not again.isEmpty():
        one = mine.join(again, same(again), "left_semi").groupBy("doc_id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.union(one.select("row.*"))
    return out
