"""Shared pieces: staged tables in the cluster's shared folder, connected components, vectorised word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.shipping import ship

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, in local mode, a temporary one of this process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/quarry-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return f"file://{_OWN['dir']}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """mapInArrow with this package's code on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def packed(df: DataFrame, *names: str) -> DataFrame:
    """df's rows whole, as ``row``, beside copies of some columns: no other name of df can clash with those to come."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *names)


#: A key with more than this share of the rows is hot; so there are at most 1 / HOT of them.
HOT = 1e-4


def join_one(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int) -> DataFrame:
    """Left join on key with right, which has one row per key and tells, as ``weight``, how many of left's ``rows`` have it.

    The rows of hot keys meet theirs by a broadcast of at most 1 / HOT rows, so that none of them loads one task.
    """
    hot = F.col(weight) > HOT * rows
    few = right.where(hot).drop(weight)
    return left.join(F.broadcast(few), key).union(left.join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(~hot).drop(weight), key, "left"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Alternating large-star and small-star over ``edges(a, b)`` of any orderable type; returns ``(node, label)``.

    label is the smallest node of the component. Nodes without an edge are absent. Every round is a group-by-min with
    map-side combine and a join back on the node, so a hub costs one row per edge; the edge list is staged each round and
    never reaches the driver.
    """
    spark = edges.sparkSession
    cur = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    last = None
    for _ in range(max_rounds):
        # large-star: neighbours above u hang on the least of u's closed neighbourhood
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: u and its neighbours below it hang on the least of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stage(small.union(low2.select("a", F.col("m").alias("b"))).distinct(), "cc")
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        unstage(cur)
        cur = new
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("connected components did not settle")
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("label")).union(cur.select("b", "b").distinct())
    out._staged_path = cur._staged_path
    return out


def hash_rank(df: DataFrame, by: list[str], order: list[str], rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Add ``rank``: 0-based position of each row within ``by``, in the order of the hex digest ``order[0]``, then the rest.

    No task sees a whole group: rows are counted by a prefix of the digest, prefix sums over those counts give each
    prefix its offset, and only rows that share group and prefix are sorted together.
    """
    hexes = 1
    while rows / 16**hexes > per_bucket and hexes < 7:
        hexes += 1
    cut = F.substring(order[0], 1, hexes)
    counts = df.groupBy(*by, cut.alias("__p")).agg(F.count("*").alias("__n"))
    from pyspark.sql import Window

    before = counts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__p").alias("__q"), (F.sum("__n").over(Window.partitionBy(*by).orderBy("__p")) - F.col("__n")).alias("__off"))
    here = df.withColumn("__p", cut)
    cond = here["__p"] == before["__q"]
    for c in by:
        cond &= here[c].eqNullSafe(before[f"__{c}"])
    w = Window.partitionBy(*by, "__p").orderBy(*order)
    return here.join(before, cond).withColumn("rank", F.col("__off") + F.row_number().over(w) - 1).drop("__p", "__q", "__off", *[f"__{c}" for c in by])


# --- text in Arrow batches -------------------------------------------------------------------------------------------

WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Texts(NamedTuple):
    rows: pa.RecordBatch
    data: np.ndarray  # UTF-8 bytes of the rows' texts, one after the other
    off: np.ndarray  # len(rows) + 1 offsets into data


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[Texts]:
    """Cut Arrow batches into runs of rows of about ``limit`` bytes of text; a longer text is a run of its own. Null reads as empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = col.fill_null("")
        wide = pa.types.is_large_string(col.type)
        if not (wide or pa.types.is_string(col.type)):
            col = col.cast(pa.string())
        n = len(col)
        if n == 0:
            continue
        _, offs, data = col.buffers()
        off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield Texts(batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i])
            i = j


_P = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, 1 << 21)
        for key, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[key] = np.cumprod(a, dtype=np.uint64)
    return _POW["p"], _POW["i"]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Alphabet:
    """How bytes become words: separators, and a 64-bit code per byte (upper and lower case alike where folded)."""

    def __init__(self, fold: bool = False, punctuation: bool = False):
        self.sep = WS.copy()
        if punctuation:
            self.sep[[c for c in range(128) if not chr(c).isalnum()]] = True
        codes = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            codes[65:91] = codes[97:123]
        self.codes = codes


class Words(NamedTuple):
    hash: np.ndarray  # uint64 per word
    start: np.ndarray  # first byte
    end: np.ndarray  # byte after the last
    doc: np.ndarray  # row
    first: np.ndarray  # per row + 1: index of its first word


def words(data: np.ndarray, off: np.ndarray, abc: Alphabet) -> Words:
    """Split and hash all words of a run of texts at once; no Python loop over words."""
    n = len(data)
    docs = len(off) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, z, np.zeros(docs + 1, np.int64))
    w = ~abc.sep[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = w.copy()
    starts[1:] &= ~w[:-1] | edge[1:n]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | edge[1:n]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    p, inv = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(abc.codes[data] * p[:n], out=total[1:])
    h = mix64((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
    first = np.searchsorted(s, off)
    return Words(h, s, e, np.repeat(np.arange(docs), np.diff(first)), first)
