"""Versioned index tables: readers see the old version or the new one, never a mixture."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"
CHILDREN = {"symbols": "file_id", "module_edges": "file_id", "occurrences": "file_id", "relation_edges": "file_id"}


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _pointer(spark: SparkSession, root: str) -> dict | None:
    fs, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/{POINTER}")):
        return None
    text = spark.read.text(f"{root}/{POINTER}", wholetext=True).first()
    return json.loads(text.value)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict | None = None) -> int:
    """Writes all tables as the next version, then points readers to it; a failure before leaves the old version current.

    One writer at a time. ``meta`` is merged into the version's own.
    """
    old = _pointer(spark, root) or {"version": 0, "tables": [], "meta": {}}
    version = old["version"] + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")
    _point(spark, root, {"version": version, "tables": sorted(tables), "meta": old["meta"] | (meta or {})})
    return version


def _point(spark: SparkSession, root: str, at: dict) -> None:
    """Replaces the pointer in one step."""
    fs, path = _fs(spark, root)
    new = path(f"{root}/{POINTER}.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(at, sort_keys=True), "utf-8"))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, path(f"{root}/{POINTER}"), options)


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current version."""
    at = _pointer(spark, root)
    if at is None or table not in at["tables"]:
        raise FileNotFoundError(f"no published table {table} below {root}")
    return spark.read.parquet(f"{root}/version={at['version']}/{table}")


def meta(spark: SparkSession, root: str) -> dict:
    return (_pointer(spark, root) or {"meta": {}})["meta"]


def prune_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Removes versions older than the newest ``keep``; gives their numbers."""
    fs, path = _fs(spark, root)
    at = _pointer(spark, root)
    gone = []
    for n in range(1, (at["version"] if at else 0) - keep + 1):
        if fs.delete(path(f"{root}/version={n}"), True):
            gone.append(n)
    return gone


def broken(spark: SparkSession, root: str) -> list[str]:
    """Tables of the current version that can't be read as written."""
    bad = []
    for name in (_pointer(spark, root) or {"tables": []})["tables"]:
        try:
            load(spark, root, name).count()
        except Exception:  # whatever the reader says, the table is to be rebuilt
            bad.append(name)
    return bad


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the files of gone(id): their rows go, edges from elsewhere keep a null instead of the file."""
    g = gone.select(F.col("id").alias("__gone")).distinct()
    out = dict(tables)
    out["files"] = tables["files"].join(g, F.col("id") == F.col("__gone"), "left_anti")
    for name, key in CHILDREN.items():
        if name in tables:
            out[name] = tables[name].join(g, F.col(key) == F.col("__gone"), "left_anti")
    if "module_edges" in tables:
        e = out["module_edges"].join(g, F.col("resolved_file_id") == F.col("__gone"), "left")
        out["module_edges"] = e.withColumn("resolved_file_id", F.when(F.col("__gone").isNull(), F.col("resolved_file_id"))).drop("__gone")
    return out


def export_ndjson(events: DataFrame, since_ms: int, folder: str) -> None:
    events.where(F.col("ts_ms") >= since_ms).write.mode("overwrite").json(folder)


def export_csv(events: DataFrame, since_ms: int, folder: str) -> None:
    """With a header; quotes are doubled."""
    events.where(F.col("ts_ms") >= since_ms).write.mode("overwrite").csv(folder, header=True, quote='"', escape='"')


def since(text: str, now_ms: int) -> int:
    """Start of '30d' or '1h' back from now; anything else means 30 days."""
    unit = {"d": 86_400_000, "h": 3_600_000}.get(text[-1:])
    return now_ms - (int(text[:-1]) * unit if unit and text[:-1].isdecimal() else 30 * 86_400_000)


def recorder(folder: str):
    """A function that appends rows of pack runs or events to a table; what it can't write is dropped with a warning."""

    def record(rows: DataFrame) -> bool:
        try:
            rows.write.mode("append").parquet(folder)
        except Exception as e:  # a lost record must not end the operation that it tells of
            warnings.warn(f"not recorded: {type(e).__name__}: {e}", stacklevel=2)
            return False
        return True

    return record


def purge(spark: SparkSession, folder: str, sure: bool = False) -> bool:
    """Removes a table of records; only if the caller is sure."""
    if not sure:
        return False
    fs, path = _fs(spark, folder)
    return bool(fs.delete(path(folder), True))


def repair(spark: SparkSession, root: str) -> list[str]:
    """Points readers back to the newest version all of whose tables can be read, if the current one isn't; gives what was broken."""
    bad = broken(spark, root)
    at = _pointer(spark, root)
    fs, path = _fs(spark, root)
    while bad and at and at["version"] > 1:
        at = at | {"version": at["version"] - 1}
        if not fs.exists(path(f"{root}/version={at['version']}")):
            continue
        _point(spark, root, at)
        if not broken(spark, root):
            return bad
    return bad
