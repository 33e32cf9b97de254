"""Merged views of a base and a small delta, and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masked_paths(changed: DataFrame, deleted: DataFrame) -> DataFrame:
    return changed.select("path").union(deleted.select("path")).distinct()


def merge_files(base: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Base without the files of the delta, and the delta's under negated ids."""
    keep = base.join(masked_paths(changed, deleted), "path", "left_anti").select(*base.columns)
    return keep.unionByName(changed.withColumn("id", -F.col("id")).select(*base.columns))


def merge_children(base: DataFrame, base_files: DataFrame, changed: DataFrame, changed_files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of a child table (file_id) of files that stay, and the delta's under negated file ids."""
    gone = base_files.join(masked_paths(changed_files, deleted), "path", "left_semi").select(F.col("id").alias("gone"))
    keep = base.join(gone, F.col("file_id") == F.col("gone"), "left_anti").select(*base.columns)
    return keep.unionByName(changed.withColumn("file_id", -F.col("file_id")).select(*base.columns))


def remap(edges: DataFrame, base_files: DataFrame, changed: DataFrame, deleted: DataFrame, column: str = "resolved_file_id") -> DataFrame:
    """A foreign key to a deleted file becomes null, to a changed one the delta's negated id."""
    c = changed.select(F.col("path").alias("c_path"), F.col("id").alias("c_id")).groupBy("c_path").agg(F.min("c_id").alias("c_id"))
    d = deleted.select(F.col("path").alias("d_path")).distinct()
    t = base_files.select(F.col("id").alias("t_id"), "path").join(c, F.col("path") == F.col("c_path"), "left").join(d, F.col("path") == F.col("d_path"), "left").where("c_path is not null or d_path is not null")
    j = edges.join(t.select("t_id", "c_id"), F.col(column) == F.col("t_id"), "left")
    return j.withColumn(column, F.when(F.col("t_id").isNull(), F.col(column)).otherwise(-F.col("c_id"))).drop("t_id", "c_id")


def detect_changes(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action) of scan against stored, both (path, mtime, size, hash)."""
    a = scan.select("path", F.col("mtime").alias("a_m"), F.col("size").alias("a_s"), F.col("hash").alias("a_h"))
    b = stored.select("path", F.col("mtime").alias("b_m"), F.col("size").alias("b_s"), F.col("hash").alias("b_h"))
    action = F.when(F.col("b_h").isNull(), "add").when(F.col("a_h").isNull(), "delete").when((F.col("a_m") == F.col("b_m")) & (F.col("a_s") == F.col("b_s")), "unchanged").when(F.col("a_h") == F.col("b_h"), "hash_only").otherwise("update")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("action").agg(F.count("*").alias("n"))


def merge_change_sets(*sets: DataFrame) -> DataFrame:
    """(path, status): later sets win."""
    every = None
    for k, s in enumerate(sets):
        s = s.select("path", "status", F.lit(k).alias("k"))
        every = s if every is None else every.unionByName(s)
    return every.groupBy("path").agg(F.max_by("status", "k").alias("status"))


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, name, change) by signature; unchanged symbols are left out."""
    a = old.select("kind", "name", F.coalesce("signature", F.lit("")).alias("a"))
    b = new.select("kind", "name", F.coalesce("signature", F.lit("")).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, ["kind", "name"], "full_outer").select("kind", "name", change.alias("change")).where("change is not null")
