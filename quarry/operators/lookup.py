"""Lookups by name, kind and path: rank candidates, keep the best rank that has rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import TO_LOWER, first_doc_line, posix, same_name, under
from quarry.operators.spans import export_name


def best_rank(df: DataFrame, rank: Column) -> DataFrame:
    """Rows with the least rank (null: none), in one pass; few rows pass the ranks' filter."""
    ranked = df.withColumn("__rank", rank).where("__rank is not null")
    least = ranked.agg(F.min("__rank").alias("__least"))
    return ranked.join(F.broadcast(least), F.col("__rank") == F.col("__least")).drop("__rank", "__least")  # least is one row


def with_path(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select(F.col("id").alias("file_id"), "path", "language"), "file_id")


def find(symbols: DataFrame, files: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Symbols of that name; of any case (ASCII) if there are none. A column ``name_key`` of such lower-case names is used for it."""
    s = symbols.where(F.col("name_key") == name.translate(TO_LOWER)) if "name_key" in symbols.columns else symbols.where(same_name("name", name))
    if kind:
        s = s.where(F.col("kind") == kind)
    return with_path(best_rank(s, F.when(F.col("name") == name, 0).otherwise(1)), files)


def refs(occurrences: DataFrame, files: DataFrame, name: str, ref_kinds: list[str] | None = None) -> DataFrame:
    o = occurrences.where(F.col("name") == name)
    if ref_kinds:
        o = o.where(F.col("ref_kind").isin(ref_kinds))  # null never passes
    return with_path(o, files)


def kind_index(symbols: DataFrame, files: DataFrame, kind: str, prefix: str | None = None, limit: int = 200) -> DataFrame:
    s = with_path(symbols.where(F.col("kind") == kind), files.where(under("path", prefix)))
    return s.orderBy("path", "line", "id").limit(min(max(limit, 1), 1000))


def signatures(symbols: DataFrame, files: DataFrame, names: list[str], kind: str | None = None) -> DataFrame:
    """First definition of each name in each file, with the first line of its doc if it has one."""
    s = symbols.where(F.col("name").isin(names))
    if kind:
        s = s.where(F.col("kind") == kind)
    s = with_path(s, files)
    w = Window.partitionBy("name", "path").orderBy("line", "id")
    s = s.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return s.withColumn("doc_line", first_doc_line("doc")) if "doc" in s.columns else s


def doc_lookup(symbols: DataFrame, files: DataFrame, name: str, file: str | None = None) -> DataFrame:
    s = find(symbols, files, name)
    return s.where(F.lower("path").endswith(file.lower())) if file else s


def find_file(files: DataFrame, path: str) -> DataFrame:
    """Exact path, else in any case, else the first that ends in it."""
    p = path.replace("\\", "/")
    low = F.lower(posix("path"))
    rank = F.when(posix("path") == p, 0).when(low == p.lower(), 1).when(low.endswith(p.lower()), 2)
    return files.withColumn("__rank", rank).where("__rank is not null").orderBy("__rank", "id").limit(1).drop("__rank")


def file_paths(files: DataFrame, language: str | None = None, prefix: str | None = None) -> DataFrame:
    f = files.where((F.col("status") == "indexed") & under("path", prefix))
    return (f.where(F.col("language") == language) if language else f).select("id", "path", "language")


def exports_of(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind").isin("export", "re-export"))


def imports_of(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind").isin("import", "dynamic-import", "require"))


def index_health(files: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return files.agg(F.count("*").alias("total"), n("indexed").alias("indexed"), n("skipped").alias("skipped"), n("error").alias("errored"), F.when(n("error") > 0, "partial").otherwise("ok").alias("health"))


def language_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    per = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    j = files.join(per, F.col("id") == F.col("file_id"), "left")
    return j.groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


def tree(files: DataFrame, symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """Every file with its number of symbols and its exported names in line order."""
    n = symbols.groupBy("file_id").agg(F.count("*").alias("symbol_count"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", export_name(exports).alias("name")))), lambda x: x["name"]), ",")
    e = exports.groupBy(F.col("file_id").alias("e_id")).agg(names.alias("exports"))
    j = files.join(n, F.col("id") == F.col("file_id"), "left").join(e, F.col("id") == F.col("e_id"), "left")
    return j.select("id", "path", "status", F.coalesce("symbol_count", F.lit(0)).cast("long").alias("symbol_count"), F.coalesce("exports", F.lit("")).alias("exports"))


def last_run(runs: DataFrame) -> DataFrame:
    """The newest row of runs(id, mode, status, ...)."""
    return runs.orderBy(F.desc("id")).limit(1)


def unresolved(relations: DataFrame) -> DataFrame:
    return relations.where("target_id is null")


def index_status(files: DataFrame, runs: DataFrame) -> DataFrame:
    """index_health with the mode and the status of the last run; null where there was none."""
    return index_health(files).join(F.broadcast(last_run(runs).select(F.col("mode").alias("run_mode"), F.col("status").alias("run_status"))), how="left")


def updated(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """table with ``column`` from changes(key, column) where these have a row for it; the last by order of its value counts."""
    new = changes.groupBy(F.col(key).alias("__key")).agg(F.max(column).alias("__new"), F.lit(True).alias("__has"))
    j = table.join(new, F.col(key) == F.col("__key"), "left")
    return j.withColumn(column, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(column))).select(*table.columns)
