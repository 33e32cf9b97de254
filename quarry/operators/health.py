"""Dead code, tests, stale docs, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import doc_params, missing_from, test_path
from quarry.operators.lookup import find, with_path


def unused_exports(exports: DataFrame, imports: DataFrame, occurrences: DataFrame, symbols: DataFrame | None = None, runtime_only: bool = False) -> DataFrame:
    """Named exports without a named importer and without an occurrence in another file."""
    x = exports.where("kind = 'export' and name is not null and not is_star")
    i = imports.where("not is_star and not is_default")
    o = occurrences
    if runtime_only:
        i, o = i.where("not is_type"), o.where("ref_kind is distinct from 'type-ref'")
    by = i.select("resolved_file_id", F.explode(F.array_distinct(F.array_compact(F.array("name", "alias")))).alias("n")) if "alias" in imports.columns else i.select("resolved_file_id", F.col("name").alias("n"))
    x = x.join(by, (F.col("file_id") == F.col("resolved_file_id")) & (F.col("name") == F.col("n")), "left_anti")
    # a name used in two files, or in one other than its own: one row per name instead of one per occurrence
    used = o.groupBy(F.col("name").alias("o_name")).agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"))
    x = x.join(used, (F.col("name") == F.col("o_name")) & ((F.col("lo") != F.col("file_id")) | (F.col("hi") != F.col("file_id"))), "left_anti")
    if symbols is None:
        return x
    k = symbols.groupBy(F.col("file_id").alias("k_file"), F.col("name").alias("k_name")).agg(F.min_by("kind", "id").alias("symbol_kind"))
    return x.join(k, (F.col("file_id") == F.col("k_file")) & (F.col("name") == F.col("k_name")), "left").withColumn("symbol_kind", F.coalesce("symbol_kind", F.lit("export"))).drop("k_file", "k_name")


def private_dead(symbols: DataFrame, exports: DataFrame, occurrences: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Top-level symbols that their file neither exports nor names on another line."""
    s = symbols.where("scope is null")
    if kinds:
        s = s.where(F.col("kind").isin(kinds))
    named = exports.where("name is not null").select(F.col("file_id").alias("e_file"), F.col("name").alias("e_name"))
    star = exports.where("kind = 're-export' and is_star").select(F.col("file_id").alias("e_file"))
    s = s.join(named, (F.col("file_id") == F.col("e_file")) & (F.col("name") == F.col("e_name")), "left_anti").join(star, F.col("file_id") == F.col("e_file"), "left_anti")
    # another line exists if the least or the greatest differs
    seen = occurrences.groupBy(F.col("file_id").alias("o_file"), F.col("name").alias("o_name")).agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    cond = (F.col("file_id") == F.col("o_file")) & (F.col("name") == F.col("o_name")) & ((F.col("lo") != F.col("line")) | (F.col("hi") != F.col("line")))
    return s.join(seen, cond, "left_anti")


def tests_for(imports: DataFrame, files: DataFrame, target_file_id: int) -> DataFrame:
    """Test files that import a file, and how the path tells that they are tests."""
    i = with_path(imports.where(F.col("resolved_file_id") == target_file_id), files)
    return i.withColumn("test", test_path("path")).where("test is not null").dropDuplicates(["file_id", "line", "name"])


def stale_docs(symbols: DataFrame, params) -> DataFrame:
    """Documented symbols whose @param names differ from the signature's; params: Column of array<string> of the signature."""
    s = symbols.where("doc is not null and signature is not null and kind in ('function', 'method', 'hook', 'component')")
    s = s.withColumn("doc_params", doc_params("doc")).withColumn("sig_params", params)
    s = s.withColumn("unknown", missing_from("doc_params", "sig_params")).withColumn("undocumented", missing_from("sig_params", "doc_params"))
    return s.where((F.size("doc_params") > 0) & (F.size("unknown") + F.size("undocumented") > 0))


def rename_safety(symbols: DataFrame, files: DataFrame, occurrences: DataFrame, imports: DataFrame, relations: DataFrame, name: str, new_name: str) -> DataFrame:
    """One row: counts, risk and reasons of renaming the first definition of ``name``."""
    d = symbols.where(F.col("name") == name).agg(F.min(F.struct("id", "file_id", "line")).alias("d")).select("d.*").where("id is not null").select(F.col("id").alias("d_id"), F.col("file_id").alias("d_file"), F.col("line").alias("d_line"))
    d = F.broadcast(d)  # one row
    o = occurrences.where(F.col("name") == name).join(d).where("not (file_id = d_file and line = d_line)")
    uses = o.agg(F.count("*").alias("callers"), F.count_if(F.col("ref_kind") == "type-ref").alias("type_refs"))
    imp = imports.join(d, F.col("resolved_file_id") == F.col("d_file")).where(F.col("is_star") | (F.col("name") == name)).agg(F.countDistinct("file_id").alias("importers"))
    kids = relations.agg(F.count_if(F.col("target_name") == name).alias("children"), F.count_if(F.col("source_name") == name).alias("parents"))
    dirs = files.select(F.col("id").alias("f_id"), F.regexp_extract("path", "^(.*)/", 1).alias("dir"))
    mine = d.join(dirs.withColumnRenamed("dir", "d_dir"), F.col("f_id") == F.col("d_file")).select("d_file", "d_dir")
    clash = symbols.where(F.col("name") == new_name).join(dirs, F.col("file_id") == F.col("f_id")).join(F.broadcast(mine))
    clash = clash.agg(F.count_if(F.col("file_id") == F.col("d_file")).alias("same_file"), F.count_if((F.col("file_id") != F.col("d_file")) & (F.col("dir") == F.col("d_dir"))).alias("same_module"))
    one = d.join(uses).join(imp).join(kids).join(clash)
    high = F.array_compact(F.array(F.when(F.col("children") > 0, "has_children"), F.when(F.col("importers") > 0, "has_importers"), F.when(F.col("same_module") > 0, "same_module_collision")))
    mid = F.array_compact(
        F.array(F.when(F.col("callers") > 0, "has_callers"), F.when((F.col("callers") == 0) & (F.col("type_refs") > 0), "has_type_refs"), F.when(F.col("parents") > 0, "has_parents"), F.when(F.col("same_file") > 0, "same_file_collision"))
    )
    return one.withColumn("high", high).withColumn("mid", mid).select(
        F.col("d_id").alias("id"), "callers", "importers", "children", "parents", (F.col("callers") + F.col("importers") + F.col("children")).alias("blast_radius"),
        F.when(F.size("high") > 0, "high").when(F.size("mid") > 0, "medium").otherwise("low").alias("risk"),
        F.array_join(F.when(F.size("high") > 0, F.col("high")).when(F.size("mid") > 0, F.col("mid")).otherwise(F.array(F.lit("no_external_refs"))), ",").alias("reasons"),
    )


def ref_kind_histogram(occurrences: DataFrame, name: str) -> DataFrame:
    """(ref_kind, n) of a name's occurrences; those without a kind count as unknown."""
    return occurrences.where(F.col("name") == name).groupBy(F.coalesce("ref_kind", F.lit("unknown")).alias("ref_kind")).agg(F.count("*").alias("n"))


def refactor_preview(symbols: DataFrame, occurrences: DataFrame, imports: DataFrame, name: str, relations: DataFrame | None = None) -> DataFrame:
    """Edit sites by file: roles and lines.

    relations(file_id, kind, target_name, line) add the sites of subclasses, implementers and overrides.
    """
    a = symbols.where(F.col("name") == name).select("file_id", "line", F.lit("definition").alias("role"))
    b = occurrences.where((F.col("name") == name) & F.col("ref_kind").isin("call", "read", "write", "type-ref")).select("file_id", "line", F.lit("caller").alias("role"))
    c = imports.where(F.col("name") == name).select("file_id", "line", F.lit("importer").alias("role"))
    sites = a.unionByName(b).unionByName(c)
    if relations is not None:
        role = F.when(F.col("kind") == "implements", "implementer").when(F.col("kind") == "overrides_method", "override").otherwise("subclass")
        of = (F.col("target_name") == name) | ((F.col("kind") == "overrides_method") & F.col("target_name").endswith(f".{name}"))
        sites = sites.unionByName(relations.where(of).select("file_id", "line", role.alias("role")))
    sites = sites.distinct()
    lines = F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: x.cast("string")), ",")
    return sites.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), lines.alias("lines"), F.count("*").alias("edits"))


def clarify(symbols: DataFrame, files: DataFrame, imports: DataFrame, name: str) -> DataFrame:
    """Candidates of a name with the number of files that import each."""
    s = find(symbols, files, name).where(F.col("name") == name)
    n = imports.where(F.col("is_star") | (F.col("name") == name)).groupBy(F.col("resolved_file_id").alias("r")).agg(F.countDistinct("file_id").alias("n"))
    return s.join(n, F.col("file_id") == F.col("r"), "left").select("id", "path", "kind", "line", F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce("n", F.lit(0)).cast("long").alias("importer_count"))


def disambiguators(candidates: DataFrame) -> DataFrame:
    """One row: the distinct files, kinds and scopes of clarify's rows, sorted."""
    told = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",").alias(f"{c}s")
    return candidates.agg(told("path"), told("kind"), told("scope"))


def relation_summary(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, kind, direction, n): relations of clarify's candidates by kind, as their source and as their target."""
    up = relations.select(F.col("source_id").alias("r_id"), "kind", F.lit("parent").alias("direction"))
    down = relations.select(F.col("target_id").alias("r_id"), "kind", F.lit("child").alias("direction"))
    return candidates.select("id").join(up.union(down), F.col("id") == F.col("r_id")).groupBy("id", "kind", "direction").agg(F.count("*").alias("n"))


def pick(candidates: DataFrame) -> DataFrame:
    """The candidate that most files import, then by path and line."""
    return candidates.orderBy(F.desc("importer_count"), "path", "line", "id").limit(1)
