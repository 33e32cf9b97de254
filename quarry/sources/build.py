"""Index builds as one job: scan, changes, extraction, resolution, publication; overlays of a work tree on a base index."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph, overlay
from quarry.sources import publish
from quarry.sources.extract import extract, rows

#: Versions of the tables' layout and of the extractors' rows; a change asks for a full build.
SCHEMA_VERSION, EXTRACTOR_VERSION = 1, 1
CONFIG_NAME = ".quarry.json"
#: Files whose change makes a base index unfit for an overlay, and the most changes that an overlay takes (fixed values).
CONFIG_FILES = [CONFIG_NAME, ".gitignore"]
MAX_OVERLAY_FILES = 500
MIN_REFRESH_MS = 30_000
#: A file's symbols are numbered from its id times this.
PER_FILE = 1_000_000

FILES = ["id", "path", "mtime", "size", "hash", "language", "status", "error"]


@dataclass
class Config:
    root: str = "."
    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    max_file_size: int = 1_048_576
    minified_line_length: int = 500
    telemetry: bool | None = None


def load_config(root: str) -> Config:
    """The settings file of a work tree; without one, or where it can't be read, the defaults."""
    try:
        with open(os.path.join(root, CONFIG_NAME), encoding="utf-8") as f:
            said = json.load(f)
        return Config(**{k: v for k, v in said.items() if k in Config.__dataclass_fields__ and v is not None})
    except (OSError, ValueError, AttributeError):
        return Config()


def config_hash(config: Config) -> str:
    return hashlib.sha256(json.dumps(asdict(config), separators=(",", ":")).encode()).hexdigest()


def telemetry_on(env: str | None, config: Config) -> bool:
    """The environment decides, else the settings, else it is on."""
    if env is not None and env != "":
        return env.lower() not in ("0", "false", "off", "no")
    return True if config.telemetry is None else config.telemetry


def detect_workspace(start: str) -> dict:
    """Mode (main, worktree, standalone) and root of the nearest folder upwards that has a mark; git's wins over the settings file."""
    at = os.path.abspath(start)
    while True:
        git = os.path.join(at, ".git")
        if os.path.isdir(git):
            return {"mode": "main", "root": at, "git_dir": git}
        if os.path.isfile(git):
            with open(git, encoding="utf-8") as f:
                said = [x.partition(":")[2].strip() for x in f if x.startswith("gitdir:")]
            if not said:
                return {"mode": "main", "root": at, "git_dir": git}
            own = os.path.normpath(os.path.join(at, said[0]))
            try:
                with open(os.path.join(own, "commondir"), encoding="utf-8") as f:
                    common = os.path.normpath(os.path.join(own, f.read().strip()))
            except OSError:
                common = os.path.dirname(os.path.dirname(own))
            return {"mode": "worktree", "root": at, "git_dir": own, "common_dir": common, "parent_root": os.path.dirname(common)}
        if os.path.exists(os.path.join(at, CONFIG_NAME)):
            return {"mode": "standalone", "root": at}
        if os.path.dirname(at) == at:
            return {"mode": "standalone", "root": os.path.abspath(start)}
        at = os.path.dirname(at)


def build_mode(old: dict, new: dict, force: bool = False) -> str:
    """incremental if the old index has the same layout, extractors, settings and root; else full."""
    same = all(old.get(k) == new.get(k) for k in ("schema_version", "extractor_version", "config_hash", "root"))
    return "incremental" if old and same and not force else "full"


def extracted_tables(files: DataFrame) -> dict[str, DataFrame]:
    """files(id, path, mtime, size, hash, language, text) → files with status and error, symbols, edges, occurrences, relations.

    Extraction is lazy; publish or stage what is read more than once.
    """
    got = extract(files.select(F.col("id").alias("file_id"), "language", "text"))
    state = got.select(F.col("file_id").alias("id"), F.when(F.col("error").isNull(), "indexed").otherwise("error").alias("status"), "error")
    symbols = got.select("file_id", F.posexplode("symbols").alias("nth", "r")).select((F.col("file_id") * PER_FILE + F.col("nth")).alias("id"), "file_id", "r.*")
    relations = rows(got, "relations")
    return {"files": files.drop("text").join(state, "id").select(*FILES), "symbols": symbols, "edges": rows(got, "edges"), "occurrences": rows(got, "occurrences"), "relations": relations}


def resolved(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Edges with resolved_file_id, relations with id, source_id and target_id."""
    f, e = tables["files"].where("status = 'indexed'"), tables["edges"].drop("resolved_file_id")
    found = graph.resolve_paths(e.select("file_id", "source", "line").distinct(), f).where("resolved_file_id is not null")
    e = e.join(found, ["file_id", "source", "line"], "left")
    return with_relations(tables | {"edges": e}, tables["relations"])


def with_relations(tables: dict[str, DataFrame], relations: DataFrame) -> dict[str, DataFrame]:
    """tables with ``relations``, whose ends are looked up among the tables' symbols."""
    s = tables["symbols"]
    r = relations.select("file_id", "source_name", "kind", "target_name", "confidence", "line")
    owner = s.where("kind in ('class', 'interface', 'type', 'method')").groupBy(F.col("file_id").alias("s_file"), F.col("name").alias("s_name"), F.col("line").alias("s_line")).agg(F.min("id").alias("source_id"))
    r = r.join(owner, (F.col("file_id") == F.col("s_file")) & (F.col("source_name") == F.col("s_name")) & (F.col("line") == F.col("s_line"))).drop("s_file", "s_name", "s_line")
    r = r.withColumn("id", F.xxhash64("source_id", "kind", "target_name"))
    imports = tables["edges"].where(F.col("kind").isin("import", "dynamic-import", "require"))
    return tables | {"relations": graph.resolve_relations(r, s, imports)}


def build(spark: SparkSession, scanned: DataFrame, target: str, meta: dict, force: bool = False) -> dict:
    """Publishes the index of scanned(path, mtime, size, hash, language, text) below ``target``; gives mode and counts.

    ``meta`` holds config_hash and root, and what else is to be kept. An incremental build extracts only files that were
    added or changed, drops those that are gone, takes over a new mtime where the content is the same, and resolves imports
    and relations anew over all rows.
    """
    meta = {"schema_version": SCHEMA_VERSION, "extractor_version": EXTRACTOR_VERSION} | meta
    old = publish.meta(spark, target)
    mode = build_mode(old, meta, force)
    counts = {}
    if mode == "full":
        parts = extracted_tables(_numbered(spark, target, scanned, 0))
    else:
        stored = {t: publish.load(spark, target, t) for t in ("files", "symbols", "edges", "occurrences", "relations")}
        changes = _staged(spark, target, overlay.detect_changes(scanned, stored["files"]), "changes")
        counts = {r["action"]: r["n"] for r in overlay.change_summary(changes).collect()}
        todo = changes.where("action in ('add', 'update')").select("path")
        gone = stored["files"].join(changes.where("action in ('delete', 'update')").select("path"), "path", "left_semi").select("id")
        kept = publish.delete_files({"files": stored["files"], "symbols": stored["symbols"], "module_edges": stored["edges"], "occurrences": stored["occurrences"], "relation_edges": stored["relations"]}, gone)
        times = scanned.select("path", F.col("mtime").alias("now"))
        kept["files"] = kept["files"].join(times, "path").withColumn("mtime", F.col("now")).select(*FILES)
        first = (stored["files"].agg(F.max("id")).first()[0] or 0) + 1
        new = extracted_tables(_numbered(spark, target, scanned.join(todo, "path", "left_semi"), first))
        names = {"files": "files", "symbols": "symbols", "edges": "module_edges", "occurrences": "occurrences", "relations": "relation_edges"}
        parts = {t: kept[k].unionByName(new[t], allowMissingColumns=True) for t, k in names.items()}
    raw = {t: _staged(spark, target, df, t) for t, df in parts.items()}
    tables = resolved(raw)
    run = raw["files"].agg(F.count("*").alias("scanned"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "error").alias("errored"))
    run = run.withColumns({"mode": F.lit(mode), "status": F.when(F.col("errored") > 0, "partial").otherwise("ok")})
    tables["index_runs"] = run
    version = publish.publish(spark, target, tables, meta)
    _clear(spark, target)
    return {"mode": mode, "version": version, "changes": counts} | publish.load(spark, target, "index_runs").first().asDict()


def _staged(spark: SparkSession, target: str, df: DataFrame, name: str) -> DataFrame:
    at = f"{target}/_build/{name}"
    df.write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def _numbered(spark: SparkSession, target: str, files: DataFrame, first: int) -> DataFrame:
    """Files with ids from ``first`` on, written once so that the ids hold."""
    mark = F.monotonically_increasing_id()  # a partition's number and, in the lower 33 bits, the row's
    return _staged(spark, target, files.withColumn("id", first + F.shiftright(mark, 33) * (1 << 22) + mark.bitwiseAND((1 << 33) - 1)), "sources")


def _clear(spark: SparkSession, target: str) -> None:
    fs, path = publish._fs(spark, target)
    fs.delete(path(f"{target}/_build"), True)


def refresh(spark: SparkSession, scanned: DataFrame, target: str, meta: dict, last_ms: int, now_ms: int) -> dict | None:
    """build, unless the last one is under half a minute old; never called behind a reader's back."""
    return None if now_ms - last_ms < MIN_REFRESH_MS else build(spark, scanned, target, meta)


# --- overlays ----------------------------------------------------------------------------------------------------------


def overlay_gate(git_head: Column, clean: Column, schema: Column, extractor: Column, reachable: Column, config_changed: Column, n_changes: Column) -> Column:
    """Why a base index can't carry an overlay, by the first reason in this order; null: it can."""
    return (
        F.when(git_head.isNull() | (git_head == ""), "parent_git_head_missing")
        .when(~F.coalesce(clean, F.lit(False)), "parent_dirty_at_index_time")
        .when(~F.coalesce((schema == SCHEMA_VERSION) & (extractor == EXTRACTOR_VERSION), F.lit(False)), "schema_mismatch")
        .when(~reachable, "diff_base_unreachable")
        .when(config_changed, "config_diverged")
        .when(n_changes > MAX_OVERLAY_FILES, "too_many_changes")
    )


def build_overlay(spark: SparkSession, base: str, target: str, changes: DataFrame, reachable: bool, full, head: str | None = None) -> dict:
    """Publishes the overlay of changes(path, status, mtime, size, hash, language, text) on the index at ``base``.

    status D is a removal; a change whose text is null has gone since and is one, too; one without a language is skipped.
    Where a gate forbids it, ``full()`` gives scanned files and meta, and a full index is published at ``target`` instead.
    """
    meta = publish.meta(spark, base)
    seen = changes.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("path").isin(CONFIG_FILES)), F.lit(False)).alias("config")).first()
    reason = "parent_index_missing"
    if meta:
        one = spark.range(1).select(overlay_gate(*[F.lit(meta.get(k)) for k in ("git_head", "clean_at_index_time", "schema_version", "extractor_version")], F.lit(reachable), F.lit(seen["config"]), F.lit(seen["n"])).alias("reason"))
        reason = one.first()["reason"]
    if reason:
        scanned, own = full()
        return build(spark, scanned, target, own | {"index_mode": "worktree-isolated", "degraded_reason": reason}, force=True) | {"kind": "isolated", "reason": reason}
    gone = (F.col("status") == "D") | (F.col("text").isNull() & F.col("language").isNotNull())
    deleted = changes.where(gone).select("path")
    new = changes.where(~gone & F.col("language").isNotNull()).select("path", "mtime", "size", "hash", "language", "text")
    raw = {t: _staged(spark, target, df, t) for t, df in extracted_tables(_numbered(spark, target, new, 1)).items()}
    # targets by path: of the overlay's own files, else of the base's that are left
    files = raw["files"].select((-F.col("id")).alias("id"), "path").unionByName(publish.load(spark, base, "files").where("status = 'indexed'").join(overlay.masked_paths(raw["files"], deleted), "path", "left_anti").select("id", "path"))
    raw["edges"] = raw["edges"].join(_through(raw["edges"], files), ["file_id", "source", "line"], "left")
    raw["deleted"] = deleted
    version = publish.publish(spark, target, raw, {"index_mode": "overlay-on-parent", "parent": base, "parent_git_head": meta["git_head"], "git_head": head})
    _clear(spark, target)
    return {"kind": "overlay", "version": version, "mode": "overlay-on-parent", "indexed": publish.load(spark, target, "files").where("status = 'indexed'").count()}


def _through(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, source, line, target_path) of the overlay's imports among files(id, path), where its own ids are negated."""
    e = edges.select((-F.col("file_id")).alias("file_id"), "source", "line").distinct()
    got = graph.resolve_paths(e, files).where("resolved_file_id is not null").join(files.select(F.col("id").alias("resolved_file_id"), F.col("path").alias("target_path")), "resolved_file_id")
    return got.select((-F.col("file_id")).alias("file_id"), "source", "line", "target_path")


def merged(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of the overlay at ``target`` over its base: the overlay's ids are negated, base files that it changes or removes are hidden."""
    base = publish.meta(spark, target)["parent"]
    b = {t: publish.load(spark, base, t) for t in ("files", "symbols", "edges", "occurrences", "relations")}
    o = {t: publish.load(spark, target, t) for t in (*b, "deleted")}
    files = overlay.merge_files(b["files"], o["files"], o["deleted"])
    child = lambda t, own: overlay.merge_children(b[t], b["files"], own, o["files"], o["deleted"])
    symbols = child("symbols", o["symbols"].withColumn("id", -F.col("id")))
    paths = files.select(F.col("id").alias("resolved_file_id"), F.col("path").alias("target_path"))
    own = o["edges"].join(paths, "target_path", "left").select(*b["edges"].columns)
    edges = overlay.remap(child("edges", own.withColumn("resolved_file_id", F.lit(None).cast("long"))), b["files"], o["files"], o["deleted"]).where("file_id >= 0")
    edges = edges.unionByName(own.withColumn("file_id", -F.col("file_id")))
    tables = {"files": files, "symbols": symbols, "edges": edges, "occurrences": child("occurrences", o["occurrences"])}
    ends = {c: F.lit(None).cast("long") for c in ("source_id", "id", "target_id")}
    return with_relations(tables, child("relations", o["relations"].withColumns(ends).select(*b["relations"].columns)))
