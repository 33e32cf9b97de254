"""Importers, bounded closures, callers, relations, path resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import normalize_path
from quarry.operators.lookup import best_rank
from quarry.operators.spans import enclosing

JS_TWINS = {".js": ".ts", ".jsx": ".tsx", ".mjs": ".mts", ".cjs": ".cts"}
#: Tried in this order after each base (fixed values: results depend on the order).
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".cs", ".css", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def importers(edges: DataFrame, source: str, resolved_file_id: int | None = None) -> DataFrame:
    """Files that import ``source``: by resolved file, else by equal specifier, else by a specifier that holds it."""
    kind = F.col("kind").isin("import", "dynamic-import", "require")
    rank = F.when(kind & (F.col("source") == source), 1).when(kind & F.col("source").contains(source), 2)
    if resolved_file_id is not None:
        rank = F.when(F.col("resolved_file_id") == resolved_file_id, 0).otherwise(rank)
    e = best_rank(edges, rank)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("name", F.when(F.col("is_star"), "*")).alias("name")))), lambda x: x["name"]), ",")
    return e.groupBy("file_id").agg(names.alias("names"), F.every("is_type").alias("is_type"), F.some("is_default").alias("is_default"), F.some("is_star").alias("is_star"), F.min_by("source", "line").alias("source"), F.min("line").alias("line"))


def import_summary(edges: DataFrame) -> DataFrame:
    """Per file and source: the names and whether all are types."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]), ",")
    return edges.groupBy("file_id", F.coalesce("source", F.lit("<unknown>")).alias("source")).agg(names.alias("names"), F.every("is_type").alias("is_type"), F.count("*").alias("n"))


def bounded_closure(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes reached over edges(src, dst) from seeds(node) within depth steps, at their shortest depth.

    A level is one join of the frontier; nodes seen before are removed by an anti join, so cycles end and a hub is
    expanded once.
    """
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        nxt = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = nxt.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def call_edges(occurrences: DataFrame, symbols: DataFrame, ref_kinds: list[str] | None = None) -> DataFrame:
    """(caller_id, caller, callee, sites) for all names at once; a name's own lines and body are no calls."""
    o = occurrences.where(F.col("ref_kind").isin(ref_kinds)) if ref_kinds else occurrences
    defs = symbols.groupBy("name").agg(F.min(F.struct("file_id", "line", "end_line", "id")).alias("d")).select(F.col("name").alias("d_name"), "d")
    used = o.join(defs, F.col("name") == F.col("d_name"))
    own = (F.col("file_id") == F.col("d.file_id")) & F.col("line").between(F.col("d.line"), F.coalesce("d.end_line", "d.line"))
    e = enclosing(used.where(~own).select("file_id", "line", "col", "name", F.col("d.id").alias("target_id")), symbols)
    return e.where("enclosing_id <> target_id").groupBy(F.col("enclosing_id").alias("caller_id"), F.col("enclosing_name").alias("caller"), F.col("name").alias("callee")).agg(F.count("*").alias("sites"))


def callers(calls: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """(caller, depth) over call_edges, at the shortest depth; depth 1 to 3."""
    e = calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst")).distinct()
    seed = calls.sparkSession.createDataFrame([(name,)], "node string")
    return bounded_closure(e, seed, min(max(depth, 1), 3)).where("depth > 0").select(F.col("node").alias("caller"), "depth")


def relations(rel: DataFrame, name: str, direction: str = "both", depth: int = 1) -> DataFrame:
    """rel(source_name, target_name): rows met from ``name``; each name is expanded once, and ``both`` doesn't go on."""
    up = rel.select(F.col("source_name").alias("src"), F.col("target_name").alias("dst"))
    down = rel.select(F.col("target_name").alias("src"), F.col("source_name").alias("dst"))
    seed = rel.sparkSession.createDataFrame([(name,)], "node string")
    if direction == "both":
        return up.where(F.col("src") == name).withColumn("direction", F.lit("parent")).unionByName(down.where(F.col("src") == name).withColumn("direction", F.lit("child")))
    e = up if direction == "parents" else down
    nodes = bounded_closure(e, seed, min(max(depth, 1), 5) - 1)
    return e.join(nodes, F.col("src") == F.col("node")).select("src", "dst", "depth").distinct()


def resolve_paths(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges(file_id, source, line) whose source begins with a dot, with resolved_file_id of the first candidate path that exists."""
    src = files.select(F.col("id").alias("file_id"), F.regexp_extract("path", "^(.*)/", 1).alias("dir"))
    e = edges.where(F.col("source").startswith(".")).join(src, "file_id")
    base = normalize_path(F.concat_ws("/", "dir", "source"))
    ext = F.regexp_extract("source", r"(\.(?:js|jsx|mjs|cjs))$", 1)
    bare = F.expr("substring(base, 1, length(base) - length(ext))")
    twin = F.create_map(*[F.lit(x) for kv in JS_TWINS.items() for x in kv])
    e = e.withColumn("base", base).withColumn("ext", ext).withColumn("bases", F.when(F.col("ext") == "", F.array("base")).otherwise(F.array(bare, F.concat(bare, F.element_at(twin, F.col("ext"))), F.col("base"))))
    tried = e.select("file_id", "source", "line", F.posexplode("bases").alias("v", "b")).select("file_id", "source", "line", "v", "b", F.posexplode(F.array(*[F.lit(s) for s in SUFFIXES])).alias("s", "suffix"))
    hit = tried.withColumn("candidate", F.concat("b", "suffix")).join(files.select(F.col("id").alias("hit_id"), F.col("path").alias("candidate")), "candidate")
    best = hit.groupBy("file_id", "source", "line").agg(F.min_by("hit_id", F.struct("v", "s", "hit_id")).alias("resolved_file_id"))
    return e.select("file_id", "source", "line").join(best, ["file_id", "source", "line"], "left")


def resolve_relations(rel: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """rel(id, file_id, target_name[, kind]) with target_id; the lowest id where several fit.

    A type of the same file, else of the file that the name is imported from (the first import of a local name wins). ``ns.X``
    is the type X of the file that a star import binds to ns. A relation of kind ``overrides_method`` names ``Parent.method``:
    that class's method in the same file, else in the file that the class is imported from and is a type of.
    """
    top = symbols.where(F.col("kind").isin("class", "interface", "type") & (F.coalesce("scope", F.lit("")) == "")).groupBy(F.col("file_id").alias("t_file"), F.col("name").alias("t_name")).agg(F.min("id").alias("t_id"))
    methods = symbols.where("kind = 'method' and coalesce(scope, '') <> ''").groupBy(F.col("file_id").alias("m_file"), F.col("scope").alias("m_scope"), F.col("name").alias("m_name")).agg(F.min("id").alias("m_id"))
    alias = F.col("alias") if "alias" in imports.columns else F.lit(None).cast("string")
    imp = imports.select("file_id", alias.alias("alias"), "name", "is_star", "resolved_file_id", "line")
    star = F.col("is_star") & F.col("alias").isNotNull()
    imp = imp.select(F.col("file_id").alias("i_file"), F.coalesce("alias", "name").alias("local"), star.alias("i_star"), "resolved_file_id", F.coalesce("name", "alias").alias("i_name"), "line").where("local is not null")
    # of star imports the last binds the name, of others the first
    order = F.when(F.col("i_star"), -F.col("line")).otherwise(F.col("line"))
    imp = imp.groupBy("i_file", "local", "i_star").agg(F.min_by(F.struct("resolved_file_id", "i_name"), order).alias("to")).select("i_file", "local", "i_star", "to.*")
    has_kind = "kind" in rel.columns
    override = F.coalesce(F.col("kind") == "overrides_method", F.lit(False)) if has_kind else F.lit(False)
    parts = F.split("target_name", r"\.")
    dotted = F.size(parts) == 2
    bare = F.col("target_name").rlike(r"^[A-Za-z_$][\w$]*$")
    r = rel.select("id", "file_id", "target_name", override.alias("o"), F.when(dotted & (parts[0] != ""), parts[0]).alias("first"), F.when(dotted, parts[1]).alias("tail"), bare.alias("bare"))
    near = r.where("not o").join(top, (F.col("file_id") == F.col("t_file")) & (F.col("target_name") == F.col("t_name"))).select("id", F.col("t_id").alias("near_id"))
    mine = r.where("o and first is not null").join(methods, (F.col("file_id") == F.col("m_file")) & (F.col("first") == F.col("m_scope")) & (F.col("tail") == F.col("m_name"))).select("id", F.col("m_id").alias("near_id"))
    # through an import: what stands there, and under which name it is looked up
    local = F.when(F.col("o") | F.col("first").isNotNull(), F.col("first")).when(F.col("bare"), F.col("target_name"))
    through = r.withColumn("l", local).join(imp, (F.col("file_id") == F.col("i_file")) & (F.col("l") == F.col("local")) & (F.col("i_star") == (~F.col("o") & F.col("first").isNotNull())))
    looked = F.when(F.col("i_star"), F.col("tail")).otherwise(F.col("i_name"))
    through = through.withColumn("looked", looked).join(top, (F.col("resolved_file_id") == F.col("t_file")) & (F.col("looked") == F.col("t_name")))
    far = through.where("not o").select("id", F.col("t_id").alias("far_id"))
    theirs = through.where("o").join(methods, (F.col("resolved_file_id") == F.col("m_file")) & (F.col("looked") == F.col("m_scope")) & (F.col("tail") == F.col("m_name"))).select("id", F.col("m_id").alias("far_id"))
    return rel.join(near.union(mine), "id", "left").join(far.union(theirs), "id", "left").select(*rel.columns, F.coalesce("near_id", "far_id").alias("target_id"))


def relation_rows(rel: DataFrame, symbols: DataFrame, files: DataFrame, name: str, by: str = "source", kind: str | None = None) -> DataFrame:
    """rel(id, kind, source_id, target_id, target_name, line) with the symbols and files of both ends, by path and line.

    ``by`` source: declared by ``name``. ``by`` target: of it; where the target isn't resolved, its name counts.
    """
    r = rel.where(F.col("kind") == kind) if kind else rel

    def side(s: str) -> DataFrame:
        f = files.select(F.col("id").alias(f"{s}_f"), F.col("path").alias(f"{s}_file"))
        return symbols.select(F.col("id").alias(f"{s}_sid"), F.col("name").alias(f"{s}_symbol"), F.col("kind").alias(f"{s}_kind"), F.col("line").alias(f"{s}_line"), F.col("file_id").alias(f"{s}_fid")).join(f, F.col(f"{s}_fid") == F.col(f"{s}_f")).drop(f"{s}_f", f"{s}_fid")

    source, target = side("source"), side("target")
    if by == "source":
        source = source.where(F.col("source_symbol") == name)
    j = r.join(source, F.col("source_id") == F.col("source_sid")).join(target, F.col("target_id") == F.col("target_sid"), "left").drop("source_sid", "target_sid")
    if by == "target":
        j = j.where(F.coalesce("target_symbol", "target_name") == name)
    return j.orderBy("source_file", "line", "id")


def call_sites(occurrences: DataFrame, symbols: DataFrame, name: str, limit: int = 30) -> DataFrame:
    """(caller_id, caller, lines) of the calls of a name, most sites first; lines ascending, each once per site."""
    o = occurrences.where((F.col("name") == name) & (F.col("ref_kind") == "call"))
    e = enclosing(o, symbols).where(F.col("enclosing_name") != name)
    got = e.groupBy(F.col("enclosing_id").alias("caller_id"), F.col("enclosing_name").alias("caller")).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return got.orderBy(F.desc(F.size("lines")), "caller_id").limit(limit)


def top_callees(calls: DataFrame, limit: int = 3) -> DataFrame:
    """Names by the number of their callers over call_edges."""
    return calls.groupBy("callee").agg(F.countDistinct("caller_id").alias("callers")).orderBy(F.desc("callers"), "callee").limit(limit)
