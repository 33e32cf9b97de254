"""More queries: names and formats, relations and call sites, limits, documents, extraction, builds and overlays, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph, health, lookup, overlay, policy, search, source, spans, telemetry
from quarry.plans import views as V
from quarry.registry import _CALLS, _HITS, _PCT, _SCAN, _STORED, _UNUSED, DAYS_10, _delta, _parts, _scored, query
from quarry.scratch import scratch

# --- names, docs, formats ------------------------------------------------------------------------------------------------


@query("select id, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '') as base, regexp_extract(path, '^(.*)/', 1) as dir from files_v")
def path_parts(spark, d):
    return V.files(spark, d).select("id", T.basename("path").alias("base"), T.dirname("path").alias("dir"))


@query("""select id, 'Does ' || name || ' once.' as summary, '/** Does ' || name || ' once.' as first_line, line % 2 = 0 as has_returns from sym_v""")
def doc_summaries(spark, d):
    more = F.when(F.col("line") % 2 == 0, "\n * @returns {T} it").otherwise("\n * no @returned tag")
    s = V.symbols(spark, d).withColumn("doc", F.concat(F.lit("/** Does "), "name", F.lit(" once."), more, F.lit("\n */")))
    return s.select("id", T.doc_summary("doc").alias("summary"), T.first_doc_line("doc").alias("first_line"), T.has_returns("doc").alias("has_returns"))


@query("""select name, array_to_string(list_filter(regexp_split_to_array(regexp_replace(name, '([A-Z])', ' \\1', 'g'), '[_ -]+'), lambda x: x <> ''), '|') as parts from (
  select distinct name || case line % 3 when 0 then '_' when 1 then '-of' else '' end || 'NewPart' as name from sym_v)""")
def name_parts(spark, d):
    more = F.when(F.col("line") % 3 == 0, "_").when(F.col("line") % 3 == 1, "-of").otherwise("")
    s = V.symbols(spark, d).select(F.concat("name", more, F.lit("NewPart")).alias("name")).distinct()
    return s.select("name", F.array_join(T.tokens_of("name"), "|").alias("parts"))


@query("""
, n as (select distinct (['', 'use', 'I'])[line % 3 + 1] || case when line % 2 = 0 then upper(name) else name end as name from sym_v)
select name, regexp_matches(name, '^use[A-Z]') as hook, regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') as component, regexp_matches(name, '^[A-Z][A-Z0-9_]*$') as constant,
  regexp_matches(name, '^[A-Z]') as exported, regexp_matches(name, '^I[A-Z]') as interface from n""")
def name_traits(spark, d):
    head = F.element_at(F.array(F.lit(""), F.lit("use"), F.lit("I")), (F.col("line") % 3 + 1).cast("int"))
    s = V.symbols(spark, d).select(F.concat(head, F.when(F.col("line") % 2 == 0, F.upper("name")).otherwise(F.col("name"))).alias("name")).distinct()
    return s.select("name", T.name_traits("name").alias("t")).select("name", "t.*")


@query("select id, case id % 5 when 2 then 'C:/w/' || path when 4 then '/w2/' || path else path end as rel from files_v")
def relative_paths(spark, d):
    p, k = F.col("path"), F.col("id") % 5
    raw = F.when(k == 0, F.concat(F.lit("/w/"), p)).when(k == 1, p).when(k == 2, F.translate(F.concat(F.lit("C:/w/"), p), "/", "\\")).when(k == 3, F.concat(F.lit("/other/../w/./"), p)).otherwise(F.concat(F.lit("/w2/"), p))
    return V.files(spark, d).select("id", T.relative_to(raw, "/w").alias("rel"))


@query("select id, path || '|' || path || '.new|dir/f.ts' as changed from files_v")
def porcelain_status(spark, d):
    said = F.concat(F.lit(" M "), "path", F.lit("\n?? new.ts\nR  old.ts -> "), "path", F.lit(".new\nA  dir\\f.ts\nM\n M "), "path")
    return V.files(spark, d).select("id", F.array_join(T.porcelain_paths(said), "|").alias("changed"))


@query("select id, unnest(['M', 'D', 'A', 'D', 'M']) as status, unnest([path, 'old', path || '.new', 'gone', 'odd']) as path from files_v")
def name_status(spark, d):
    said = F.concat(F.lit("M\0"), "path", F.lit("\0R086\0old\0"), "path", F.lit(".new\0D\0gone\0T\0odd\0A"))
    return V.files(spark, d).select("id", F.inline(T.name_status(said)))


@query("""
select id, case when latency_us < 1000 then latency_us::varchar || 'us' else printf('%.1f', round(latency_us / 1000, 1)) || 'ms' end as us, case when latency_us < 1000 then '-' else latency_us || '.0ms' end as ms,
  case when id % 3 = 0 then '"' || id || ',' || repeat('"', 3) when id % 3 = 1 then id::varchar else '' end as csv,
  case when id < 1024 then id || ' B' when id < 1048576 then printf('%.1f', round(id / 1024, 1)) || ' KB' else printf('%.1f', round(id / 1048576, 1)) || ' MB' end as bytes, id || '.0%' as share
from (select id, floor(latency_us * 16)::bigint as latency_us from tel_v)""")
def formats(spark, d):
    t = V.telemetry(spark, d).select("id", F.floor(F.col("latency_us") * 16).alias("v"))
    csv = F.when(F.col("id") % 3 == 0, F.concat(F.col("id").cast("string"), F.lit(',"'))).when(F.col("id") % 3 == 1, F.col("id").cast("string"))
    ms = F.when(F.col("v") >= 1000, F.col("v"))
    return t.select("id", T.format_us("v").alias("us"), T.format_ms(ms).alias("ms"), T.csv_escape(csv).alias("csv"), T.format_bytes("id").alias("bytes"), T.format_percent(F.col("id") / 100).alias("share"))


@query("select event_id, substr(sha256('{\"a\":[1,{\"x\":null,\"y\":true}],\"k\":' || json_extract(props, '$.k') || ',\"z\":' || event_id || '}'), 1, 16) as hash from events")
def input_hashes(spark, d):
    from quarry.sources.documents import input_hash

    text = F.concat(F.lit('{"z": '), F.col("event_id").cast("string"), F.lit('.0, "k" : '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, {"y": true, "x": null}]}'))
    return V.table(spark, d, "events").select("event_id", input_hash(text).alias("hash"))


@query("""
, n as (select name, count(*) as n from occ_v group by 1)
select s.file_id, case when max(n) <= 2 then 'low' when max(n) <= 10 then 'medium' else 'high' end as risk from sym_v s join n using (name) group by 1""")
def risk_by_file(spark, d):
    n = V.occurrences(spark, d).groupBy("name").agg(F.count("*").alias("n"))
    s = V.symbols(spark, d).join(n, "name").select("file_id", T.bucket_risk("n").alias("risk"))
    return policy.risk_max(s, ["file_id"])


@query(f"select action, count(*) as n from (select case when b.path is null then 'add' when a.path is null then 'delete' when a.mtime = b.mtime and a.size = b.size then 'unchanged' when a.hash = b.hash then 'hash_only' else 'update' end as action from ({_SCAN}) a full join ({_STORED}) b on a.path = b.path) group by 1")
def change_counts(spark, d):
    f = V.files(spark, d)
    scan = f.where("id % 13 <> 0").selectExpr("path", "id % 7 as mtime", "size", "md5(path) as hash")
    stored = f.where("id % 11 <> 0").selectExpr("path", "case when id % 5 = 0 then -1 else id % 7 end as mtime", "size", "case when id % 20 = 0 then 'x' else md5(path) end as hash")
    return overlay.change_summary(overlay.detect_changes(scan, stored))


# --- search --------------------------------------------------------------------------------------------------------------


@query(f", names as (select distinct name as s from sym_v), {_scored('The', 'by_the', 'names')} select s as name, round(score * 0.7, 6) as score from by_the where score >= 0.4 order by by_the.score desc, s limit 5")
def suggestions_by_parts(spark, d):
    # no name holds the letters of the whole query; one of its parts is a name
    return search.suggestions(V.symbols(spark, d), "Qqx7The_qq").select("name", F.round("score", 6).alias("score"))


@query(f", names as (select distinct p_name as s from part), {_scored('Red', 'by_red', 'names')} select null::bigint as id, s as name, round(score * 0.7, 6) as score, true as suggested from by_red where score >= 0.4 order by by_red.score desc, s limit 5")
def search_empty(spark, d):
    return search.search_or_suggest(_parts(spark, d), "Zz9Red_qx").select("id", "name", F.round("score", 6).alias("score"), "suggested")


# --- relations, calls, limits --------------------------------------------------------------------------------------------

_RELATED = """
, rel_v as (
  select id * 10 + line % 4 as id, id as source_id, file_id, line, (['extends_class', 'implements', 'extends_interface', 'overrides_method'])[line % 4 + 1] as kind,
    case when line % 5 = 0 then null else lead(id) over (partition by file_id order by line) end as target_id, case when line % 5 = 0 then 'The' else 'Other' end as target_name from sym_v),
row_v as (
  select r.id, r.kind, r.target_name, r.line, r.source_id, a.name as source_symbol, a.kind as source_kind, a.line as source_line, f.path as source_file, r.target_id, b.name as target_symbol, b.kind as target_kind, b.line as target_line, g.path as target_file
  from rel_v r join sym_v a on a.id = r.source_id join files_v f on f.id = a.file_id left join sym_v b on b.id = r.target_id left join files_v g on g.id = b.file_id)"""


def _related(spark, d) -> DataFrame:
    from pyspark.sql import Window

    kind = F.element_at(F.array(*[F.lit(x) for x in ("extends_class", "implements", "extends_interface", "overrides_method")]), (F.col("line") % 4 + 1).cast("int"))
    after = F.lead("id").over(Window.partitionBy("file_id").orderBy("line"))
    s = V.symbols(spark, d).select(F.col("id").alias("source_id"), "file_id", "line", kind.alias("kind"), F.when(F.col("line") % 5 != 0, after).alias("target_id"), F.when(F.col("line") % 5 == 0, "The").otherwise("Other").alias("target_name"))
    return s.withColumn("id", F.col("source_id") * 10 + F.col("line") % 4)


_ROW = ["id", "kind", "target_name", "line", "source_id", "source_symbol", "source_kind", "source_line", "source_file", "target_id", "target_symbol", "target_kind", "target_line", "target_file"]


@query(_RELATED + " select * from row_v where source_symbol = 'The'")
def relation_rows_by_source(spark, d):
    return graph.relation_rows(_related(spark, d).drop("file_id"), V.symbols(spark, d), V.files(spark, d), "The").select(*_ROW)


@query(_RELATED + " select * from row_v where kind = 'implements' and (target_symbol = 'The' or (target_symbol is null and target_name = 'The'))")
def relation_rows_by_target(spark, d):
    return graph.relation_rows(_related(spark, d).drop("file_id"), V.symbols(spark, d), V.files(spark, d), "The", "target", "implements").select(*_ROW)


@query(_RELATED + " select count(*) as n, count(distinct source_id) as sources from rel_v where target_id is null")
def unresolved_relations(spark, d):
    return lookup.unresolved(_related(spark, d)).agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


# classes, methods and imports of three shapes: by name, under an alias, and through a namespace
_TYPED = """
, code_v as (
  select doc_id * 10 + 1 as id, doc_id as file_id, 'T' || doc_id as name, 'class' as kind, null as scope from documents union all
  select doc_id * 10 + 2, doc_id, 'run', 'method', 'T' || doc_id from documents union all
  select doc_id * 10 + 3, doc_id, 'T' || doc_id, 'class', 'Outer' from documents),
to_v as (select doc_id as file_id, doc_id // 2 as other, doc_id % 6 as k from documents),
want_v as (
  select file_id * 10 as id, file_id, case k when 0 then 'T' || other when 1 then 'Local' when 2 then 'ns.T' || other when 3 then 'T' || file_id when 4 then 'Local.run' else 'f(x).T' || other end as target_name,
    case k when 0 then other * 10 + 1 when 1 then other * 10 + 1 when 2 then other * 10 + 1 when 3 then file_id * 10 + 1 when 4 then other * 10 + 2 end as t from to_v)"""


def _typed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("f"))
    own, other, k = F.concat(F.lit("T"), F.col("f").cast("string")), F.floor(F.col("f") / 2), F.col("f") % 6
    named = F.concat(F.lit("T"), other.cast("string"))
    row = lambda n, name, kind, scope: F.struct((F.col("f") * 10 + n).alias("id"), F.col("f").alias("file_id"), name.alias("name"), F.lit(kind).alias("kind"), scope.cast("string").alias("scope"))
    symbols = docs.select(F.inline(F.array(row(1, own, "class", F.lit(None)), row(2, F.lit("run"), "method", own), row(3, own, "class", F.lit("Outer")))))
    imp = lambda name, alias, star, line: F.struct(F.col("f").alias("file_id"), name.cast("string").alias("name"), alias.cast("string").alias("alias"), F.lit(star).alias("is_star"), other.alias("resolved_file_id"), F.lit(line).alias("line"))
    imports = docs.select(F.inline(F.array(imp(named, F.lit(None), False, 1), imp(named, F.lit("Local"), False, 2), imp(F.lit(None), F.lit("ns"), True, 3), imp(F.lit("Gone"), F.lit("Local"), False, 4))))
    target = F.when(k == 0, named).when(k == 1, "Local").when(k == 2, F.concat(F.lit("ns."), named)).when(k == 3, own).when(k == 4, "Local.run").otherwise(F.concat(F.lit("f(x)."), named))
    rel = docs.select((F.col("f") * 10).alias("id"), F.col("f").alias("file_id"), target.alias("target_name"), F.when(k == 4, "overrides_method").otherwise("extends_class").alias("kind"))
    return rel, symbols, imports


@query(_TYPED + " select w.id, target_name, code_v.id as target_id from want_v w left join code_v on code_v.id = w.t")
def relation_targets(spark, d):
    rel, symbols, imports = _typed(spark, d)
    return graph.resolve_relations(rel, symbols, imports).select("id", "target_name", "target_id")


_SITES = """
, site_v as (
  select enclosing_id as caller_id, caller, array_to_string(list_sort(list(line)), ',') as lines, count(*) as n from (
    select o.line, s.id as enclosing_id, s.name as caller, row_number() over (partition by o.file_id, o.line, o.col order by s.end_line - s.line, s.id) as k
    from occ_v o join sym_v s on s.file_id = o.file_id and o.line between s.line and s.end_line where o.name = 'the' and o.ref_kind = 'call') where k = 1 and caller <> 'the' group by 1, 2)"""


@query(_SITES + " select caller_id, caller, lines from site_v order by n desc, caller_id limit 30")
def call_sites(spark, d):
    return graph.call_sites(V.occurrences(spark, d), V.symbols(spark, d), "the").withColumn("lines", F.array_join("lines", ","))


@query(_CALLS + " select callee, count(distinct caller_id) as callers from calls group by 1 order by 2 desc, 1 limit 3")
def top_symbols(spark, d):
    return graph.top_callees(graph.call_edges(V.occurrences(spark, d), V.symbols(spark, d), ["call"]))


@query("select coalesce(ref_kind, 'unknown') as ref_kind, count(*) as n from occ_v where name = 'the' group by 1")
def ref_kinds(spark, d):
    return health.ref_kind_histogram(V.occurrences(spark, d), "the")


@query("""
, c as (select f.path, s.kind, s.scope from sym_v s join files_v f on f.id = s.file_id where s.name = 'Of')
select coalesce(string_agg(distinct path, ',' order by path), '') as paths, coalesce(string_agg(distinct kind, ',' order by kind), '') as kinds, coalesce(string_agg(distinct scope, ',' order by scope), '') as scopes from c""")
def clarify_disambiguators(spark, d):
    return health.disambiguators(health.clarify(V.symbols(spark, d), V.files(spark, d), V.imports(spark, d), "Of"))


@query(_RELATED + """
select s.id, kind, direction, n from (select id from sym_v where name = 'Of') s join (
  select source_id as r, kind, 'parent' as direction, count(*) as n from rel_v group by 1, 2 union all select target_id, kind, 'child', count(*) from rel_v group by 1, 2) on r = s.id""")
def clarify_relations(spark, d):
    c = health.clarify(V.symbols(spark, d), V.files(spark, d), V.imports(spark, d), "Of")
    return health.relation_summary(c, _related(spark, d))


@query("""
, n as (select resolved_file_id as r, count(distinct file_id) as n from imp_v where name = 'Of' group by 1)
select s.id, coalesce(n, 0)::bigint as importer_count from sym_v s join files_v f on f.id = s.file_id left join n on r = s.file_id where s.name = 'Of' order by 2 desc, f.path, s.line, s.id limit 1""")
def clarify_pick(spark, d):
    return health.pick(health.clarify(V.symbols(spark, d), V.files(spark, d), V.imports(spark, d), "Of")).select("id", "importer_count")


@query(_RELATED + """
, sites as (
  select file_id, line, 'definition' as role from sym_v where name = 'The' union
  select file_id, line, 'caller' from occ_v where name = 'The' and ref_kind in ('call', 'read', 'write', 'type-ref') union
  select file_id, line, 'importer' from imp_v where name = 'The' union
  select file_id, line, case kind when 'implements' then 'implementer' when 'overrides_method' then 'override' else 'subclass' end from rel_v where target_name = 'The')
select file_id, string_agg(distinct role, ',' order by role) as roles, array_to_string(list_sort(list(distinct line)), ',') as lines, count(*) as edits from sites group by 1""")
def refactor_sites(spark, d):
    return health.refactor_preview(V.symbols(spark, d), V.occurrences(spark, d), V.imports(spark, d), "The", _related(spark, d))


@query(_UNUSED.format(a="", b="") + " order by file_id, name, line limit 100")
def unused_exports_first(spark, d):
    u = health.unused_exports(V.exports(spark, d), V.imports(spark, d), V.occurrences(spark, d))
    return u.select("file_id", "name", "line").orderBy("file_id", "name", "line").limit(100)


@query("""select s.id, s.name from sym_v s where scope is null
and not exists (select 1 from exp_v e where e.file_id = s.file_id and e.name = s.name)
and not exists (select 1 from occ_v o where o.file_id = s.file_id and o.name = s.name and o.line <> s.line) order by id limit 100""")
def private_dead_first(spark, d):
    return health.private_dead(V.symbols(spark, d), V.exports(spark, d), V.occurrences(spark, d)).select("id", "name").orderBy("id").limit(100)


@query("""
, e as (select file_id, line, kind, case when line % 3 = 0 then null else name end as name, is_default, line % 2 = 0 as is_star from edges_v where kind in ('export', 're-export'))
select file_id, coalesce(string_agg(coalesce(name, case when is_default then '<default>' when is_star then '*' end), ',' order by line), '') as exports from e group by 1""")
def export_names(spark, d):
    e = V.edges(spark, d).where("kind in ('export', 're-export')").withColumns({"name": F.when(F.col("line") % 3 != 0, F.col("name")), "is_star": F.col("line") % 2 == 0})
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", spans.export_name(e).alias("v")))), lambda x: x["v"]), ",")
    return e.groupBy("file_id").agg(names.alias("exports"))


@query("""
, asked as (select unnest(['SRC1/EN/d1.txt', 'src0/en/d0.txt', 'nowhere.txt', 'src2/de/d2.txt', 'src0/de/d5.txt']) as path),
f as (select a.path, v.id, v.language from asked a left join files_v v on lower(v.path) = lower(a.path))
select path, id is null as missing, language, coalesce((select string_agg(name, ',' order by line) from edges_v e where e.file_id = f.id and kind in ('export', 're-export')), '') as exports,
  coalesce((select string_agg(source, ',' order by line) from edges_v e where e.file_id = f.id and kind in ('import', 'dynamic-import', 'require')), '') as imports,
  coalesce((select string_agg(name, ',' order by line) from sym_v s where s.file_id = f.id), '') as symbols from f""")
def file_outlines(spark, d):
    asked = ["SRC1/EN/d1.txt", "src0/en/d0.txt", "nowhere.txt", "src2/de/d2.txt", "src0/de/d5.txt"]
    return spans.file_outlines(V.files(spark, d), V.symbols(spark, d), V.edges(spark, d), asked)


@query("""
, e as (select doc_id as id, doc_id as file_id, strpos(text, 'the ') as pos, text from documents where strpos(text, 'the ') > 0),
l as (select id, file_id, length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')) + 1 as line from e),
s as (select l.id, s.id as symbol_id, s.name, s.line, s.end_line, row_number() over (partition by l.id order by s.line, s.id) as k from l join sym_v s on s.file_id = l.file_id and s.scope is null and l.line between s.line and s.end_line)
select id, symbol_id, name, line, end_line, symbol_id in (select x.id from sym_v x join exp_v e on e.file_id = x.file_id and e.name = x.name) as exported from s where k = 1""")
def symbol_at_edit(spark, d):
    t = V.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    edits = t.select(F.col("file_id").alias("id"), "file_id", F.lit("the ").alias("old"))
    return source.symbol_at_edit(edits, t, V.symbols(spark, d), V.exports(spark, d))


# --- status, telemetry, policy ---------------------------------------------------------------------------------------------

_RUNS = "(select id, case when id % 3 = 0 then 'full' else 'incremental' end as mode, case when id % 7 = 0 then 'partial' else 'ok' end as status from pack_v)"


@query(f"""select count(*) as total, count(*) filter (status = 'indexed') as indexed, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'error') as errored,
case when count(*) filter (status = 'error') > 0 then 'partial' else 'ok' end as health, (select max_by(mode, id) from {_RUNS}) as run_mode, (select max_by(status, id) from {_RUNS}) as run_status from files_v""")
def index_status(spark, d):
    runs = V.packs(spark, d).selectExpr("id", "case when id % 3 = 0 then 'full' else 'incremental' end as mode", "case when id % 7 = 0 then 'partial' else 'ok' end as status")
    return lookup.index_status(V.files(spark, d), runs)


@query("select id, path, case when id % 4 = 0 then size + 1 else size end as size from files_v")
def updated_sizes(spark, d):
    f = V.files(spark, d)
    return lookup.updated(f, f.where("id % 4 = 0").select("id", (F.col("size") + 1).alias("size")), "id", "size").select("id", "path", "size")


@query(_HITS + f""", {_PCT.strip()}, r as (select rule, sum(greatest(hits, 1))::bigint as asks, sum(hits)::bigint as overridden from j group by 1),
o as (select hook_event, count(*) as n from (select hook_event, lag(hook_event) over (partition by session_id order by ts_ms, id) as b from tel_v where hook_event in ('opt_in', 'opt_out')) where b is distinct from hook_event group by 1)
select 'decisions' as section, rule || ':' || decision as key, count(*)::double as value from tel_v where hook_event = 'PreToolUse' and rule is not null group by 1, 2
union all select 'overrides', rule || ':asks', asks::double from r union all select 'overrides', rule || ':overridden', overridden::double from r
union all select 'latency', rule || ':p50', p50::double from pct union all select 'latency', rule || ':p95', p95::double from pct union all select 'latency', rule || ':p99', p99::double from pct
union all select 'opt', hook_event, n::double from o""")
def telemetry_digest(spark, d):
    return telemetry.digest(V.telemetry(spark, d), DAYS_10)


@query(_CALLS + """
, n as (select callee, least(count(distinct caller_id), 50) as callers from calls group by 1),
x as (select distinct file_id, name from exp_v),
a as (select s.file_id % 10 as change_id, count(*) as affected, max(coalesce(callers, 0)) as max_callers from sym_v s join x on x.file_id = s.file_id and x.name = s.name left join n on callee = s.name where s.scope is null group by 1),
u as (select e.file_id % 10 as change_id, count(*) as new_unused from exp_v e
  where not exists (select 1 from imp_v i where i.resolved_file_id = e.file_id and i.name = e.name) and not exists (select 1 from occ_v o where o.name = e.name and o.file_id <> e.file_id) group by 1),
t as (select a.change_id, affected, max_callers, coalesce(new_unused, 0)::bigint as new_unused, a.change_id % 2 = 0 as tests_run, case when max_callers <= 2 then 'low' when max_callers <= 10 then 'medium' else 'high' end as risk from a left join u on u.change_id = a.change_id)
select *, tests_run and risk <> 'high' and new_unused = 0 as evidence_ok,
  affected || ' exported symbols touched; up to ' || max_callers || ' callers (' || risk || ' risk)' || case when new_unused > 0 then '; ' || new_unused || ' unused exports' else '' end || case when tests_run then '; tests ran' else '; no tests ran' end as summary from t""")
def evidence_summary(spark, d):
    s, x, o = V.symbols(spark, d), V.exports(spark, d), V.occurrences(spark, d)
    changes = V.files(spark, d).select((F.col("id") % 10).alias("change_id"), F.col("id").alias("file_id"))
    tested = spark.range(5).select((F.col("id") * 2).alias("change_id"))
    got = policy.evidence(changes, s, x, graph.call_edges(o, s, ["call"]), health.unused_exports(x, V.imports(spark, d), o), tested)
    return policy.evidence_text(got)


@query("""
, i as (select resolved_file_id as r, count(distinct file_id) as importers from imp_v group by 1),
c as (select file_id, sum(length(name))::bigint as callers, max(length(name)) as m from sym_v group by 1)
select f.id, f.path, coalesce(importers, 0)::bigint as importers, coalesce(callers, 0)::bigint as callers, case when m is null or m <= 2 then 'low' when m <= 10 then 'medium' else 'high' end as risk
from files_v f left join i on r = f.id left join c on c.file_id = f.id""")
def preedit_impact(spark, d):
    f = V.files(spark, d)
    impact = V.symbols(spark, d).select("file_id", "name", F.length("name").alias("callers"), T.bucket_risk(F.length("name")).alias("risk"))
    return policy.preedit_impact(f.select("id", "path"), f, V.imports(spark, d), impact)


@query("""select event_id, case when event_id % 11 = 0 then 'parent_git_head_missing' when event_id % 7 = 0 then 'parent_dirty_at_index_time' when event_id % 5 = 0 then 'schema_mismatch'
  when event_id % 3 = 0 then 'diff_base_unreachable' when event_id % 13 = 0 then 'config_diverged' when event_id % 1000 > 500 then 'too_many_changes' end as reason from events""")
def overlay_gates(spark, d):
    from quarry.sources.build import overlay_gate

    k = lambda n: F.col("event_id") % n == 0
    head = F.when(~k(11), "abc")
    schema = F.when(k(5), 0).otherwise(1)
    return V.table(spark, d, "events").select("event_id", overlay_gate(head, ~k(7), schema, F.lit(1), ~k(3), k(13), F.col("event_id") % 1000).alias("reason"))


@query("""select event_id as id, user_id::varchar as session_id, case event_id % 6 when 1 then 'npm run test:unit' when 3 then 'pytest -q' end as cmd from events
where event_type = 'click' and event_id % 6 in (1, 3) and event_id // 6 % 2 = 0""")
def test_runs(spark, d):
    from quarry.registry import COMMANDS, _names

    e = V.table(spark, d, "events").where("event_type = 'click'")
    said = F.to_json(F.struct(_names(COMMANDS, "event_id").alias("command")))
    code = F.to_json(F.struct((F.floor(F.col("event_id") / 6) % 2).alias("exit_code")))
    e = e.select(F.lit("PostToolUse").alias("hook_event"), F.lit("Bash").alias("tool_name"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ts_ms"), said.alias("tool_input"), code.alias("tool_response"))
    return policy.test_runs(e).select(F.col("ts_ms").alias("id"), "session_id", "cmd")


@query("select path, size > 1500 as stale from files_v")
def stale_hints(spark, d):
    return policy.stale_hint(V.files(spark, d).select("path", F.col("size").alias("mtime")), 1500).select("path", "stale")


@query("""
, l as (select file_id, line, content, regexp_extract(content, '[A-Za-z_$][A-Za-z0-9_$]*') as first from lines_v where line % 2 = 1),
m as (select file_id, line, content, substr(content, 1, 6) as b, substr(content, 7) as a from lines_v where line % 2 = 0),
h as (select file_id, line, regexp_extract(b, '[A-Za-z_$][A-Za-z0-9_$]*$') || case when regexp_matches(b, '[A-Za-z_$][A-Za-z0-9_$]*$') then regexp_extract(a, '^[A-Za-z0-9_$]*') else regexp_extract(a, '^[A-Za-z_$][A-Za-z0-9_$]*') end as name from m)
select file_id, line, nullif(first, '') as identifier from l union all select file_id, line, name from h where name <> ''""")
def identifiers_at(spark, d):
    # at even lines only where the seventh place touches a name
    l = V.lines(spark, d).withColumn("at", F.when(F.col("line") % 2 == 0, 6))  # noqa: E741
    b, a = F.substring("content", 1, 6), F.expr("substring(content, 7)")
    touches = b.rlike("[A-Za-z_$][A-Za-z0-9_$]*$") | a.rlike("^[A-Za-z_$]")
    return source.identifiers_at(l.where((F.col("line") % 2 == 1) | touches), at="at").select("file_id", "line", "identifier")


@query("""select file_id, '{"nm":"' || name || '","cs":[{"l":' || line || case when line % 4 = 1 then ',"k":"class"' else '' end || '}]' || case when line % 2 = 0 then ',"id":true' else '' end || '}' as json, id from sym_v""")
def compact_nested(spark, d):
    from quarry.operators.compact import compact_json

    s = V.symbols(spark, d)
    inner = F.array(F.struct(F.col("line"), F.when(F.col("kind") == "class", F.col("kind")).otherwise("").alias("kind")))
    rows = s.select("file_id", "id", F.struct("name", inner.alias("call_sites"), F.array().cast("array<string>").alias("imports"), (F.col("line") % 2 == 0).alias("is_default")).alias("r"))
    short = compact_json(rows.select("r.*", F.struct(F.col("file_id"), F.col("id")).alias("key_")))
    return short.select(F.get_json_object("json", "$.key_.file_id").cast("long").alias("file_id"), F.regexp_replace("json", r',"key_":\{[^}]*\}', "").alias("json"), F.get_json_object("json", "$.key_.id").cast("long").alias("id"))


@query("""
, ended as (
  select s.*, coalesce(end_line, lead(line) over (partition by file_id order by line, id) - 1, least(line + 49, n_lines)) as e from sym_v s join (select file_id, count(*) as n_lines from lines_v group by 1) using (file_id)),
picked as (select id as root_id, id from sym_v where name = 'Of')
select root_id, id, array_to_string((string_split(text, chr(10)))[line:e], chr(10)) as source from picked join ended using (id) join documents on doc_id = file_id""")
def slice_sources(spark, d):
    n = V.lines(spark, d).groupBy("file_id").agg(F.count("*").alias("n_lines"))
    t = V.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    picked = V.symbols(spark, d).where("name = 'Of'").select(F.col("id").alias("root_id"), "id")
    return source.slice_bodies(picked, spans.end_lines(V.symbols(spark, d), n), t).select("root_id", "id", "source")


@query("select child as src, parent as dst, 0 as depth from graph_v where child = 'n:3' union all select parent, child, 0 from graph_v where false order by 1, 2 limit 200")
def relations_first(spark, d):
    r = V.graph(spark, d).select(F.col("child").alias("source_name"), F.col("parent").alias("target_name"))
    return graph.relations(r, "n:3", "parents", 1).orderBy("src", "dst").limit(200)


# --- documents -----------------------------------------------------------------------------------------------------------


def _manifests(spark, d) -> DataFrame:
    p = V.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 6).alias("k"), F.col("p_name").alias("n"), F.col("p_partkey").cast("string").alias("i"))
    text = (
        F.when(F.col("k") == 0, F.concat(F.lit('{"name": "'), "n", F.lit('", // a comment\n "version": "1.'), "i", F.lit('", "private": true, "dependencies": {"a": "^1", "b": "2"}, /* odd */ "scripts": 3,}')))
        .when(F.col("k") == 1, F.concat(F.lit('[package]\nname = "'), "n", F.lit('"\nedition = "2021"\nauthors = []\n[dependencies]\nserde = { version = "1" }\n[workspace]\nmembers = ["x'), "i", F.lit('"]\n')))
        .when(F.col("k") == 2, F.concat(F.lit("name: '"), "n", F.lit(" # no comment' # one\non: push\njobs:\n  b"), "i", F.lit(":\n    runs-on: linux\n    steps:\n      - uses: co\n      - run: x\n")))
        .when(F.col("k") == 3, F.concat(F.lit('["'), "n", F.lit('", '), "i", F.lit(", null, false, [], {}]")))
        .when(F.col("k") == 4, F.concat(F.lit('{"open": "'), "i"))
        .otherwise(F.concat(F.lit('{"long": "'), F.repeat(F.lit("y"), 79), F.lit('", "n": '), "i", F.lit(".0}")))
    )
    path = F.when(F.col("k") == 1, "Cargo.toml").when(F.col("k") == 2, "w.yml").otherwise("x.json")
    kind = F.when(F.col("k") == 0, "package_json").when(F.col("k") == 1, "cargo_toml").when(F.col("k") == 2, "gha_workflow").otherwise("json_generic")
    return p.select(F.concat("i", F.lit("/"), path).alias("path"), kind.alias("kind"), text.alias("text"))


_ENTRY = "select p_partkey::varchar || '/{path}' as path, {key} as key, '{kind}' as value_kind, {length}::int as length, {preview} as preview, null::varchar as error from part where p_partkey % 6 = {k}"
_ENTRIES = [
    (0, "x.json", "'name'", "string", "null", "'\"' || p_name || '\"'"), (0, "x.json", "'version'", "string", "null", "'\"1.' || p_partkey || '\"'"), (0, "x.json", "'dependencies'", "object", "null", "null"),
    (1, "Cargo.toml", "'package'", "object", "null", "null"), (1, "Cargo.toml", "'dependencies'", "object", "null", "null"), (1, "Cargo.toml", "'workspace'", "object", "null", "null"),
    (2, "w.yml", "'name'", "string", "null", "'\"' || p_name || ' # no comment\"'"), (2, "w.yml", "'on'", "string", "null", "'\"push\"'"), (2, "w.yml", "'jobs'", "object", "null", "null"),
    (3, "x.json", "'0'", "string", "null", "'\"' || p_name || '\"'"), (3, "x.json", "'1'", "number", "null", "p_partkey::varchar"), (3, "x.json", "'2'", "null", "null", "'null'"), (3, "x.json", "'3'", "boolean", "null", "'false'"),
    (3, "x.json", "'4'", "array", "0", "null"), (3, "x.json", "'5'", "object", "null", "null"),
    (5, "x.json", "'long'", "string", "null", "'\"' || repeat('y', 75) || '...\"'"), (5, "x.json", "'n'", "number", "null", "p_partkey::varchar"),
]


@query(", e as (" + " union all ".join(_ENTRY.format(k=k, path=p, key=key, kind=kind, length=n, preview=v) for k, p, key, kind, n, v in _ENTRIES) + " union all select p_partkey::varchar || '/x.json', null, null, null, null, 'unreadable' from part where p_partkey % 6 = 4) select * from e")
def document_outlines(spark, d):
    from quarry.sources.documents import outline_table

    return outline_table(_manifests(spark, d)).select("path", "key", "value_kind", "length", "preview", "error")


@query("""
, b as (select p_partkey, 12 + octet_length(encode(p_name)) as n from part)
select p_partkey::varchar as path, case when n <= 24 then 'name' end as key, case when n > 24 then 'file_too_large' end as error, case when n > 24 then 24 end::bigint as "limit", case when n > 24 then n end::bigint as actual from b""")
def document_caps(spark, d):
    from quarry.sources.documents import outline_table

    text = F.concat(F.lit('{"name": "'), "p_name", F.lit('"}'))
    docs = V.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("package_json").alias("kind"), text.alias("text"))
    return outline_table(docs, {"package_json": 24}).select("path", "key", "error", "limit", "actual")


@query("""
, l as (select doc_id, (['yarn.lock', 'package-lock.json', 'pnpm-lock.yaml', 'Cargo.lock'])[doc_id % 4 + 1] as base from documents)
select doc_id || '/' || base as path, unnest(['dep' || doc_id, case when doc_id % 4 = 3 then 'other' else '@s/other' end]) as name, unnest(['1.0.' || doc_id, '2.1.0']) as version from l""")
def lockfile_rows(spark, d):
    from quarry.sources.documents import lockfile_table

    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("# yarn lockfile v1\n\ndep"), i, F.lit("@^1.0.0, dep@1:\n  version \"1.0."), i, F.lit('"\n  resolved "x"\n\n"@s/other@2":\n  version "2.1.0"\n')))
        .when(k == 1, F.concat(F.lit('{"packages": {"": {"version": "0"}, "node_modules/dep'), i, F.lit('": {"version": "1.0.'), i, F.lit('"}, "node_modules/a/node_modules/@s/other": {"version": "2.1.0"}}}')))
        .when(k == 2, F.concat(F.lit("lockfileVersion: '6.0'\npackages:\n  /dep"), i, F.lit("@1.0."), i, F.lit(":\n    dev: true\n  /@s/other@2.1.0(x@1):\n    dev: false\n")))
        .otherwise(F.concat(F.lit('[[package]]\nname = "dep'), i, F.lit('"\nversion = "1.0.'), i, F.lit('"\n[[package]]\nname = "other"\nversion = "2.1.0"\n')))
    )
    base = F.element_at(F.array(*[F.lit(x) for x in ("yarn.lock", "package-lock.json", "pnpm-lock.yaml", "Cargo.lock")]), (k + 1).cast("int"))
    return lockfile_table(V.table(spark, d, "documents").select(F.concat(i, F.lit("/"), base).alias("path"), text.alias("text")))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as second, event_id as named from events")
def structured_paths(spark, d):
    from quarry.sources.documents import value_at

    text = F.concat(F.lit('{"a": {"list": [1, {"x": '), F.get_json_object("props", "$.k"), F.lit('}], "7": '), F.col("event_id").cast("string"), F.lit("}}"))
    e = V.table(spark, d, "events").select("event_id", text.alias("t"))
    return e.select("event_id", value_at("t", "a.list.1.x", "long").alias("second"), value_at("t", "a.7", "long").alias("named"))


# --- extraction, builds, overlays ------------------------------------------------------------------------------------------

#: A source of each language; {i} stands for the document's id.
CODE = {
    "typescript": 'import { Base } from "./base";\nexport class T{i} extends Base {\n  run(): void {\n    go();\n  }\n}\n',
    "javascript": "const fs = require('./fs');\nexport function f{i}(a) {\n  return go(a);\n}\n",
    "python": "from .base import Base\n\nclass T{i}(Base):\n    def run(self):\n        return go(self)\n",
    "java": "import a.b.Base;\npublic class T{i} extends Base {\n  public int run() {\n    return go();\n  }\n}\n",
    "csharp": "using A.B;\npublic class T{i} : IBase {\n  public int Run() {\n    return go();\n  }\n}\n",
    "go": 'package p\n\nimport "a/base"\n\nfunc Run{i}(a int) int {\n\treturn go1(a)\n}\n',
    "rust": "use a::base::Base;\n\npub fn run{i}(a: u8) -> u8 {\n    go1(a)\n}\n",
    "css": ".t{i} {\n  --c: red;\n  color: var(--c);\n}\n",
}
#: What is to be found in each: symbols (name, kind, line, end_line, scope), edges (kind, name, source, line), calls (name, line), relations (source, kind, target, line).
FOUND = {
    "typescript": ([("T{i}", "class", 2, 6, None), ("run", "method", 3, 5, "T{i}")], [("import", "Base", "./base", 1), ("export", "T{i}", None, 2)], [("go", 4)], [("T{i}", "extends_class", "Base", 2), ("run", "overrides_method", "Base.run", 3)]),
    "javascript": ([("fs", "variable", 1, 1, None), ("f{i}", "function", 2, 4, None)], [("require", None, "./fs", 1), ("export", "f{i}", None, 2)], [("go", 3)], []),
    "python": ([("T{i}", "class", 3, 5, None), ("run", "function", 4, 5, "T{i}")], [("import", "Base", ".base", 1), ("export", "T{i}", None, 3)], [("go", 5)], [("T{i}", "extends_class", "Base", 3)]),
    "java": ([("T{i}", "class", 2, 6, None), ("run", "method", 3, 5, "T{i}")], [("import", "Base", "a.b.Base", 1), ("export", "T{i}", None, 2)], [("go", 4)], [("T{i}", "extends_class", "Base", 2)]),
    "csharp": ([("T{i}", "class", 2, 6, None), ("Run", "method", 3, 5, "T{i}")], [("import", "B", "A.B", 1), ("export", "T{i}", None, 2)], [("go", 4)], [("T{i}", "implements", "IBase", 2)]),
    "go": ([("Run{i}", "function", 5, 7, None)], [("import", "base", "a/base", 3), ("export", "Run{i}", None, 5)], [("go1", 6)], []),
    "rust": ([("run{i}", "function", 3, 5, None)], [("import", "Base", "a::base::Base", 1), ("export", "run{i}", None, 3)], [("go1", 4)], []),
    "css": ([(".t{i}", "selector", 1, 4, None), ("--c", "variable", 2, 2, ".t{i}")], [], [], []),
}
LANGUAGES = list(CODE)


def _quoted(x) -> str:
    return "null" if x is None else str(x) if isinstance(x, int) else "replace('" + x.replace("'", "''") + "', '{i}', doc_id::varchar)"


def _found(part: int, columns: list[str]) -> str:
    rows = [f"select doc_id as file_id, {', '.join(f'{_quoted(v)} as {c}' for v, c in zip(row, columns))} from documents where doc_id % {len(LANGUAGES)} = {k}" for k, lang in enumerate(LANGUAGES) for row in FOUND[lang][part]]
    return ", found as (" + " union all ".join(rows) + ") select * from found"


def _code(spark, d) -> DataFrame:
    k = (F.col("doc_id") % len(LANGUAGES) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), k)
    docs = V.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("file_id"), pick(LANGUAGES).alias("language"), F.replace(pick(CODE.values()), F.lit("{i}"), F.col("doc_id").cast("string")).alias("text"))


def _extracted(spark, d, part: str) -> DataFrame:
    from quarry.sources.extract import extract, rows

    return rows(extract(_code(spark, d)), part)


@query(_found(0, ["name", "kind", "line", "end_line", "scope"]))
def extract_symbols(spark, d):
    return _extracted(spark, d, "symbols").select("file_id", "name", "kind", "line", "end_line", "scope")


@query(_found(1, ["kind", "name", "source", "line"]))
def extract_edges(spark, d):
    return _extracted(spark, d, "edges").select("file_id", "kind", "name", "source", "line")


@query(_found(2, ["name", "line"]))
def extract_calls(spark, d):
    return _extracted(spark, d, "occurrences").where("ref_kind = 'call'").select("file_id", "name", "line")


@query(_found(3, ["source_name", "kind", "target_name", "line"]))
def extract_relations(spark, d):
    return _extracted(spark, d, "relations").select("file_id", "source_name", "kind", "target_name", "line")


def _modules(spark, d, changed: bool = False) -> DataFrame:
    """A module for each document, whose class extends that of the one before; changed: some are gone, some renamed, some touched."""
    i = F.col("doc_id").cast("string")
    name = F.concat(F.when(F.lit(changed) & (F.col("doc_id") % 7 == 0), "New").otherwise("T"), i)
    before = (F.col("doc_id") - 1).cast("string")
    text = F.concat(F.lit("import { T"), before, F.lit(' } from "./d'), before, F.lit('";\nexport class '), name, F.lit(" extends T"), before, F.lit(" {\n  run() {\n    go();\n  }\n}\n"))
    docs = V.table(spark, d, "documents")
    docs = docs.where("doc_id % 11 <> 0") if changed else docs
    mtime = F.when(F.lit(changed) & (F.col("doc_id") % 2 == 0), 2.0).otherwise(1.0)
    return docs.select("doc_id", F.concat(F.lit("src/d"), i, F.lit(".ts")).alias("path"), mtime.alias("mtime"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("hash"), F.lit("typescript").alias("language"), text.alias("text"))


_META = {"config_hash": "c", "root": "/w", "git_head": "abc", "clean_at_index_time": True}

_MODULES = """
, m as (select doc_id as i, 'src/d' || doc_id || '.ts' as path, case when {new} then 'New' else 'T' end || doc_id as name, 'T' || (doc_id - 1) as base, 'src/d' || (doc_id - 1) || '.ts' as base_path, case when {touched} then 2.0 else 1.0 end::double as mtime from documents where {left}),
r as (select m.path, m.name, m.base as target_name, t.path as target_path, m.mtime from m left join m t on t.path = m.base_path and t.name = m.base where m.i > 0)
select * from r union all select path, 'run', target_name || '.run', target_path, mtime from r"""


def _ends(tables: dict[str, DataFrame]) -> DataFrame:
    """Relations with the path and name of their source and the path of their target."""
    at = lambda p: tables["symbols"].join(tables["files"].select(F.col("id").alias("f"), F.col("path").alias(f"{p}path"), F.col("mtime").alias(f"{p}mtime")), F.col("file_id") == F.col("f"))
    s = at("").select(F.col("id").alias("source_id"), "path", "name", "mtime")
    t = at("t_").select(F.col("id").alias("target_id"), F.col("t_path").alias("target_path"))
    return tables["relations"].join(s, "source_id").join(t, "target_id", "left").select("path", "name", "target_name", "target_path", "mtime")


def _published(spark, at: str) -> dict[str, DataFrame]:
    from quarry.sources import publish

    return {t: publish.load(spark, at, t) for t in ("files", "symbols", "edges", "occurrences", "relations")}


@query(_MODULES.format(new="false", touched="false", left="true"))
def index_build(spark, d):
    """A full build, read back."""
    from quarry.sources import build

    at = scratch(spark, "index")
    build.build(spark, _modules(spark, d).drop("doc_id"), at, _META)
    return _ends(_published(spark, at))


@query(_MODULES.format(new="doc_id % 7 = 0", touched="doc_id % 2 = 0", left="doc_id % 11 <> 0"))
def index_rebuild(spark, d):
    """A full build, then an incremental one over the changed tree."""
    from quarry.sources import build

    at = scratch(spark, "index")
    build.build(spark, _modules(spark, d).drop("doc_id"), at, _META)
    said = build.build(spark, _modules(spark, d, True).drop("doc_id"), at, _META)
    if said["mode"] != "incremental":
        raise RuntimeError(f"expected an incremental build: {said}")
    return _ends(_published(spark, at))


def _tree_changes(spark, d) -> DataFrame:
    """Every 7th module renamed, every 11th removed, as changes of a work tree."""
    now = _modules(spark, d, True).where("doc_id % 7 = 0").withColumn("status", F.lit("M"))
    gone = _modules(spark, d).where("doc_id % 11 = 0").withColumns({"status": F.lit("D"), "text": F.lit(None).cast("string")})
    return now.unionByName(gone).drop("doc_id")


@query(_MODULES.format(new="doc_id % 7 = 0", touched="doc_id % 7 = 0 and doc_id % 2 = 0", left="doc_id % 11 <> 0"))
def overlay_view(spark, d):
    """The merged tables of an overlay on a base index."""
    from quarry.sources import build

    base, at = scratch(spark, "index"), scratch(spark, "overlay")
    build.build(spark, _modules(spark, d).drop("doc_id"), base, _META)
    most, build.MAX_OVERLAY_FILES = build.MAX_OVERLAY_FILES, 1 << 60  # all changes of the table, however many
    try:
        said = build.build_overlay(spark, base, at, _tree_changes(spark, d), True, lambda: (_modules(spark, d, True).drop("doc_id"), _META))
    finally:
        build.MAX_OVERLAY_FILES = most
    if said["kind"] != "overlay":
        raise RuntimeError(f"expected an overlay: {said}")
    return _ends(build.merged(spark, at))


@query(_MODULES.format(new="doc_id % 7 = 0", touched="doc_id % 2 = 0", left="doc_id % 11 <> 0"))
def overlay_fallback(spark, d):
    """A full index where the diff's base can't be reached."""
    from quarry.sources import build

    base, at = scratch(spark, "index"), scratch(spark, "overlay")
    build.build(spark, _modules(spark, d).drop("doc_id"), base, _META)
    said = build.build_overlay(spark, base, at, _tree_changes(spark, d), False, lambda: (_modules(spark, d, True).drop("doc_id"), _META))
    if said["reason"] != "diff_base_unreachable":
        raise RuntimeError(f"expected a fallback: {said}")
    return _ends(_published(spark, at))


# --- scans, sinks --------------------------------------------------------------------------------------------------------


@query("""
, g as (select file_id % 20 as g, string_agg(name || case when file_id % 20 = 3 then repeat('x', 600) else '' end, chr(10) order by id) || chr(10) as text from sym_v group by 1)
select g, sha256(text) as hash, length(text)::bigint as size from g where g <> 3 and octet_length(encode(text)) <= 1048576""")
def scan_store(spark, d):
    """Names as files of a store, scanned: hashed, measured, minified and large ones left out."""
    from quarry.sources.scan import scan_store

    at = scratch(spark, "store")
    g = F.col("file_id") % 20
    s = V.symbols(spark, d).select(g.alias("g"), "id", F.concat("name", F.when(g == 3, F.repeat(F.lit("x"), 600)).otherwise("")).alias("value"))
    s.repartition(20, "g").sortWithinPartitions("g", "id").select("g", "value").write.partitionBy("g").text(at)
    got = scan_store(spark, at, languages={"names": [".txt"]})
    return got.select(F.regexp_extract("path", r"g=(\d+)/", 1).cast("long").alias("g"), "hash", "size")


@query("select id, path, case when id % 2 = 0 then 'n' end as note from files_v where id % 9 <> 0")
def published_files(spark, d):
    """Two versions of a table: readers see the second, the first is pruned, both are whole."""
    from quarry.sources import publish

    at = scratch(spark, "tables")
    f = V.files(spark, d).select("id", "path")
    for k in range(3):
        publish.publish(spark, at, {"files": f.withColumn("note", F.when(F.col("id") % 2 == 0, "n")) if k else f}, {"round": k})
        f = f.where("id % 9 <> 0") if k == 0 else f
    if publish.meta(spark, at) != {"round": 2} or publish.broken(spark, at) or publish.prune_versions(spark, at, 1) != [1, 2]:
        raise RuntimeError("the published tables aren't what was written")
    return publish.load(spark, at, "files")


_GONE = "select file_id, line, case when resolved_file_id % 9 = 0 then null else resolved_file_id end as resolved_file_id from imp_v where file_id % 9 <> 0"


@query(_GONE)
def deleted_files(spark, d):
    from quarry.sources import publish

    f = V.files(spark, d)
    tables = publish.delete_files({"files": f, "module_edges": V.imports(spark, d)}, f.where("id % 9 = 0").select("id"))
    return tables["module_edges"].select("file_id", "line", "resolved_file_id")


@query("select id, ts_ms, rule, decision from tel_v where ts_ms >= (select max(ts_ms) from tel_v) - 864000000")
def exported_events(spark, d):
    """The last ten days as lines of JSON, read back."""
    from quarry.sources import publish

    at, t = scratch(spark, "export"), V.telemetry(spark, d)
    publish.export_ndjson(t, publish.since("10d", t.agg(F.max("ts_ms")).first()[0] or 0), at)
    return spark.read.schema("id long, ts_ms long, rule string, decision string").json(at)


@query("select id, rule || ',\"' || decision || '\"' as said from tel_v where ts_ms >= (select max(ts_ms) from tel_v) - 3600000 * 48")
def exported_csv(spark, d):
    """Two days as CSV, read back; commas and quotes survive."""
    from quarry.sources import publish

    at, t = scratch(spark, "export"), V.telemetry(spark, d)
    t = t.select("id", "ts_ms", F.concat("rule", F.lit(',"'), "decision", F.lit('"')).alias("said"))
    publish.export_csv(t, publish.since("48h", t.agg(F.max("ts_ms")).first()[0] or 0), at)
    return spark.read.schema("id long, ts_ms long, said string").csv(at, header=True, quote='"', escape='"').select("id", "said")


@query("select id, ts_ms, budget_tokens, total_tokens from pack_v")
def recorded_packs(spark, d):
    """Runs of the pack operator, appended in two batches and read back."""
    from quarry.sources import publish

    at, p = scratch(spark, "packs"), V.packs(spark, d).select("id", "ts_ms", "budget_tokens", "total_tokens", "included_count", "skipped_count", "timing_ms")
    record = publish.recorder(at)
    for half in (0, 1):
        record(p.where(F.col("id") % 2 == half))
    return spark.read.parquet(at).select("id", "ts_ms", "budget_tokens", "total_tokens")
