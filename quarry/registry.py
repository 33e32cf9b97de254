"""Queries of the library without the llm subpackage: each operator on the index tables that the driver's tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.signature import signature_params
from quarry.functions.text import estimate_tokens, test_path
from quarry.operators import compact, graph, health, lookup, overlay, pack, policy, search, source, spans, telemetry
from quarry.plans import views as V
from quarry.scratch import staged
from quarry.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

DAYS_10 = 10 * 86_400_000
NOW = 1_735_689_600_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = V.sql(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _at(f: str) -> str:
    return f"join files_v f on {f} = f.id"


# --- lookups -----------------------------------------------------------------------------------------------------------


@query(f"""
select s.id, s.name, s.kind, s.line, f.path from sym_v s {_at('s.file_id')}
where s.name = 'THE' or (lower(s.name) = 'the' and not exists (select 1 from sym_v where name = 'THE'))""")
def find_exact_ci(spark, d):
    return lookup.find(V.symbols(spark, d), V.files(spark, d), "THE").select("id", "name", "kind", "line", "path")


@query(f"select s.id, s.line, f.path from sym_v s {_at('s.file_id')} where s.name = 'The' and s.kind = 'class'")
def find_kind(spark, d):
    return lookup.find(V.symbols(spark, d), V.files(spark, d), "The", "class").select("id", "line", "path")


@query("select id, name, kind, line from sym_v where file_id = 17")
def symbols_of_file(spark, d):
    return V.symbols(spark, d).where("file_id = 17").select("id", "name", "kind", "line")


@query(f"select o.file_id, o.line, o.col, o.ref_kind, f.path from occ_v o {_at('o.file_id')} where o.name = 'the' and o.ref_kind in ('call', 'read')")
def refs_filtered(spark, d):
    return lookup.refs(V.occurrences(spark, d), V.files(spark, d), "the", ["call", "read"]).select("file_id", "line", "col", "ref_kind", "path")


@query(f"select s.id, s.name, f.path, s.line from sym_v s {_at('s.file_id')} where s.kind = 'class' and starts_with(lower(f.path), 'src1/') order by f.path, s.line, s.id limit 200")
def kind_index(spark, d):
    return lookup.kind_index(V.symbols(spark, d), V.files(spark, d), "class", "src1/").select("id", "name", "path", "line")


@query(f"select name, path, line, id from (select s.*, f.path, row_number() over (partition by s.name, f.path order by s.line, s.id) as n from sym_v s {_at('s.file_id')} where s.name in ('The', 'Of', 'De')) where n = 1")
def signatures_batch(spark, d):
    return lookup.signatures(V.symbols(spark, d), V.files(spark, d), ["The", "Of", "De"]).select("name", "path", "line", "id")


@query(f"select s.id, f.path from sym_v s {_at('s.file_id')} where s.name = 'Of' and lower(f.path) like '%1.txt'")
def doc_lookup(spark, d):
    return lookup.doc_lookup(V.symbols(spark, d), V.files(spark, d), "Of", "1.txt").select("id", "path")


@query("""
select id, path from (select id, path, case when path = 'D7.TXT' then 0 when lower(path) = 'd7.txt' then 1 when lower(path) like '%d7.txt' then 2 end as r from files_v)
where r is not null order by r, id limit 1""")
def find_file(spark, d):
    return lookup.find_file(V.files(spark, d), "D7.TXT").select("id", "path")


@query("select id, path, language from files_v where status = 'indexed' and language = 'en' and starts_with(lower(path), 'src2')")
def file_paths(spark, d):
    return lookup.file_paths(V.files(spark, d), "en", "SRC2")


@query("select file_id, name, line, kind from edges_v where kind in ('export', 're-export')")
def exports_list(spark, d):
    return lookup.exports_of(V.edges(spark, d)).select("file_id", "name", "line", "kind")


@query("select file_id, source, line, kind from edges_v where kind in ('import', 'dynamic-import', 'require')")
def imports_list(spark, d):
    return lookup.imports_of(V.edges(spark, d)).select("file_id", "source", "line", "kind")


@query("""select count(*) as total, count(*) filter (status = 'indexed') as indexed, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'error') as errored,
case when count(*) filter (status = 'error') > 0 then 'partial' else 'ok' end as health from files_v""")
def index_health(spark, d):
    return lookup.index_health(V.files(spark, d))


@query("select language, count(*) as files, coalesce(sum(n), 0)::bigint as symbols from files_v left join (select file_id, count(*) as n from sym_v group by 1) on id = file_id group by 1")
def language_stats(spark, d):
    return lookup.language_stats(V.files(spark, d), V.symbols(spark, d))


@query("""
select id, path, status, coalesce(n, 0)::bigint as symbol_count, coalesce(exports, '') as exports from files_v
left join (select file_id, count(*) as n from sym_v group by 1) s on id = s.file_id
left join (select file_id, string_agg(name, ',' order by line) as exports from exp_v group by 1) e on id = e.file_id""")
def tree(spark, d):
    return lookup.tree(V.files(spark, d), V.symbols(spark, d), V.exports(spark, d))


@query("""select id, case when lower(path) like '%.test.txt' then 'declared' when list_contains(string_split(lower(path), '/'), '__tests__') then 'declared' when split_part(lower(path), '/', 1) in ('test', 'tests') then 'derived' end as test
from (select id, replace(path, 'src1/', 'tests/') as path from files_v)""")
def test_paths(spark, d):
    return V.files(spark, d).select("id", test_path(F.replace(F.col("path"), F.lit("src1/"), F.lit("tests/"))).alias("test"))


@query("select id, kind, estimate from (select id, kind, ceil(length(name) / 4.0)::bigint as estimate from sym_v) where estimate > 3")
def token_estimates(spark, d):
    return V.symbols(spark, d).select("id", "kind", estimate_tokens("name").cast("long").alias("estimate")).where("estimate > 3")


# --- spans -------------------------------------------------------------------------------------------------------------


@query("""
select file_id, line, col, name, enclosing_id, enclosing_name from (
  select o.*, s.id as enclosing_id, s.name as enclosing_name, row_number() over (partition by o.file_id, o.line, o.col order by s.end_line - s.line, s.id) as n
  from occ_v o join sym_v s on s.file_id = o.file_id and o.line between s.line and s.end_line where o.ref_kind = 'call') where n = 1""")
def enclosing_symbol(spark, d):
    o = V.occurrences(spark, d).where("ref_kind = 'call'")
    return spans.enclosing(o, V.symbols(spark, d)).select("file_id", "line", "col", "name", "enclosing_id", "enclosing_name")


@query("select s.id as range_id, count(*) as n, count(distinct o.name) as names from sym_v s join occ_v o on o.file_id = s.file_id and o.line between s.line and s.end_line where s.kind = 'function' group by 1")
def occ_in_range(spark, d):
    r = V.symbols(spark, d).where("kind = 'function'").select("file_id", F.col("line").alias("start"), F.col("end_line").alias("stop"), F.col("id").alias("range_id"))
    return spans.in_range(V.occurrences(spark, d), r).groupBy("range_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


_ENDED = """
ended as (
  select s.*, coalesce(end_line, lead(line) over (partition by file_id order by line, id) - 1, least(line + 49, n_lines)) as e
  from sym_v s join (select file_id, count(*) as n_lines from lines_v group by 1) using (file_id))"""


@query(f", {_ENDED.strip()} select id, line, e::bigint as \"end\" from ended")
def end_line_fallback(spark, d):
    n = V.lines(spark, d).groupBy("file_id").agg(F.count("*").alias("n_lines"))
    return spans.end_lines(V.symbols(spark, d), n).select("id", "line", F.col("end").cast("long").alias("end"))


@query(f", {_ENDED.strip()} select id, array_to_string((string_split(text, chr(10)))[line:e], chr(10)) as source from ended join documents on doc_id = file_id where name = 'The'")
def source_body(spark, d):
    n = V.lines(spark, d).groupBy("file_id").agg(F.count("*").alias("n_lines"))
    texts = V.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return spans.bodies(spans.end_lines(V.symbols(spark, d), n).where("name = 'The'"), texts).select("id", "source")


@query("""
select s.file_id, s.id, s.name, s.line, max_by(t.id, t.line) as parent_id, case when max(t.id) is null then 0 else 1 end as depth
from (select file_id, id, name, line, case when line % 3 = 0 then 'The' end as scope from sym_v) s
left join (select * from sym_v where line % 3 <> 0) t on t.file_id = s.file_id and t.name = s.scope and t.line <= s.line group by 1, 2, 3, 4""")
def outline(spark, d):
    s = V.symbols(spark, d).withColumn("scope", F.when(F.col("line") % 3 == 0, F.lit("The")))
    return spans.outline(s).select("file_id", "id", "name", "line", "parent_id", "depth")


# --- graph -------------------------------------------------------------------------------------------------------------

_GROUPED = "string_agg(name, ',' order by line) as names, bool_and(is_type) as is_type, bool_or(is_default) as is_default, bool_or(is_star) as is_star, min_by(source, line) as source, min(line) as line"


@query(f"select file_id, {_GROUPED} from edges_v where kind in ('import', 'dynamic-import', 'require') and source = '/de' group by 1")
def importers_exact(spark, d):
    return graph.importers(V.edges(spark, d), "/de")


@query(f"select file_id, {_GROUPED} from edges_v where kind in ('import', 'dynamic-import', 'require') and contains(source, 'ion') group by 1")
def importers_like(spark, d):
    return graph.importers(V.edges(spark, d), "ion")


@query("select file_id, coalesce(source, '<unknown>') as source, string_agg(name, ',' order by line) as names, bool_and(is_type) as is_type, count(*) as n from edges_v group by 1, 2")
def import_summary(spark, d):
    return graph.import_summary(V.edges(spark, d))


_CLOSURE = """
, recursive_v as (select 0)
select node, min(depth)::int as depth from (
  select '{seed}' as node, 0 as depth union all
  select {b1}, 1 from graph_v g1 where g1.{a} = '{seed}' union all
  select g2.{b}, 2 from graph_v g1 join graph_v g2 on g2.{a} = g1.{b} where g1.{a} = '{seed}') group by 1"""


@query(_CLOSURE.format(seed="r:1", a="parent", b="child", b1="g1.child"))
def deps_importers(spark, d):
    e = V.graph(spark, d).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return graph.bounded_closure(e, spark.createDataFrame([("r:1",)], "node string"), 2)


@query(_CLOSURE.format(seed="c:5", a="child", b="parent", b1="g1.parent"))
def deps_imports(spark, d):
    e = V.graph(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return graph.bounded_closure(e, spark.createDataFrame([("c:5",)], "node string"), 2)


@query("select child as src, parent as dst, 0 as depth from graph_v where child = 'c:7' union all select g2.child, g2.parent, 1 from graph_v g1 join graph_v g2 on g2.child = g1.parent where g1.child = 'c:7'")
def relations_parents(spark, d):
    r = V.graph(spark, d).select(F.col("child").alias("source_name"), F.col("parent").alias("target_name"))
    return graph.relations(r, "c:7", "parents", 2)


@query("select parent as src, child as dst, 0 as depth from graph_v where parent = 'n:3'")
def relations_children(spark, d):
    r = V.graph(spark, d).select(F.col("child").alias("source_name"), F.col("parent").alias("target_name"))
    return graph.relations(r, "n:3", "children", 1)


@query("select child as src, parent as dst, 'parent' as direction from graph_v where child = 'n:3' union all select parent, child, 'child' from graph_v where parent = 'n:3'")
def relations_both(spark, d):
    r = V.graph(spark, d).select(F.col("child").alias("source_name"), F.col("parent").alias("target_name"))
    return graph.relations(r, "n:3", "both")


_CALLS = """
, defs as (select name, min_by(id, file_id * 1000000 + line) as d_id, min(file_id * 1000000 + line) as k, min_by(coalesce(end_line, line), file_id * 1000000 + line) as d_end from sym_v group by 1),
used as (
  select o.file_id, o.line, o.col, o.name, d_id from occ_v o join defs d using (name)
  where o.ref_kind = 'call' and not (o.file_id = k // 1000000 and o.line between k % 1000000 and d_end)),
calls as (
  select enclosing_id as caller_id, caller, name as callee, count(*) as sites from (
    select u.*, s.id as enclosing_id, s.name as caller, row_number() over (partition by u.file_id, u.line, u.col order by s.end_line - s.line, s.id) as n
    from used u join sym_v s on s.file_id = u.file_id and u.line between s.line and s.end_line) where n = 1 and enclosing_id <> d_id group by 1, 2, 3)"""


@query(_CALLS + " select caller_id, caller, callee, sites from calls")
def call_graph(spark, d):
    return graph.call_edges(V.occurrences(spark, d), V.symbols(spark, d), ["call"])


@query(_CALLS + " select distinct caller, 1 as depth from calls where callee = 'The' and caller <> 'The'")
def callers_d1(spark, d):
    return graph.callers(graph.call_edges(V.occurrences(spark, d), V.symbols(spark, d), ["call"]), "The", 1)


@query(_CALLS + """, c1 as (select distinct caller from calls where callee = 'Erin' and caller <> 'Erin')
select caller, 1 as depth from c1 union all
select distinct c.caller, 2 from calls c join c1 on c.callee = c1.caller where c.caller <> 'Erin' and c.caller not in (select caller from c1)""")
def callers_d2(spark, d):
    return graph.callers(graph.call_edges(V.occurrences(spark, d), V.symbols(spark, d), ["call"]), "Erin", 2)


@query("""select e.file_id, e.source, e.line, f.id as resolved_file_id from (
  select file_id, line, '../' || split_part(g.path, '/', 2) || '/' || replace(split_part(g.path, '/', 3), '.txt', '') || case when file_id % 2 = 0 then '.js' else '' end as source, g.path
  from sym_v join files_v g on g.id = (file_id * 7 + 3) % (select max(id) + 1 from files_v)) e
join files_v h on h.id = e.file_id
left join (select id, replace(path, '.txt', '.ts') as path from files_v) f on f.path = split_part(h.path, '/', 1) || '/' || split_part(e.path, '/', 2) || '/' || replace(split_part(e.path, '/', 3), '.txt', '.ts')""")
def resolve_paths(spark, d):
    f = V.files(spark, d)
    g = f.select(F.col("id").alias("g_id"), F.split("path", "/").alias("p"))
    s = V.symbols(spark, d).crossJoin(F.broadcast(f.agg((F.max("id") + 1).alias("ids"))))
    e = s.join(g, (F.col("file_id") * 7 + 3) % F.col("ids") == F.col("g_id"))
    source = F.concat(F.lit("../"), F.col("p")[1], F.lit("/"), F.replace(F.col("p")[2], F.lit(".txt"), F.lit("")), F.when(F.col("file_id") % 2 == 0, ".js").otherwise(""))
    return graph.resolve_paths(e.select("file_id", source.alias("source"), "line"), f.withColumn("path", F.replace("path", F.lit(".txt"), F.lit(".ts"))))


@query("""select r.id, r.file_id, r.target_name, coalesce(n.t_id, m.t_id) as target_id
from (select id, file_id, name as target_name from sym_v) r
left join (select file_id, name, min(id) as t_id from sym_v where kind in ('class', 'interface', 'type') and scope is null group by 1, 2) n on n.file_id = r.file_id and n.name = r.target_name
left join (select i.file_id, i.name, t_id from (select distinct file_id, name, resolved_file_id from imp_v) i
  join (select file_id, name, min(id) as t_id from sym_v where kind in ('class', 'interface', 'type') and scope is null group by 1, 2) t on t.file_id = i.resolved_file_id and t.name = i.name) m
  on m.file_id = r.file_id and m.name = r.target_name""")
def resolve_relations(spark, d):
    s = V.symbols(spark, d)
    return graph.resolve_relations(s.select("id", "file_id", F.col("name").alias("target_name")), s, V.imports(spark, d))


# --- health ------------------------------------------------------------------------------------------------------------

_UNUSED = """
select e.file_id, e.name, e.line from exp_v e
where not exists (select 1 from imp_v i where i.resolved_file_id = e.file_id and i.name = e.name {a})
and not exists (select 1 from occ_v o where o.name = e.name and o.file_id <> e.file_id {b})"""


@query(_UNUSED.format(a="", b=""))
def unused_exports(spark, d):
    return health.unused_exports(V.exports(spark, d), V.imports(spark, d), V.occurrences(spark, d)).select("file_id", "name", "line")


@query(_UNUSED.format(a="and not i.is_type", b="and o.ref_kind is distinct from 'type-ref'"))
def unused_runtime_only(spark, d):
    return health.unused_exports(V.exports(spark, d), V.imports(spark, d), V.occurrences(spark, d), runtime_only=True).select("file_id", "name", "line")


@query("""select s.id, s.name from sym_v s where scope is null
and not exists (select 1 from exp_v e where e.file_id = s.file_id and e.name = s.name)
and not exists (select 1 from occ_v o where o.file_id = s.file_id and o.name = s.name and o.line <> s.line)""")
def private_dead(spark, d):
    return health.private_dead(V.symbols(spark, d), V.exports(spark, d), V.occurrences(spark, d)).select("id", "name")


@query("select i.file_id, i.line, i.name from imp_v i join files_v f on f.id = i.file_id where i.resolved_file_id = 20 and starts_with(f.path, 'src1')")
def tests_for(spark, d):
    f = V.files(spark, d).withColumn("path", F.regexp_replace("path", "^src1", "tests/"))
    return health.tests_for(V.imports(spark, d), f, 20).select("file_id", "line", "name")


@query("""
, d as (select id, file_id, line from sym_v where name = 'The' order by id limit 1),
x as (
  select (select id from d) as id,
    (select count(*) from occ_v o, d where o.name = 'The' and not (o.file_id = d.file_id and o.line = d.line)) as callers,
    (select count(distinct i.file_id) from imp_v i, d where i.resolved_file_id = d.file_id and i.name = 'The') as importers)
select id, callers, importers, 0::bigint as children, 0::bigint as parents, callers + importers as blast_radius,
  case when importers > 0 then 'high' when callers > 0 then 'medium' else 'low' end as risk,
  case when importers > 0 then 'has_importers' when callers > 0 then 'has_callers' else 'no_external_refs' end as reasons from x""")
def rename_safety(spark, d):
    r = V.graph(spark, d).select(F.col("child").alias("source_name"), F.col("parent").alias("target_name"))
    return health.rename_safety(V.symbols(spark, d), V.files(spark, d), V.occurrences(spark, d), V.imports(spark, d), r, "The", "NoSuchName")


@query("""
, sites as (
  select file_id, line, 'definition' as role from sym_v where name = 'The' union
  select file_id, line, 'caller' from occ_v where name = 'The' and ref_kind in ('call', 'read', 'write', 'type-ref') union
  select file_id, line, 'importer' from imp_v where name = 'The')
select file_id, string_agg(distinct role, ',' order by role) as roles, array_to_string(list_sort(list(distinct line)), ',') as lines, count(*) as edits from sites group by 1""")
def refactor_preview(spark, d):
    return health.refactor_preview(V.symbols(spark, d), V.occurrences(spark, d), V.imports(spark, d), "The")


@query("""select s.id, f.path, s.kind, s.line, coalesce(s.scope, '') as scope, coalesce(n, 0)::bigint as importer_count from sym_v s join files_v f on f.id = s.file_id
left join (select resolved_file_id, count(distinct file_id) as n from imp_v where name = 'Of' group by 1) i on i.resolved_file_id = s.file_id where s.name = 'Of'""")
def clarify(spark, d):
    return health.clarify(V.symbols(spark, d), V.files(spark, d), V.imports(spark, d), "Of")


# --- search ------------------------------------------------------------------------------------------------------------


def _scored(q: str, name: str, strings: str) -> str:
    """CTE ``name(s, score)``: the score of q for each text of the CTE strings(s)."""
    low, n = q.lower(), len(q)
    at = ["strpos(l, '" + low[0] + "') as p1"] + [f"case when p{k} > 0 and strpos(substr(l, p{k} + 1), '{c}') > 0 then p{k} + strpos(substr(l, p{k} + 1), '{c}') else 0 end as p{k + 1}" for k, c in enumerate(low[1:], 1)]
    near = " + ".join(["0"] + [f"(p{k + 1} = p{k} + 1)::int" for k in range(1, n)])
    rest = f"when p{n} > 0 then greatest(0.1::double, least(0.6::double, 0.3::double + 0.05::double * near - least(0.05::double * ({n} - near), 0.2::double)))"
    inside = f"0.7::double + greatest(0.0::double, 0.15::double * (1 - (strpos(l, '{low}') - 1)::double / length(s)))"
    score = f"case when s = '{q}' then 1.0::double when l = '{low}' then 0.95::double when starts_with(l, '{low}') then 0.9::double when strpos(l, '{low}') > 0 then {inside} {rest} else 0.0::double end"
    return f"{name} as (select s, {score} as score from (select *, {near} as near from (select s, lower(s) as l, {', '.join(at)} from {strings})))"


def _parts(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("base"), F.lit(None).cast("string").alias("scope"), F.col("p_type").alias("doc"))


_STRINGS = ", strings as (select p_name as s from part union select p_brand from part union select p_type from part)"


def _best(cte: str) -> str:
    """Best weighted score of the fields of each part."""
    of = lambda c: f"(select score from {cte} where s = {c})"
    return f"greatest({of('p_name')}, 0.7 * {of('p_brand')}, 0.4 * {of('p_type')})"


@query(f"{_STRINGS}, {_scored('red', 'by_red', 'strings')}, r as (select p_partkey as id, p_name as name, case when n.score > 0 then n.score else greatest(0.7 * b.score, 0.4 * t.score) end as score from part join by_red n on n.s = p_name join by_red b on b.s = p_brand join by_red t on t.s = p_type) select id, name, round(score, 6) as score from r where score > 0 order by r.score desc, id limit 20")
def search_single(spark, d):
    return search.search(_parts(spark, d), "red").select("id", "name", F.round("score", 6).alias("score"))


@query(f"""
{_STRINGS}, {_scored('widget', 'by_w', 'strings')}, {_scored('red', 'by_r', 'strings')},
b as (select p_partkey as id, {_best('by_w')} as a, {_best('by_r')} as b from part),
r as (select id, (a > 0)::int + (b > 0)::int as hit, (a + b) / 2 * sqrt(((a > 0)::int + (b > 0)::int) / 2) as score from b)
select id, round(score, 6) as score from r where hit > 0 order by round(r.score, 12) desc, id limit 20""")
def search_multi(spark, d):
    return search.search(_parts(spark, d), "widget red").select("id", F.round("score", 6).alias("score"))


@query(f", names as (select distinct name as s from sym_v), {_scored('ered', 'by_ered', 'names')} select s as name, round(score, 6) as score from by_ered where score >= 0.15 order by by_ered.score desc, s limit 5")
def suggestions(spark, d):
    return search.suggestions(V.symbols(spark, d), "ered").select("name", F.round("score", 6).alias("score"))


@query("""select f.path, l.line, (length(regexp_extract(l.content, '(?i)^(.*?)licen[cs]e[sd]? ', 1)))::int as col, regexp_extract(l.content, '(?i)licen[cs]e[sd]? ') as match, l.content[1:200] as context
from lines_v l join files_v f on f.id = l.file_id where f.status = 'indexed' and regexp_matches(l.content, '(?i)licen[cs]e[sd]? ') order by path, line limit 50""")
def grep(spark, d):
    return search.grep(V.lines(spark, d), V.files(spark, d), "licen[cs]e[sd]? ")


# --- overlay -----------------------------------------------------------------------------------------------------------


def _delta(spark, d):
    f = V.files(spark, d)
    return f, f.where("id % 10 = 0 and id > 0").withColumn("size", F.col("size") + 1), f.where("id % 17 = 0")


@query("""
select id, path, size from files_v where not (id % 10 = 0 and id > 0) and id % 17 <> 0 union all select -id, path, size + 1 from files_v where id % 10 = 0 and id > 0""")
def overlay_files(spark, d):
    return overlay.merge_files(*_delta(spark, d)).select("id", "path", "size")


@query("""
select file_id, count(*) as n from (
  select file_id from occ_v where not (file_id % 10 = 0 and file_id > 0) and file_id % 17 <> 0 union all
  select -file_id from occ_v where file_id % 10 = 0 and file_id > 0) group by 1""")
def overlay_occurrences(spark, d):
    f, c, x = _delta(spark, d)
    o = V.occurrences(spark, d)
    return overlay.merge_children(o, f, o.where("file_id % 10 = 0 and file_id > 0"), c, x).groupBy("file_id").agg(F.count("*").alias("n"))


@query("""select file_id, line, case when resolved_file_id % 10 = 0 and resolved_file_id > 0 then -resolved_file_id when resolved_file_id % 17 = 0 and resolved_file_id >= 0 then null else resolved_file_id end as resolved_file_id from imp_v""")
def overlay_remap(spark, d):
    f, c, x = _delta(spark, d)
    return overlay.remap(V.imports(spark, d), f, c, x).select("file_id", "line", "resolved_file_id")


_SCAN = "select path, id % 7 as mtime, size, md5(path) as hash from files_v where id % 13 <> 0"
_STORED = "select path, case when id % 5 = 0 then -1 else id % 7 end as mtime, size, case when id % 20 = 0 then 'x' else md5(path) end as hash from files_v where id % 11 <> 0"


@query(f"""select coalesce(a.path, b.path) as path, case when b.path is null then 'add' when a.path is null then 'delete' when a.mtime = b.mtime and a.size = b.size then 'unchanged' when a.hash = b.hash then 'hash_only' else 'update' end as action
from ({_SCAN}) a full join ({_STORED}) b on a.path = b.path""")
def change_detection(spark, d):
    f = V.files(spark, d)
    scan = f.where("id % 13 <> 0").selectExpr("path", "id % 7 as mtime", "size", "md5(path) as hash")
    stored = f.where("id % 11 <> 0").selectExpr("path", "case when id % 5 = 0 then -1 else id % 7 end as mtime", "size", "case when id % 20 = 0 then 'x' else md5(path) end as hash")
    return overlay.detect_changes(scan, stored)


@query("""
, a as (select kind, name, min(line)::varchar as signature from sym_v where file_id % 2 = 0 group by 1, 2), b as (select kind, name, min(line)::varchar as signature from sym_v where file_id % 2 = 1 group by 1, 2)
select coalesce(a.kind, b.kind) as kind, coalesce(a.name, b.name) as name, case when a.name is null then 'added' when b.name is null then 'removed' else 'modified' end as change
from a full join b on a.kind = b.kind and a.name = b.name where a.signature is distinct from b.signature""")
def symbol_diff(spark, d):
    s = V.symbols(spark, d).groupBy("kind", "name", (F.col("file_id") % 2).alias("half")).agg(F.min("line").cast("string").alias("signature"))
    return overlay.symbol_diff(s.where("half = 0"), s.where("half = 1"))


@query("select path, case when id % 3 = 0 then 'untracked' when id % 2 = 0 then 'staged' else 'committed' end as status from files_v")
def change_set(spark, d):
    f = V.files(spark, d)
    part = lambda cond, s: f.where(cond).select("path", F.lit(s).alias("status"))
    return overlay.merge_change_sets(part("true", "committed"), part("id % 2 = 0", "staged"), part("id % 3 = 0", "untracked"))


# --- telemetry ---------------------------------------------------------------------------------------------------------


@query("select rule, decision, count(*) as n from tel_v where hook_event = 'PreToolUse' and rule is not null group by 1, 2")
def rule_decisions(spark, d):
    return telemetry.rule_decisions(V.telemetry(spark, d))


_HITS = f"""
, j as (
  select a.id, a.rule, count(b.id) as hits from tel_v a left join tel_v b on b.hook_event = 'PostToolUse' and b.session_id = a.session_id and b.input_hash = a.input_hash and b.ts_ms between a.ts_ms and a.ts_ms + {DAYS_10}
  where a.hook_event = 'PreToolUse' and a.decision = 'ask' group by 1, 2)"""


@query(_HITS + " select rule, sum(greatest(hits, 1))::bigint as asks, sum(hits)::bigint as overridden from j group by 1")
def override_rate_raw(spark, d):
    return telemetry.overrides(V.telemetry(spark, d), DAYS_10)


@query(_HITS + " select rule, count(*) as asks, count(*) filter (hits > 0) as overridden from j group by 1")
def override_rate_distinct(spark, d):
    return telemetry.overrides(V.telemetry(spark, d), DAYS_10, distinct=True)


_PCT = """
pct as (select rule, l[least(len(l) - 1, floor(0.5 * len(l))::bigint) + 1] as p50, l[least(len(l) - 1, floor(0.95 * len(l))::bigint) + 1] as p95, l[least(len(l) - 1, floor(0.99 * len(l))::bigint) + 1] as p99
  from (select rule, list_sort(list(latency_us)) as l from tel_v where rule is not null and latency_us is not null group by 1))"""


@query(f", {_PCT.strip()} select * from pct")
def latency_percentiles(spark, d):
    return telemetry.latency_percentiles(V.telemetry(spark, d))


@query(_HITS + f""", {_PCT.strip()}, o as (select rule, sum(greatest(hits, 1)) as asks, sum(hits) as overridden from j group by 1),
g as (select rule, count(*) as events, coalesce(any_value(overridden / asks), 0)::double as rate, any_value(p50) as p50, any_value(p95) as p95 from tel_v left join o using (rule) left join pct using (rule) where hook_event = 'PreToolUse' group by 1)
select rule, events, round(rate, 6) as rate, case when events < 30 then 'insufficient_data' when rate > 0.10 then 'fail' when p50 > 50000 or p95 > 150000 then 'warn' else 'pass' end as verdict from g""")
def metrics_gate(spark, d):
    return telemetry.metrics_gate(V.telemetry(spark, d), DAYS_10)


@query("""
, a as (select count(*) as runs, count(*) filter (budget_tokens > 0 and total_tokens >= budget_tokens) as hits, avg(case when budget_tokens > 0 then total_tokens / budget_tokens end) as u, avg(skipped_count) as s, list_sort(list(timing_ms)) as l from pack_v)
select runs, hits, round(u, 6) as mean_use, round(s, 6) as mean_skipped, round(l[least(runs - 1, floor(0.5 * runs)::bigint) + 1], 2) as p50, round(l[least(runs - 1, floor(0.95 * runs)::bigint) + 1], 2) as p95,
  case when runs < 30 then 'insufficient_data' when hits / runs >= 0.4 or u >= 0.9 then 'fail' when hits / runs >= 0.2 or u >= 0.85 then 'warn' else 'pass' end as verdict from a""")
def pack_gate(spark, d):
    return telemetry.pack_gate(V.packs(spark, d))


@query("select count(*) as runs, sum(total_tokens)::bigint as tokens, round(avg(case when budget_tokens > 0 then total_tokens / budget_tokens else 0 end), 6) as mean_use from (select * from pack_v order by ts_ms desc, id desc limit 50)")
def ledger_summary(spark, d):
    return telemetry.ledger_summary(V.packs(spark, d))


@query("select hook_event, count(*) as n from (select hook_event, lag(hook_event) over (partition by session_id order by ts_ms, id) as b from tel_v where hook_event in ('opt_in', 'opt_out')) where b is distinct from hook_event group by 1")
def opt_transitions(spark, d):
    return telemetry.opt_transitions(V.telemetry(spark, d))


@query("select decision, count(*) as n, count(*) filter (ts_ms >= (select max(ts_ms) from tel_v) - 3600000) as recent from tel_v group by 1")
def decision_totals(spark, d):
    return telemetry.decision_totals(V.telemetry(spark, d))


@query("select id, ts_ms, rule from tel_v where ts_ms >= (select max(ts_ms) from tel_v) - 864000000 order by id desc limit 5000")
def retention(spark, d):
    return telemetry.retained(V.telemetry(spark, d), days=10, rows=5000).select("id", "ts_ms", "rule")


# --- semi-structured ---------------------------------------------------------------------------------------------------


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as value, json_exists(props, '$.k') as found from events")
def structured_query(spark, d):
    from quarry.sources.documents import value_at

    e = V.table(spark, d, "events")
    return e.select("event_id", value_at("props", "k", "long").alias("value"), value_at("props", "k", "long").isNotNull().alias("found"))


# --- paths, policy, output ---------------------------------------------------------------------------------------------

#: Names that the documents' paths end in, by doc_id.
NAMES = ["a.ts", "package.json", "tsconfig.base.json", "Cargo.lock", "b.PY", "c.yml", "d.txt", ".ts", "node_modules/e.js", "gen/f.go", "gen/keep.go", "target"]
COMMANDS = ["git commit -m x", "A=1 npm run test:unit && git push", "echo git commit", "cd a; pytest -q", "gh pr create", "go vet ./..."]


def _names(values: list[str], key: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(key) % len(values) + 1).cast("int"))


_PATHS = f"paths_v as (select doc_id, source || '/' || ({NAMES})[doc_id % {len(NAMES)} + 1] as path from documents)"


def _paths(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), _names(NAMES, "doc_id")).alias("path"))


@query()
def classify_paths(spark, d):
    from quarry.sources.scan import classify_path

    return _paths(spark, d).select("doc_id", classify_path("path").alias("c")).select("doc_id", "c.kind", "c.language")


_SQL["classify_paths"] = f"""with {_PATHS}, n as (select doc_id, lower(regexp_extract(path, '[^/]*$')) as name from paths_v),
e as (select *, regexp_extract(name, '^.+([.][^.]*)$', 1) as ext from n)
select doc_id,
  case when name in ('package.json') then 'package_json' when name = 'cargo.lock' then 'cargo_lock' when name like 'tsconfig%.json' then 'tsconfig_json'
       when ext in ('.ts', '.py', '.js', '.go') then 'source' when ext = '.yml' then 'yaml_generic' when ext = '.json' then 'json_generic' else 'ignored' end as kind,
  case ext when '.ts' then 'typescript' when '.py' then 'python' when '.js' then 'javascript' when '.go' then 'go' end as language
from e"""


@query()
def ignored_paths(spark, d):
    from quarry.sources.scan import ignored

    return _paths(spark, d).select("doc_id", ignored("path", ["gen/*.go", "*/gen/*.go", "!keep.go", "*.t?t"]).alias("ignored"))


_SQL["ignored_paths"] = f"""with {_PATHS}
select doc_id, path like '%/node_modules/%' or (path like '%/gen/%.go' and path not like '%/keep.go') or path like '%.txt' as ignored from paths_v"""


@query(f"""
select doc_id, case doc_id % 6 when 0 then 'commit' when 1 then 'push' when 4 then 'pr_create' end as trigger,
  case doc_id % 6 when 1 then 'npm run test:unit' when 3 then 'pytest -q' end as test from documents""")
def shell_triggers(spark, d):
    c = _names(COMMANDS, "doc_id")
    return V.table(spark, d, "documents").select("doc_id", policy.git_trigger(c).alias("trigger"), policy.test_command(c).alias("test"))


@query("""
select event_id, case when event_type = 'view' then 'grep-on-code' when event_type = 'click' and event_id % 3 <> 2 then 'read-on-structured'
    when event_type = 'click' then 'read-on-source' when event_type = 'purchase' then 'agent-discipline' end as rule,
  case when event_type = 'view' then case when event_id % 2 = 0 then 'allow' else 'deny' end when event_type = 'click' and event_id % 3 <> 2 then 'ask'
    when event_type = 'purchase' and event_id % 2 = 1 then 'deny' else 'allow' end as decision
from events""")
def policy_dispatch(spark, d):
    e = V.table(spark, d, "events")
    tool = F.when(F.col("event_type") == "view", "Grep").when(F.col("event_type") == "click", "Read").when(F.col("event_type") == "purchase", "Agent").otherwise("Bash")
    even = F.col("event_id") % 2 == 0
    glob = F.when(even, "*.MD").otherwise("*.ts")
    path = _names(["/w/package.json", "/w/x.toml", "/w/src/y.rs"], "event_id")
    prompt = F.when(even, "use quarry_find").otherwise("read the code")
    e = e.select("event_id", tool.alias("tool_name"), F.to_json(F.struct(glob.alias("glob"), path.alias("file_path"), prompt.alias("prompt"))).alias("tool_input"))
    return policy.dispatch(e, policy.default_rules("/w")).select("event_id", "rule", "decision")


@query("select name as nm, kind as k, line as l, end_line as el, scope as sc from sym_v")
def compact_symbols(spark, d):
    return compact.compact(V.symbols(spark, d).select("name", "kind", "line", "end_line", "scope"))


@query("select id, name as unknown, case when line % 3 = 0 then 'other' end as undocumented from sym_v where kind = 'function' and line % 3 = 0")
def stale_docs(spark, d):
    ship(spark)
    s = V.symbols(spark, d).withColumn("doc", F.concat(F.lit("/** Does it.\n * @param {T} "), "name", F.lit(" it */")))
    s = s.withColumn("signature", F.concat(F.lit("("), F.when(F.col("line") % 3 == 0, "other").otherwise(F.col("name")), F.lit(": Map<A, B> = f(1, 2)): void")))
    got = health.stale_docs(s, signature_params("signature"))
    return got.select("id", F.array_join("unknown", ",").alias("unknown"), F.array_join("undocumented", ",").alias("undocumented"))


PACK_BUDGET = 200


@query()
def pack_greedy(spark, d):
    c = V.table(spark, d, "conversations")
    items = c.select(F.col("conv_id").alias("query_id"), F.lit("B").alias("phase"), F.col("turn").alias("ord"), F.lit(None).cast("string").alias("grp"), F.col("turn").alias("key"), estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    got = pack.pack(items, PACK_BUDGET)
    return got.select(F.col("query_id").alias("conv_id"), "total", F.array_join("taken", ",").alias("taken"), F.array_join("skipped", ",").alias("skipped"))


_SQL["pack_greedy"] = f"""with recursive t as (
  select conv_id, turn, ceil(length(coalesce(text, '')) / 4.0)::bigint as tokens, row_number() over (partition by conv_id order by turn) as n from conversations),
r as (
  select conv_id, 0::bigint as n, 0::bigint as total, []::varchar[] as taken, []::varchar[] as skipped, false as stop from t group by 1 union all
  select r.conv_id, t.n, case when stop or total + tokens > {PACK_BUDGET} * 0.6 then total else total + tokens end,
    case when stop or total + tokens > {PACK_BUDGET} * 0.6 then taken else list_append(taken, turn::varchar) end,
    case when not stop and total + tokens > {PACK_BUDGET} * 0.6 then list_append(skipped, turn::varchar) else skipped end,
    stop or (total + tokens > {PACK_BUDGET} * 0.6 and total >= {PACK_BUDGET} * 0.6)
  from r join t on t.conv_id = r.conv_id and t.n = r.n + 1)
select conv_id, max_by(total, n) as total, array_to_string(max_by(taken, n), ',') as taken, array_to_string(max_by(skipped, n), ',') as skipped from r group by 1"""


def _event_rows(spark, d):
    t = V.telemetry(spark, d)
    return t.withColumn("ts", F.timestamp_millis("ts_ms"))


@query("select ts_ms - ts_ms % 3600000 as start_ms, rule, decision, count(*) as n from tel_v where rule is not null group by 1, 2, 3")
def decision_windows(spark, d):
    from quarry.streaming import telemetry as streaming

    return streaming.decisions(_event_rows(spark, d)).select(F.unix_millis("start").alias("start_ms"), "rule", "decision", "n")


@query(f"""
select a.id, a.rule, b.id as post_id from tel_v a left join tel_v b
  on b.hook_event = 'PostToolUse' and a.session_id = b.session_id and a.input_hash = b.input_hash and b.ts_ms between a.ts_ms and a.ts_ms + {DAYS_10}
where a.hook_event = 'PreToolUse' and a.decision = 'ask'""")
def override_pairs(spark, d):
    from quarry.streaming import telemetry as streaming

    return streaming.overrides(_event_rows(spark, d), DAYS_10).select("id", "rule", "post_id")


@query("""
, ended as (
  select s.*, path, coalesce(end_line, lead(s.line) over (partition by s.file_id order by s.line, s.id) - 1, least(s.line + 49, n_lines)) as e
  from sym_v s join (select file_id, count(*) as n_lines from lines_v group by 1) l on l.file_id = s.file_id join files_v f on f.id = s.file_id),
r as (select id as root_id, file_id as root_file, name as root_name, line as start, e as stop from ended where kind = 'class'),
u as (select root_id, root_file, start, stop, o.name as used, min(o.line * 1000000 + o.col) as first from r join occ_v o on root_file = o.file_id and o.line between start and stop and o.name <> root_name group by 1, 2, 3, 4, 5),
c as (
  select root_id, used, first, s.id, s.path, s.line, case when s.file_id = root_file then 0 when exists (select 1 from imp_v i where i.file_id = root_file and i.resolved_file_id = s.file_id) then 1 else 2 end as preference
  from u join ended s on s.name = used where s.id <> root_id and not (s.file_id = root_file and s.line between start and stop)),
b as (select root_id, used, first, id, preference, row_number() over (partition by root_id, used order by preference, path, line, id) as k from c),
n as (select root_id, row_number() over (partition by root_id order by first, used) as ord, id, used as name, preference, first from b where k = 1),
x as (select root_id, true as truncated from n join (select root_id, max(first) as last from u group by 1) using (root_id) where ord = 20 and last > first),
a as (
  select root_id, ord, id, name, preference from n where ord <= 20
  union all select root_id, 0, root_id, root_name, null from r)
select root_id, ord, id, a.name, preference, coalesce(truncated, false) as truncated, array_to_string((string_split(text, chr(10)))[s.line:s.e], chr(10)) as source
from a left join x using (root_id) join ended s using (id) join documents on doc_id = s.file_id""")
def slice_bodies(spark, d):
    t = V.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    ended = staged(spans.end_lines(V.symbols(spark, d), t.select("file_id", F.size(F.split("text", "\n")).alias("n_lines"))), "ended")
    paths = V.files(spark, d).select(F.col("id").alias("file_id"), "path")
    return source.whole_slices(ended.where("kind = 'class'"), ended, V.occurrence_lines(spark, d), V.imports(spark, d), t, paths)


@query("""
select id, file_id, case when file_id = 17 then 0 when file_id in (select resolved_file_id from imp_v where file_id = 17) then 1 else 2 end as preference
from sym_v where name = 'The' order by preference, id limit 1""")
def definition_at(spark, d):
    return source.definition_at(V.symbols(spark, d), V.imports(spark, d), 17, "The").select("id", "file_id", "preference")


@query("""
, l as (select f.language, f.status, f.id, (select count(*) from sym_v s where s.file_id = f.id) as n from files_v f)
select 'status' as section, status as key, count(*) as value from l group by 2 union all select 'files', language, count(*) from l group by 2
union all select 'symbols', language, sum(n)::bigint from l group by 2 union all select 'total', 'files', count(*) from l union all select 'total', 'symbols', sum(n)::bigint from l""")
def stats(spark, d):
    return source.stats(V.files(spark, d), V.symbols(spark, d))


from quarry import registry_more  # noqa: E402,F401  (adds its queries)
