from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import graph, health, lookup, overlay, spans, telemetry
from quarry.sources import documents


def files(spark):
    rows = [(1, "src/utils.ts", "typescript", "indexed"), (2, "src/components/Button.tsx", "typescriptreact", "indexed"), (3, "src/broken.ts", "typescript", "error"), (4, "src/utils.test.ts", "typescript", "indexed")]
    return spark.createDataFrame(rows, "id long, path string, language string, status string")


def symbols(spark):
    rows = [(1, 1, "formatDate", "function", 5, 9, None), (2, 1, "parseDate", "function", 15, None, None), (3, 2, "Button", "component", 10, 30, None), (4, 2, "inner", "function", 12, 14, "Button"), (5, 2, "ButtonProps", "interface", 3, None, None)]
    return spark.createDataFrame(rows, "id long, file_id long, name string, kind string, line int, end_line int, scope string")


def test_find_prefers_exact_then_any_case(spark):
    s, f = symbols(spark), files(spark)
    assert [r.id for r in lookup.find(s, f, "Button").collect()] == [3]
    assert [r.id for r in lookup.find(s, f, "BUTTON").collect()] == [3]
    assert lookup.find(s, f, "nothing").count() == 0
    assert lookup.find(s, f, "button", "function").count() == 0


def test_find_file_ladder(spark):
    f = files(spark)
    assert [lookup.find_file(f, p).first().id for p in ("src/utils.ts", "SRC/UTILS.TS", "button.tsx")] == [1, 1, 2]


def test_enclosing_takes_the_smallest_interval(spark):
    o = spark.createDataFrame([(2, 13, 1), (2, 20, 1), (2, 2, 1)], "file_id long, line int, col int")
    for bin_lines in (1, 5, 256):
        got = {r.line: r.enclosing_id for r in spans.enclosing(o, symbols(spark), bin_lines).collect()}
        assert got == {13: 4, 20: 3}


def test_end_lines_fall_back(spark):
    n = spark.createDataFrame([(1, 40), (2, 100)], "file_id long, n_lines long")
    got = {r.id: r.end for r in spans.end_lines(symbols(spark), n).collect()}
    assert got == {1: 9, 2: 40, 3: 30, 4: 14, 5: 9}


def test_outline_nests_one_level(spark):
    got = {r.id: r.parent_id for r in spans.outline(symbols(spark)).collect()}
    assert got[4] == 3 and got[3] is None


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = {r.node: r.depth for r in graph.bounded_closure(e, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_paths_resolve_by_order_of_candidates(spark):
    f = spark.createDataFrame([(1, "src/a.ts"), (2, "src/lib/index.ts"), (3, "lib.ts"), (4, "src/b.tsx")], "id long, path string")
    e = spark.createDataFrame([(1, "./lib", 1), (1, "../lib", 2), (1, "./b.jsx", 3), (1, "./none", 4), (1, "react", 5)], "file_id long, source string, line int")
    got = {r.line: r.resolved_file_id for r in graph.resolve_paths(e, f).collect()}
    assert got == {1: 2, 2: 3, 3: 4, 4: None}


def test_unused_exports_runtime_only(spark):
    x = spark.createDataFrame([(1, "PublicType", 1, "export", False)], "file_id long, name string, line int, kind string, is_star boolean")
    i = spark.createDataFrame([(2, "PublicType", 1, True, False, False)], "file_id long, name string, resolved_file_id long, is_type boolean, is_star boolean, is_default boolean")
    o = spark.createDataFrame([(2, "PublicType", 4, "type-ref")], "file_id long, name string, line int, ref_kind string")
    assert health.unused_exports(x, i, o).count() == 0
    assert [r.symbol_kind for r in health.unused_exports(x, i, o, symbols(spark), runtime_only=True).collect()] == ["export"]


def test_scores(spark):
    names = ["formatDate", "FormatDate", "formatDateLong", "myformatDate", "fXoYrZm", "zzz"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("s", text.fuzzy_score("formatDate", "n")).withColumn("t", text.fuzzy_score("form", "n"))
    got = {r.n: (r.s, r.t) for r in df.collect()}
    assert got["formatDate"][0] == 1.0 and got["FormatDate"][0] == 0.95 and got["formatDateLong"][0] == 0.9
    assert 0.7 <= got["myformatDate"][0] <= 0.85
    assert 0.1 <= got["fXoYrZm"][1] <= 0.6 and got["zzz"] == (0.0, 0.0)


def test_tokens_and_paths(spark):
    r = spark.createDataFrame([("getUser_name",)], "n string").select(text.tokens_of("n").alias("t")).first()
    assert r.t == ["get", "User", "name"]
    paths = ["src/utils.test.ts", "src/__tests__/utils.ts", "tests/integration/x.ts", "src/consumer.ts", "a/test.ts"]
    got = [x.t for x in spark.createDataFrame([(p,) for p in paths], "p string").select(text.test_path("p").alias("t")).collect()]
    assert got == ["declared", "declared", "derived", None, None]


def test_overlay_of_nothing_is_the_base(spark):
    f = files(spark)
    none = f.limit(0)
    assert sorted(overlay.merge_files(f, none, none).collect()) == sorted(f.collect())
    merged = overlay.merge_files(f, f, none)
    assert sorted(r.id for r in merged.collect()) == [-4, -3, -2, -1]


def test_changes(spark):
    a = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 2, 1, "h"), ("edited", 2, 1, "x"), ("new", 1, 1, "h")], "path string, mtime long, size long, hash string")
    b = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 1, 1, "h"), ("edited", 1, 1, "h"), ("gone", 1, 1, "h")], "path string, mtime long, size long, hash string")
    got = {r.path: r.action for r in overlay.detect_changes(a, b).collect()}
    assert got == {"same": "unchanged", "touched": "hash_only", "edited": "update", "new": "add", "gone": "delete"}


def test_percentile_is_the_references_rank(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(30)], "g int, v double")
    r = telemetry.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (r.p50, r.p99) == (15.0, 29.0)


def test_override_rate_fails_the_gate(spark):
    rows = [(i, i * 1000, "s", "PreToolUse", "r", "ask", 10, f"h{i}") for i in range(30)] + [(100 + i, i * 1000 + 100, "s", "PostToolUse", None, None, None, f"h{i}") for i in range(10)]
    e = spark.createDataFrame(rows, "id long, ts_ms long, session_id string, hook_event string, rule string, decision string, latency_us long, input_hash string")
    r = telemetry.overrides(e).first()
    assert (r.asks, r.overridden) == (30, 10)
    g = telemetry.metrics_gate(e)
    assert g.first().verdict == "fail" and telemetry.overall(g).first().verdict == "fail"


def test_documents():
    assert documents.parse('{"a": [1, 2,], // c\n "u": "http://x"}', "x.json") == {"a": [1, 2], "u": "http://x"}
    y = documents.parse("jobs:\n  test:\n    steps:\n      - run: npm test\n        name: t\n      - uses: x\non: [push, pull]\n", "ci.yml")
    assert documents.dotted(y, "jobs.test.steps.0.run") == (True, "npm test") and y["on"] == ["push", "pull"]
    assert documents.lockfile_deps('"@a/b@^1", c@2:\n  version "1.2.3"\n', "yarn.lock") == [("@a/b", "1.2.3")]
    assert documents.lockfile_deps('{"packages": {"": {}, "node_modules/x": {"version": "2.0"}}}', "package-lock.json") == [("x", "2.0")]
    assert documents.lockfile_deps("packages:\n  /@s/p@1.0.0(peer@2):\n    dev: true\n", "pnpm-lock.yaml") == [("@s/p", "1.0.0")]
    assert documents.lockfile_deps('[[package]]\nname = "n"\nversion = "0.1"\n', "Cargo.lock") == [("n", "0.1")]


def test_value_at(spark):
    df = spark.createDataFrame([('{"a": {"0": 5}, "b": [7]}',), ("no json",)], "j string")
    got = df.select(documents.value_at("j", "b.0", "long").alias("x"), documents.value_at("j", "a.0", "long").alias("y")).collect()
    assert [tuple(r) for r in got] == [(7, 5), (None, None)]
