import json
import os
import subprocess

from pyspark.sql import functions as F

from quarry.functions.signature import parameters
from quarry.operators import compact, pack, policy
from quarry.sources import publish, scan
from quarry.streaming import telemetry


def test_classify_path(spark):
    want = {
        "a/Package.JSON": ("package_json", None), "tsconfig.x.json": ("tsconfig_json", None), ".github/workflows/ci.yaml": ("gha_workflow", None), ".github/workflows/x/ci.yaml": ("yaml_generic", None),
        "src\\a.TSX": ("source", "typescript"), "a.pyx": ("source", "python"), ".ts": ("ignored", None), "a.": ("ignored", None), "README.md": ("ignored", None), "": ("ignored", None),
    }
    df = spark.createDataFrame([(p,) for p in want], "path string").select("path", scan.classify_path("path", {"python": ["pyx"]}).alias("c"))
    assert {r.path: (r.c.kind, r.c.language) for r in df.collect()} == want


def test_ignored(spark):
    lists = ["# note", "", "*.log", "!keep.log", "/top.py", "docs/**/x.py", "gen/", "[ab]z.py", "one[.py"]
    want = {
        "node_modules/a.js": True, "x/dist/a.js": True, "dist": False, "a.log": True, "x/keep.log": False, "top.py": True, "x/top.py": False, "docs/x.py": True, "docs/a/b/x.py": True, "gen/a.py": True, "gen": False,
        "az.py": True, "cz.py": False, "one[.py": True, "src/a.py": False,
    }
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.i for r in df.select("path", scan.ignored("path", lists).alias("i")).collect()} == want
    assert spark.range(1).select(scan.ignored(F.lit("dist"), is_dir=True).alias("i")).first().i


def test_scan_and_git(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/__init__.py").write_text("x = 1\n")
    (tmp_path / "pkg/min.js").write_text("a" * 2000)
    (tmp_path / "pkg/a.ts").write_text("let a\n")
    (tmp_path / "README.md").write_text("no\n")
    (tmp_path / ".gitignore").write_text("a.ts\n")
    got = {r.path: r for r in scan.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"pkg/__init__.py"} and got["pkg/__init__.py"].text == "x = 1\n" and got["pkg/__init__.py"].size == 6
    stored = {r.path: r for r in scan.scan_store(spark, str(tmp_path)).collect()}
    assert set(stored) == {"pkg/a.ts"} and stored["pkg/a.ts"].language == "typescript"
    git = ["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b"]
    for args in (["init", "-q"], ["add", "-A"], ["commit", "-qm", "one"]):
        subprocess.run([*git, *args], check=True)
    (tmp_path / "pkg/b.py").write_text("y = 2\n")
    (tmp_path / "pkg/__init__.py").write_text("x = 2\n")
    for args in (["add", "-A"], ["commit", "-qm", "two"]):
        subprocess.run([*git, *args], check=True)
    assert {r.path for r in scan.scan(spark, str(tmp_path)).collect()} == {"pkg/__init__.py", "pkg/b.py"}
    assert {(r.path, r.status) for r in scan.git_changes(spark, str(tmp_path), "HEAD~1").collect()} == {("pkg/__init__.py", "M"), ("pkg/b.py", "A")}
    assert scan.git_show(str(tmp_path), "HEAD~1", "pkg/__init__.py") == "x = 1\n" and scan.git_show(str(tmp_path), "HEAD~1", "pkg/b.py") is None


def test_parameters():
    assert parameters("(a: Map<A, B>, b = f(1, ','), ...c: T[], {d}: E, private readonly e?: F) => void") == ["a", "b", "c", None, "e"]
    assert parameters("()") == [] and parameters("(a") == [] and parameters(None) == [] and parameters("x") == []


def test_compact(spark):
    df = spark.createDataFrame([("f", "", True, False, [("", 1)], [])], "name string, doc string, is_default boolean, is_star boolean, callers array<struct<name string, line int>>, names array<string>")
    assert json.loads(compact.compact_json(df).first().json) == {"nm": "f", "id": True, "cl": [{"l": 1}]}


def test_pack_phases(spark):
    rows = [("A", 1, None, "o1", 50), ("A", 2, None, "o2", 20), ("A", 3, None, "o3", 1), ("B", 1, None, "s1", 80), ("B", 2, None, "s2", 60), ("B", 3, None, "s1", 1), ("C", 1, "f", "o2", 60), ("C", 2, "f", "o4", 30), ("C", 3, "f", "o5", 1), ("C", 4, "g", "o6", 5), ("C", 5, "g", "o1", 1)]
    df = spark.createDataFrame([(1, *r) for r in rows], "query_id long, phase string, ord long, grp string, key string, tokens long")
    got = pack.pack(df, 200).first()
    # o2 passes 30 %, so o3 isn't tried; s1 fits no more below 60 %
    assert got.taken == ["o1", "s2", "s1", "o2", "o6"] and got.skipped == ["o2", "s1", "o4"] and got.total == 176


def test_policy(spark):
    rows = [("Grep", {"pattern": "x"}), ("Grep", {"path": "node_modules/x"}), ("Agent", {"subagent_type": "Explore", "prompt": "go"}), ("Agent", {"description": "Commit it"}), ("Read", {"file_path": "/w/a/Cargo.toml"}), ("Read", {"file_path": "/w/a.ts", "limit": 1}), ("Read", {"file_path": "C:\\w\\a.ts"}), ("Bash", {"command": "ls"}), ("Read", {})]
    df = spark.createDataFrame([(k, t, json.dumps(i)) for k, (t, i) in enumerate(rows)], "id int, tool_name string, tool_input string")
    got = {r.id: (r.rule, r.decision, r.additional_context is not None) for r in policy.dispatch(df, policy.default_rules("/w")).collect()}
    assert got == {
        0: ("grep-on-code", "deny", False), 1: ("grep-on-code", "allow", False), 2: ("agent-discipline", "deny", False), 3: ("agent-discipline", "allow", False), 4: ("read-on-structured", "ask", False),
        5: (None, "allow", False), 6: ("read-on-source", "allow", True), 7: (None, "allow", False), 8: (None, "allow", False),
    }
    e = spark.createDataFrame([("PostToolUse", "Bash", "s", 5, '{"command": "CI=1 pytest -q; ls"}', '{"exit_code": 0}'), ("PostToolUse", "Bash", "s", 6, '{"command": "pytest"}', '{"exit_code": 1}')], "hook_event string, tool_name string, session_id string, ts_ms long, tool_input string, tool_response string")
    assert [tuple(r) for r in policy.test_runs(e).collect()] == [("s", 5, "pytest -q")]


def test_publish(spark, tmp_path):
    root = str(tmp_path / "index")
    files = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, None)], "file_id long, resolved_file_id long")
    assert publish.publish(spark, root, {"files": files, "module_edges": edges}, {"git_head": "x"}) == 1
    kept = publish.delete_files({n: publish.load(spark, root, n) for n in ("files", "module_edges")}, files.where("id = 2"))
    assert publish.publish(spark, root, kept, {"mode": "incremental"}) == 2
    assert [r.id for r in publish.load(spark, root, "files").collect()] == [1]
    assert [tuple(r) for r in publish.load(spark, root, "module_edges").collect()] == [(1, None), (1, None)]
    assert publish.meta(spark, root) == {"git_head": "x", "mode": "incremental"} and publish.broken(spark, root) == []
    assert publish.prune_versions(spark, root, 1) == [1] and publish.load(spark, root, "files").count() == 1
    assert publish.since("2h", 10_000_000) == 2_800_000 and publish.since("soon", 0) == -30 * 86_400_000


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"id": k, "ts": f"2026-01-01T00:{k % 60:02d}:00Z", "session_id": "s", "hook_event": "PostToolUse" if k % 3 == 0 else "PreToolUse", "rule": "r", "decision": "ask", "input_hash": str(k % 4)} for k in range(40)]
    (tmp_path / "in").mkdir()
    for k in (0, 20):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k : k + 20]))
    (tmp_path / "in/z.json").write_text(json.dumps(rows[0] | {"id": 99, "ts": "2026-01-03T00:00:00Z", "rule": "z", "input_hash": "z"}) + "\n" + json.dumps(rows[1] | {"id": 98, "ts": "2026-01-03T00:00:00Z", "rule": "z", "input_hash": "y"}))
    for age, name in enumerate(("z", "20", "0")):  # files arrive by their time
        os.utime(tmp_path / f"in/{name}.json", (1_800_000_000 - age,) * 2)
    stream = telemetry.read_events(spark, str(tmp_path / "in"), 1)
    batch = spark.read.schema(telemetry.EVENTS).json(str(tmp_path / "in"))
    for name, f in (("d", telemetry.decisions), ("o", telemetry.overrides)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = sorted(map(str, f(batch.where("id < 90")).collect()))
        assert sorted(map(str, spark.table(name).collect())) == want and want
    telemetry.append(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    telemetry.append(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 42
