import json
import subprocess

import pytest

from quarry.operators import pack, search, source
from quarry.sources import build, documents, publish, scan

META = {"config_hash": "c", "root": "/w", "git_head": "abc", "clean_at_index_time": True}


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "w"
    (root / "src").mkdir(parents=True)
    (root / "src/a.ts").write_text("export class A {\n  run() {\n    go();\n  }\n}\n")
    (root / "src/b.ts").write_text('import { A as Base } from "./a";\nimport * as ns from "./a";\nexport class B extends Base {}\nclass C extends ns.A {}\n')
    (root / "src/bad.py").write_text("def (:\n")
    git(root, "init", "-q")
    git(root, "add", ".")
    git(root, "commit", "-qm", "one")
    return root


def names(tables):
    at = {r.id: r.path for r in tables["files"].collect()}
    of = {r.id: (at[r.file_id], r.name) for r in tables["symbols"].collect()}
    return {(of[r.source_id], r.target_name, of.get(r.target_id)) for r in tables["relations"].collect()}


def load(spark, at):
    return {t: publish.load(spark, at, t) for t in ("files", "symbols", "edges", "occurrences", "relations")}


def test_build_and_rebuild(spark, tree, tmp_path):
    at = f"file://{tmp_path}/index"
    said = build.build(spark, scan.scan(spark, str(tree)), at, META)
    assert (said["mode"], said["version"], said["scanned"], said["indexed"], said["errored"], said["status"]) == ("full", 1, 3, 2, 1, "partial")
    assert names(load(spark, at)) == {(("src/b.ts", "B"), "Base", ("src/a.ts", "A")), (("src/b.ts", "C"), "ns.A", ("src/a.ts", "A"))}
    errors = {r.path: r.error for r in load(spark, at)["files"].collect()}
    assert "SyntaxError" in errors["src/bad.py"] and errors["src/a.ts"] is None
    ids = {r.path: r.id for r in load(spark, at)["files"].collect()}
    # nothing changed: nothing is extracted, and the ids hold
    said = build.build(spark, scan.scan(spark, str(tree)), at, META)
    assert (said["mode"], said["changes"]) == ("incremental", {"unchanged": 3}) and {r.path: r.id for r in load(spark, at)["files"].collect()} == ids
    (tree / "src/a.ts").write_text("export class Other {}\n")
    (tree / "src/bad.py").unlink()
    (tree / "src/c.py").write_text("class D: pass\n")
    said = build.build(spark, scan.scan(spark, str(tree)), at, META)
    assert (said["mode"], said["changes"], said["status"]) == ("incremental", {"unchanged": 1, "update": 1, "delete": 1, "add": 1}, "ok")
    assert names(load(spark, at)) == {(("src/b.ts", "B"), "Base", None), (("src/b.ts", "C"), "ns.A", None)}
    assert {r.path for r in load(spark, at)["files"].collect()} == {"src/a.ts", "src/b.ts", "src/c.py"}
    # other settings ask for a full build, and so does force
    assert build.build(spark, scan.scan(spark, str(tree)), at, META | {"config_hash": "d"})["mode"] == "full"
    assert build.build(spark, scan.scan(spark, str(tree)), at, META | {"config_hash": "d"}, force=True)["mode"] == "full"
    assert build.refresh(spark, scan.scan(spark, str(tree)), at, META, 1_000, 30_000) is None
    assert build.refresh(spark, scan.scan(spark, str(tree)), at, META | {"config_hash": "d"}, 1_000, 31_000)["mode"] == "incremental"


def test_overlay(spark, tree, tmp_path):
    base, at = f"file://{tmp_path}/index", f"file://{tmp_path}/overlay"
    build.build(spark, scan.scan(spark, str(tree)), base, META)
    git(tree, "rm", "-q", "src/bad.py")
    (tree / "src/a.ts").write_text("export class A {}\nexport class New extends A {}\n")
    git(tree, "add", "src/a.ts")
    (tree / "src/b.ts").write_text('import { New } from "./a";\nexport class B2 extends New {}\n')
    (tree / "src/d.ts").write_text('import { B2 } from "./b";\nexport class D extends B2 {}\n')
    (tree / "notes.md").write_text("x")
    changed = scan.working_changes(spark, str(tree), "HEAD")
    assert {(r.path, r.status) for r in changed.collect()} == {("src/bad.py", "D"), ("src/a.ts", "M"), ("src/b.ts", "M"), ("src/d.ts", "A"), ("notes.md", "A")}
    now = scan.scan(spark, str(tree))
    changes = changed.join(now, "path", "left")
    full = lambda: (now, META)
    said = build.build_overlay(spark, base, at, changes, True, full, "def")
    assert (said["kind"], said["indexed"]) == ("overlay", 3) and publish.meta(spark, at)["git_head"] == "def"
    got = build.merged(spark, at)
    assert {r.path for r in got["files"].collect()} == {"src/a.ts", "src/b.ts", "src/d.ts"}
    assert names(got) == {(("src/a.ts", "New"), "A", ("src/a.ts", "A")), (("src/b.ts", "B2"), "New", ("src/a.ts", "New")), (("src/d.ts", "D"), "B2", ("src/b.ts", "B2"))}
    # gates: a full index instead
    more = changes.unionByName(spark.createDataFrame([(".gitignore", "M")], "path string, status string"), allowMissingColumns=True)
    none = f"file://{tmp_path}/none"
    for where, what, reachable, reason in ((none, changes, True, "parent_index_missing"), (base, changes, False, "diff_base_unreachable"), (base, more, True, "config_diverged")):
        said = build.build_overlay(spark, where, f"file://{tmp_path}/full-{reason}", what, reachable, full)
        assert (said["kind"], said["reason"], said["indexed"]) == ("isolated", reason, 3)
    assert names(load(spark, f"file://{tmp_path}/full-config_diverged")) == names(got)


def test_workspaces_and_settings(tree, tmp_path):
    assert build.detect_workspace(str(tree / "src")) == {"mode": "main", "root": str(tree), "git_dir": str(tree / ".git")}
    git(tree, "worktree", "add", "-q", str(tmp_path / "other"), "-b", "other")
    got = build.detect_workspace(str(tmp_path / "other"))
    assert got["mode"] == "worktree" and got["root"] == str(tmp_path / "other") and got["parent_root"] == str(tree)
    alone = tmp_path / "alone/below"
    alone.mkdir(parents=True)
    (tmp_path / "alone/.quarry.json").write_text('{"exclude": ["x"], "unknown": 1, "telemetry": false}')
    assert build.detect_workspace(str(alone)) == {"mode": "standalone", "root": str(tmp_path / "alone")}
    c = build.load_config(str(tmp_path / "alone"))
    assert c.exclude == ["x"] and c.max_file_size == 1 << 20 and build.config_hash(c) != build.config_hash(build.Config())
    assert [build.telemetry_on(e, c) for e in (None, "1", "0")] == [False, True, False] and build.telemetry_on(None, build.load_config(str(alone)))
    assert scan.is_ancestor(str(tree), "HEAD") and not scan.is_ancestor(str(tree), "nowhere")


def test_records_and_repair(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    df = spark.range(5)
    publish.publish(spark, at, {"a": df}, {"k": 1})
    publish.publish(spark, at, {"a": df.where("id > 2")})
    assert publish.repair(spark, at) == [] and publish.load(spark, at, "a").count() == 2
    for f in (tmp_path / "t/version=2/a").glob("*.parquet"):
        f.write_bytes(b"broken")
    assert publish.repair(spark, at) == ["a"] and publish.load(spark, at, "a").count() == 5
    record = publish.recorder(f"file://{tmp_path}/log")
    assert record(df) and record(df) and spark.read.parquet(f"{tmp_path}/log").count() == 10
    (tmp_path / "file").write_text("x")
    with pytest.warns(UserWarning):
        assert not publish.recorder(f"file://{tmp_path}/file/log")(df)
    assert not publish.purge(spark, f"file://{tmp_path}/log") and publish.purge(spark, f"file://{tmp_path}/log", sure=True) and not (tmp_path / "log").exists()


def test_typed_documents():
    p = documents.typed(json.loads('{"name": "n", "version": 3, "scripts": {"a": "b"}, "other": 1}'), "package_json")
    assert p == {"name": "n", "scripts": {"a": "b"}}
    c = documents.typed(documents.parse('[package]\nname = "x"\nversion = 1\n[workspace]\nmembers = ["a", 2]\n[dev-dependencies]\nq = "1"\n', "Cargo.toml"), "cargo_toml")
    assert c == {"package": {"name": "x"}, "dev-dependencies": {"q": "1"}, "workspace": {}}
    w = documents.typed(documents.parse("name: CI\non: [push]\njobs:\n  a:\n    runs-on: [x, y]\n    steps:\n      - run: go\n        shell: sh\n  b: 3\n", "w.yml"), "gha_workflow")
    assert w == {"name": "CI", "on": ["push"], "jobs": {"a": {"runs-on": ["x", "y"], "steps": [{"run": "go"}]}}}
    with pytest.raises(ValueError):
        documents.typed([1], "cargo_toml")


def test_suggestions(spark):
    df = spark.createDataFrame([(1, "fetchUser"), (2, "UserList"), (3, "zip")], "id long, name string").selectExpr("id", "name", "cast(null as string) as base", "cast(null as string) as scope", "cast(null as string) as doc")
    assert [r.name for r in search.suggestions(df, "fetchusr").collect()] == ["fetchUser"]
    # parts are looked at only where the whole finds nothing
    got = search.search_or_suggest(df, "Qqx9User_zz").collect()
    assert [(r.id, r.name, r.suggested) for r in got] == [(None, "UserList", True), (None, "fetchUser", True)] and abs(got[0].score - 0.63) < 1e-9
    assert [(r.id, r.suggested) for r in search.search_or_suggest(df, "zip").collect()] == [(3, False)]


def test_slices_match_all_pairs(spark):
    import random

    rng = random.Random(5)
    symbols = [(f * 100 + k, f, rng.choice("abcdefgh") * 2, k * 4, k * 4 + rng.randint(0, 9)) for f in range(12) for k in range(6)]
    occ = [(f, rng.choice("abcdefgh") * 2, rng.randint(0, 30), c) for f in range(12) for c in range(25)]
    imports = [(f, rng.randrange(12)) for f in range(12) for _ in range(2)]
    s = spark.createDataFrame(symbols, "id long, file_id long, name string, line int, end int")
    got = source.slices(s, s, spark.createDataFrame(occ, "file_id long, name string, line int, col int"), spark.createDataFrame(imports, "file_id long, resolved_file_id long"), 50).collect()
    want = set()
    for i, f, n, a, b in symbols:
        for used in {x[1] for x in occ if x[0] == f and a <= x[2] <= b and x[1] != n}:
            c = [(0 if y[1] == f else 1 if (f, y[1]) in imports else 2, y[0]) for y in symbols if y[2] == used and y[0] != i and not (y[1] == f and a <= y[3] <= b)]
            if c:
                want.add((i, used, min(c)[1], min(c)[0]))
    assert {(r.root_id, r.name, r.id, r.preference) for r in got} == want


def test_slices_of_lines(spark, monkeypatch):
    """Lines taken apart give what occurrences give: bodies over several bins, ties, few names at the executors, small limits."""
    import random

    rng = random.Random(6)
    words = [a + b for a in "abcdef" for b in "xyz"]
    symbols = [(f * 100 + k, f, rng.choice(words[: 6 + f]), k * 90, k * 90 + rng.choice([0, 5, 400])) for f in range(12) for k in range(9)]
    lines = [(f, n, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for f in range(12) for n in range(0, 900, 3)] + [(3, 4, "")]
    s = spark.createDataFrame(symbols, "id long, file_id long, name string, line int, end int")
    occ = spark.createDataFrame([(f, w, n, c) for f, n, t in lines for c, w in enumerate(t.split())], "file_id long, name string, line int, col int").repartition(3)
    imports = spark.createDataFrame([(f, rng.randrange(12)) for f in range(12) for _ in range(2)] + [(1, None)], "file_id long, resolved_file_id long")
    by_line = spark.createDataFrame(lines, "file_id long, line int, names string").repartition(4)
    get = lambda o, limit: sorted(tuple(r) for r in source.slices(s, s, o, imports, limit).collect())
    whole = get(occ, 50)
    for usual, limit in ((50_000, 50), (3, 4), (0, 50), (50_000, 2)):
        monkeypatch.setattr(source, "USUAL", usual)
        want = [r for r in whole if r[1] <= limit]
        assert get(by_line, limit) == get(occ, limit) == want and len(want) > 150


def test_whole_slices(spark, monkeypatch):
    """Every step against plain Python: roots and their sources, ends by fallback, kinds of uses, order by path, truncation."""
    import random

    from quarry.operators import spans

    rng = random.Random(8)
    words = [a + b for a in "abcdef" for b in "xyz"] + ["q"]
    texts = {f: [" ".join(rng.choice(words) for _ in range(rng.randint(0, 3))) for _ in range(rng.choice([30, 700]))] for f in range(10)}
    path = {f: f"p{(f * 7) % 10}/f" for f in texts}
    symbols = []  # ids against the order of paths and lines; two on a line, some without an end
    for f, lines in texts.items():
        for k in range(9):
            at = rng.randrange(1, len(lines) - 10) // (2 if k % 2 else 1) + 1
            symbols.append((9000 - f * 100 - k, f, rng.choice(words[: 6 + f]), at, k, rng.choice([None, at, at + 5, min(at + 420, len(lines))])))
        symbols += [(f * 100 + 9500, f, "ax", 3, 20, 3), (f * 100 + 9502, f, "bx", 4, 21, None), (f * 100 + 9501, f, "cx", 4, 22, None)]
    occ = [(f, w, n + 1, c, ("call", "read", None)[(n + c) % 3]) for f, lines in texts.items() for n, t in enumerate(lines) for c, w in enumerate(t.split())]
    imports = [(f, rng.randrange(10)) for f in texts for _ in range(2)] + [(1, None)]
    s = spark.createDataFrame(symbols, "id long, file_id long, name string, line int, col int, end_line int")
    counts = spark.createDataFrame([(f, len(x)) for f, x in texts.items()], "file_id long, n_lines int")
    ended = spans.end_lines(s, counts)
    ends = {}
    for f, lines in texts.items():
        of = sorted((y for y in symbols if y[1] == f), key=lambda y: y[3:5])
        ends |= {y[0]: y[5] if y[5] is not None else z[3] - 1 if z else min(y[3] + 49, len(lines)) for y, z in zip(of, [*of[1:], None])}
    assert sum(r[5] is None for r in symbols) > 10 and sum(ends[r[0]] // 256 > r[3] // 256 for r in symbols) > 5
    o = spark.createDataFrame(occ, "file_id long, name string, line int, col int, ref_kind string").repartition(3)
    by_line = spark.createDataFrame([(f, n + 1, t) for f, lines in texts.items() for n, t in enumerate(lines)], "file_id long, line int, names string")
    t = spark.createDataFrame([(f, "\n".join(x)) for f, x in texts.items()], "file_id long, text string")
    i, p = spark.createDataFrame(imports, "file_id long, resolved_file_id long"), spark.createDataFrame(list(path.items()), "file_id long, path string")

    def plain(limit, kinds):
        text = lambda y: "\n".join(texts[y[1]][y[3] - 1 : max(ends[y[0]], y[3] - 1)])
        for root in symbols:
            i, f, n, a, _, _ = root
            used = list(dict.fromkeys(w for _, _, w in sorted((x[2], x[3], x[1]) for x in occ if x[0] == f and a <= x[2] <= ends[i] and (not kinds or x[4] in kinds)) if w != n and len(w) > 1))
            refs, truncated = [], False
            for w in used:
                if len(refs) >= limit:
                    truncated = True
                    break
                c = [(0 if y[1] == f else 1 if (f, y[1]) in imports else 2, path[y[1]], y[3], y[4], y) for y in symbols if y[2] == w and y[0] != i and not (y[1] == f and a <= y[3] <= ends[i])]
                if c:
                    refs.append((min(c)[-1], min(c)[0]))
            yield (i, 0, i, n, None, truncated, text(root))
            yield from ((i, k + 1, y[0], y[2], rank, truncated, text(y)) for k, (y, rank) in enumerate(refs))

    for usual, limit, kinds, uses in ((3, 4, None, by_line), (50_000, 2, ["call", "read"], o)):
        monkeypatch.setattr(source, "USUAL", usual)
        got = sorted((tuple(r) for r in source.whole_slices(ended, ended, uses, i, t, p, limit, kinds).collect()), key=lambda r: r[:2])
        want = sorted(plain(limit, kinds), key=lambda r: r[:2])
        assert got == want and len(want) > 200 and 10 < sum(r[5] for r in want if r[1] == 0) < 100


def test_slices_move_little(spark):
    """What slice_bodies shuffles stays near the size of its input, as disk has to hold it."""
    from pathlib import Path

    from quarry import registry

    written = lambda: (sc.listenerBus().waitUntilEmpty(30_000), sc.statusStore().executorList(False).apply(0).totalShuffleWrite())[1]
    sc, d = spark._jsc.sc(), "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("needs the driver's tables")
    before = written()
    registry.queries()["slice_bodies"](spark, d).write.format("noop").mode("overwrite").save()
    at = Path(d, "documents.parquet")
    size = sum(f.stat().st_size for f in ([at] if at.is_file() else at.rglob("*.parquet")))
    assert written() - before < 6 * size


def test_pack_of_searches(spark):
    import random

    rng = random.Random(11)
    outlines = [(f, rng.randint(5, 60)) for f in range(30) if f % 7]
    symbols = [(i, rng.randrange(30), rng.choice(["x", "y", "z"]), rng.randint(5, 90)) for i in range(120)]
    imports = [(f, rng.choice([None, *range(30)]), k) for f in range(30) for k in range(4)]
    hits = []
    for q in range(40):
        for k, (i, f, n, _) in enumerate(rng.sample(symbols, 12)):
            hits.append((q, k, i, f, n))
    h = spark.createDataFrame(hits, "query_id long, rank int, id long, file_id long, name string")
    o = spark.createDataFrame(outlines, "file_id long, tokens long")
    s = spark.createDataFrame([(i, t) for i, _, _, t in symbols if i % 9], "id long, tokens long")
    m = spark.createDataFrame(imports, "file_id long, resolved_file_id long, line int")
    got = {r.query_id: (r.total, list(r.taken), list(r.skipped)) for r in pack.pack(pack.items_of(h, o, s, m), 400).collect()}
    tokens = dict(outlines)
    for q in range(40):
        mine = [x for x in hits if x[0] == q]
        total, taken, skipped, shown = 0, [], [], set()

        def add(key, n, cap):
            nonlocal total
            if total + n > cap:
                skipped.append(key)
                return False
            taken.append(key)
            total += n
            return True

        for _, _, _, f, _ in mine:
            if f in shown or f not in tokens:
                continue
            if not add(f"file:{f}", tokens[f], 120):
                break
            shown.add(f)
        seen, tried = set(), set()
        for _, _, i, f, n in mine:
            if (f, n) in tried:
                continue
            tried.add((f, n))
            if i % 9 == 0:
                continue
            if not add(f"symbol:{i}", symbols[i][3], 240) and total >= 240:
                break
            seen.add((f, n))
        for f in dict.fromkeys(x[3] for x in mine):
            for _, to, _ in sorted((x for x in imports if x[0] == f), key=lambda x: x[2]):
                if to is None or to in shown or to not in tokens:
                    continue
                if not add(f"file:{to}", tokens[to], 400):
                    break
                shown.add(to)
            if total >= 400:
                break
        assert got[q] == (total, taken, skipped), q
