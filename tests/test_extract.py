import subprocess

from quarry.operators import source
from quarry.sources import extract

TS = '''import React, { useState as state, type FC } from "react";
import * as fs from './fs';
// import { no } from "comment";
export { helper } from "./helper";
export * from './all';

/** Formats a date.
 * @param d the date */
export function formatDate(d: Date, sep = "{"): string {
  const local = d;
  return fmt(local) + "function no() {";
}
export const MAX_RETRIES = 3;
export const useThing = (a: string) => {
  count = 1;
};
interface Shape extends Base { area(): number; }
export default class Circle extends Shape2 implements Shape, Other<T> {
  constructor(private r: number) { super(); }
  area(): number {
    return Math.PI * this.r;
  }
}
const lazy = () => import("./lazy");
'''


def names(rows, kind=None):
    return [(s["name"], s["kind"], s["scope"], s["line"], s["end_line"]) for s in rows.symbols if kind in (None, s["kind"])]


def test_typescript():
    r = extract.EXTRACTORS["typescript"](TS)
    assert ("formatDate", "function", None, 9, 12) in names(r) and ("MAX_RETRIES", "constant", None, 13, 13) in names(r) and ("useThing", "hook", None, 14, 16) in names(r)
    assert ("Circle", "class", None, 18, 23) in names(r) and ("area", "method", "Circle", 20, 22) in names(r)
    assert not {"local", "no"} & {s["name"] for s in r.symbols}
    f = next(s for s in r.symbols if s["name"] == "formatDate")
    assert f["signature"] == '(d: Date, sep = "{"): string' and "Formats a date" in f["doc"]
    got = {(e["kind"], e["name"], e["alias"], e["source"], e["is_default"], e["is_star"], e["is_type"]) for e in r.edges}
    assert {("import", "React", None, "react", True, False, False), ("import", "useState", "state", "react", False, False, False), ("import", "FC", None, "react", False, False, True), ("import", None, "fs", "./fs", False, True, False)} <= got
    assert {("re-export", "helper", None, "./helper", False, False, False), ("re-export", None, None, "./all", False, True, False), ("export", "Circle", None, None, True, False, False), ("dynamic-import", None, None, "./lazy", False, False, False)} <= got
    assert not any(e["source"] == "comment" for e in r.edges)
    assert {(x["source_name"], x["kind"], x["target_name"]) for x in r.relations} == {("Shape", "extends_interface", "Base"), ("Circle", "extends_class", "Shape2"), ("Circle", "implements", "Shape"), ("Circle", "implements", "Other"), ("area", "overrides_method", "Shape2.area")}
    uses = {(o["name"], o["line"]): o["ref_kind"] for o in r.occurrences}
    assert uses["formatDate", 9] == "declaration" and uses["fmt", 11] == "call" and uses["count", 15] == "write" and uses["Shape2", 18] == "type-ref"
    # usual names of a language are no occurrences there, but may be elsewhere
    assert not {("Date", 9), ("Math", 21)} & set(uses)
    assert [o["name"] for o in extract.EXTRACTORS["go"]("func F(m int) int {\n\treturn match(Math, len(from))\n}\n").occurrences] == ["match", "Math", "from"]


def test_python():
    r = extract.python('import os.path as p\nfrom ..a import b as c, d\nfrom x import *\nLIMIT = 3\n\nclass A(B):\n    """Doc."""\n    def m(self, x: Num = 1) -> str:\n        self.yy = run(x)\n        return LIMIT\n\ndef _f():\n    pass\n')
    assert names(r) == [("LIMIT", "constant", None, 4, 4), ("A", "class", None, 6, 10), ("m", "function", "A", 8, 10), ("_f", "function", None, 12, 13)]
    assert [(e["kind"], e["name"], e["alias"], e["source"], e["is_star"]) for e in r.edges] == [("export", "LIMIT", None, None, False), ("export", "A", None, None, False), ("import", "os.path", "p", "os.path", False), ("import", "b", "c", "..a", False), ("import", "d", None, "..a", False), ("import", None, None, "x", True)]
    uses = {(o["name"], o["line"], o["ref_kind"]) for o in r.occurrences}
    assert {("run", 9, "call"), ("yy", 9, "write"), ("LIMIT", 10, "read"), ("Num", 8, "type-ref"), ("LIMIT", 4, "write"), ("_f", 12, "declaration")} <= uses
    assert r.relations[0]["target_name"] == "B"


def test_go_rust_java_csharp_css():
    go = extract.EXTRACTORS["go"]('package m\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\ntype S struct {\n\tA int\n}\n\nfunc (s *S) Run(n int) error {\n\treturn nil\n}\n\nfunc small() {}\n')
    assert names(go) == [("S", "class", None, 8, 10), ("Run", "method", "S", 12, 14), ("small", "function", None, 16, 16)]
    assert [(e["kind"], e["name"], e["alias"], e["source"]) for e in go.edges] == [("export", "S", None, None), ("import", "fmt", None, "fmt"), ("import", "b", "x", "a/b")]
    rust = extract.EXTRACTORS["rust"]("use a::{b, c};\nuse d::*;\npub struct P { x: i32 }\npub trait T { fn t(&self); }\nimpl T for P {\n    fn t(&self) { }\n}\npub const MAX: u8 = 1;\n")
    assert {("P", "class", None, 3, 3), ("T", "interface", None, 4, 4), ("t", "method", "P", 6, 6), ("MAX", "constant", None, 8, 8)} <= set(names(rust))
    assert {(e["name"], e["source"], e["is_star"]) for e in rust.edges if e["kind"] == "import"} == {("b", "a", False), ("c", "a", False), (None, "d", True)}
    java = extract.EXTRACTORS["java"]("import java.util.List;\nimport a.b.*;\npublic class C extends D<E> implements F, G {\n  public static final int MAX = 1;\n  public C(int a) { }\n  private List<String> run(int n) throws X {\n    return go(n);\n  }\n}\n")
    assert names(java) == [("C", "class", None, 3, 9), ("MAX", "constant", "C", 4, 4), ("C", "method", "C", 5, 5), ("run", "method", "C", 6, 8)]
    assert [(x["kind"], x["target_name"]) for x in java.relations] == [("extends_class", "D"), ("implements", "F"), ("implements", "G")]
    cs = extract.EXTRACTORS["csharp"]("using System;\nusing X = A.B;\nnamespace N {\n  public class C : Base, IThing {\n    public int Size { get; set; }\n    public void Run(int n) {\n    }\n  }\n}\n")
    assert {("C", "class", None, 4, 8), ("Size", "variable", "C", 5, 5), ("Run", "method", "C", 6, 7)} <= set(names(cs))
    assert [(x["kind"], x["target_name"]) for x in cs.relations] == [("extends_class", "Base"), ("implements", "IThing")]
    c = extract.css(":root { --main: red; }\n@media (min-width: 1px) {\n  .a { color: var(--main); }\n}\n@keyframes spin { from { top: 0 } }\n")
    assert {(s["name"], s["kind"], s["scope"]) for s in c.symbols} >= {(":root", "selector", None), ("--main", "variable", ":root"), (".a", "selector", "@media (min-width: 1px)"), ("spin", "keyframes", None)}
    assert [(o["name"], o["line"], o["confidence"]) for o in c.occurrences] == [("--main", 3, "exact")]


def test_extract_on_executors(spark):
    df = spark.createDataFrame([(1, "python", "def f(:"), (2, "typescript", TS), (3, "cobol", "x"), (4, "python", None), (5, None, None)], "file_id long, language string, text string")
    got = extract.extract(df).cache()
    assert {r.file_id: (r.error or "")[:11] for r in got.select("file_id", "error").collect()} == {1: "SyntaxError", 2: "", 3: "no extracto", 4: "", 5: "no extracto"}
    assert extract.rows(got, "symbols").where("name = 'Circle' and kind = 'class'").count() == 1


def test_revisions_and_batch(spark, tmp_path):
    git = ["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b"]
    subprocess.run([*git, "init", "-q"], check=True)
    for text in ("def f(a): pass\ndef g(): pass\n", "def f(a, b): pass\ndef h(): pass\n"):
        (tmp_path / "a.py").write_text(text)
        subprocess.run([*git, "add", "-A"], check=True)
        subprocess.run([*git, "commit", "-qm", "x"], check=True)
    got = {(r.path, r.name, r.change) for r in source.diff_outline(spark, str(tmp_path), "HEAD~1").collect()}
    assert got == {("a.py", "f", "modified"), ("a.py", "g", "removed"), ("a.py", "h", "added")}
    files = spark.createDataFrame([(1, "a.py")], "id long, path string")
    symbols = spark.createDataFrame([(1, 2, "h", "function"), (1, 1, "f", "function")], "file_id long, line int, name string, kind string")
    row = source.changed(spark, str(tmp_path), files, symbols).first()
    assert (row.path, row.status, [s.name for s in row.symbols]) == ("a.py", "M", ["f", "h"])
    done = source.batch([("one", lambda: files), ("two", lambda: files.select("none"))])
    assert [x["ok"] for x in done] == [True, False] and source.identifier_at("a = fooBar(b)", 8) == "fooBar" and source.identifier_at("+") is None
