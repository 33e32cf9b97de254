"""Symbols, import and export edges, occurrences and relations of source files.

Python is parsed by the standard library. The other languages are read by a table of declaration patterns over text whose
comments and strings are blanked, with brackets matched for the ends; CAPABILITIES says what to expect of each.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.shipping import ship

SYMBOL = "struct<name:string,kind:string,line:int,col:int,end_line:int,signature:string,scope:string,doc:string>"
EDGE = "struct<kind:string,name:string,alias:string,source:string,line:int,is_default:boolean,is_star:boolean,is_type:boolean>"
OCCURRENCE = "struct<name:string,line:int,col:int,context:string,confidence:string,ref_kind:string>"
RELATION = "struct<source_name:string,kind:string,target_name:string,confidence:string,line:int>"
EXTRACTED = f"file_id long, symbols array<{SYMBOL}>, edges array<{EDGE}>, occurrences array<{OCCURRENCE}>, relations array<{RELATION}>, error string"


@dataclass
class Rows:
    symbols: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    occurrences: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)

    def symbol(self, name: str, kind: str, line: int, col: int, end: int | None, signature: str | None = None, scope: str | None = None, doc: str | None = None) -> None:
        self.symbols.append({"name": name, "kind": kind, "line": line, "col": col, "end_line": end, "signature": signature, "scope": scope, "doc": doc})

    def edge(self, kind: str, name: str | None, source: str | None, line: int, alias: str | None = None, default: bool = False, star: bool = False, typed: bool = False) -> None:
        self.edges.append({"kind": kind, "name": name, "alias": alias, "source": source, "line": line, "is_default": default, "is_star": star, "is_type": typed})

    def relation(self, source: str, kind: str, target: str, line: int) -> None:
        self.relations.append({"source_name": source, "kind": kind, "target_name": target, "confidence": "heuristic", "line": line})


# --- Python ------------------------------------------------------------------------------------------------------------


def python(text: str) -> Rows:
    """Raises SyntaxError; methods are functions with a scope; public top-level names count as exported."""
    out, lines = Rows(), text.split("\n")
    module = ast.parse(text)

    def declare(body: list[ast.stmt], scope: str | None) -> None:
        for n in body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                returns = f" -> {ast.unparse(n.returns)}" if n.returns else ""
                out.symbol(n.name, "function", n.lineno, n.col_offset, n.end_lineno, f"({ast.unparse(n.args)}){returns}", scope, ast.get_docstring(n))
            elif isinstance(n, ast.ClassDef):
                out.symbol(n.name, "class", n.lineno, n.col_offset, n.end_lineno, None, scope, ast.get_docstring(n))
                for b in n.bases:
                    out.relation(n.name, "extends_class", ast.unparse(b), n.lineno)
                declare(n.body, n.name)
            elif isinstance(n, ast.Assign | ast.AnnAssign) and scope is None:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        out.symbol(t.id, "constant" if t.id.isupper() else "variable", n.lineno, t.col_offset, n.end_lineno, None, None, None)
            elif isinstance(n, ast.If | ast.Try):
                declare(n.body, scope)

    declare(module.body, None)
    for s in out.symbols:
        if s["scope"] is None and not s["name"].startswith("_"):
            out.edge("export", s["name"], None, s["line"])
    kinds: dict[int, str] = {}
    for n in ast.walk(module):  # parents come before their children
        if isinstance(n, ast.Import):
            for a in n.names:
                out.edge("import", a.name, a.name, n.lineno, a.asname)
        elif isinstance(n, ast.ImportFrom):
            source = "." * n.level + (n.module or "")
            for a in n.names:
                out.edge("import", None if a.name == "*" else a.name, source, n.lineno, a.asname, star=a.name == "*")
        elif isinstance(n, ast.Call):
            kinds[id(n.func)] = "call"
        notes = [getattr(n, "annotation", None), getattr(n, "returns", None)]
        for x in (y for note in notes if note for y in ast.walk(note)):
            kinds[id(x)] = "type-ref"
        name = n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else None
        if name and len(name) > 1 and name not in _IGNORED["python"]:
            line, col = (n.lineno, n.col_offset) if isinstance(n, ast.Name) else (n.end_lineno, n.end_col_offset - len(name.encode()))
            kind = "write" if isinstance(n.ctx, ast.Store | ast.Del) else kinds.get(id(n), "read")
            out.occurrences.append({"name": name, "line": line, "col": col, "context": lines[line - 1].strip()[:200], "confidence": "heuristic", "ref_kind": kind})
    for s in out.symbols:
        if s["kind"] in ("function", "class") and len(s["name"]) > 1:
            out.occurrences.append({"name": s["name"], "line": s["line"], "col": s["col"], "context": lines[s["line"] - 1].strip()[:200], "confidence": "heuristic", "ref_kind": "declaration"})
    out.occurrences.sort(key=lambda o: (o["line"], o["col"]))
    return out


# --- languages with braces ----------------------------------------------------------------------------------------------

_BLANK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`?", re.S)
_IDENT = re.compile(r"[A-Za-z_$][\w$]+")
# Names that aren't occurrences, by language.
IGNORED = {
    "typescript": (
        "true false null undefined this super if else for while do switch case break continue return throw try catch finally new delete typeof instanceof void in of"
        " let const var function class extends implements import export default from as async await yield static get set"
        " type interface enum namespace module declare abstract readonly private protected public keyof infer is asserts satisfies"
        " console Object Array String Number Boolean Promise Map Set Error JSON Math Date RegExp Symbol WeakMap WeakSet Proxy Reflect"
        " parseInt parseFloat isNaN isFinite encodeURI decodeURI encodeURIComponent decodeURIComponent setTimeout setInterval clearTimeout clearInterval require"
    ),
    "python": (
        "True False None self cls if else elif for while with as try except finally raise assert return yield break continue pass import from def class lambda"
        " and or not in is del global nonlocal async await print len range type int str float bool list dict set tuple object super"
    ),
    "java": (
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int"
        " interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while"
        " true false null String Object Integer Boolean System Override"
    ),
    "csharp": (
        "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach"
        " goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short"
        " sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while var async await get set value Array Console Task"
    ),
    "go": (
        "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota"
        " append cap close copy delete len make new panic print println recover string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 float32 float64 complex64 complex128 byte rune bool error any"
    ),
    "rust": (
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while yield"
        " i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str Vec Box String Option Some None Ok Err"
    ),
}
_IGNORED = {k: frozenset(v.split()) for k, v in IGNORED.items()}
_IGNORED["javascript"] = _IGNORED["typescript"]
#: What stands before a bracket without being declared.
_CONTROL = frozenset("if else for foreach while do switch case catch finally return new throw try using lock fixed match loop await typeof sizeof function super this synchronized select defer go range where in is as let const var".split())
#: Kinds that hold others.
TYPES = ("class", "interface", "enum", "impl", "module")


def blank(text: str) -> str:
    """Comments and strings become spaces; every other character keeps its place."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


_MOD = r"^[ \t]*(?:(?:export|default|declare|abstract|async|public|private|protected|internal|static|final|sealed|partial|readonly|override|virtual|unsafe|extern|pub(?:\([^)]*\))?)[ \t]+)*"
_JAVA = r"^[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|override|virtual|async|synchronized|default)[ \t]+)*"
_RETURNS = r"(?!return\b|new\b|else\b|throw\b|await\b)[\w.$]+(?:<[^;{}()=]*>)?(?:\[\])*\??[ \t]+"


def _table(*pairs: tuple[str, str]) -> list[tuple[str, re.Pattern]]:
    return [(kind, re.compile(p, re.M)) for kind, p in pairs]


_TS = _table(
    ("class", _MOD + r"class[ \t]+([\w$]+)"),
    ("interface", _MOD + r"interface[ \t]+([\w$]+)"),
    ("enum", _MOD + r"(?:const[ \t]+)?enum[ \t]+([\w$]+)"),
    ("type", _MOD + r"type[ \t]+([\w$]+)[^=\n]*="),
    ("function", _MOD + r"function[ \t]*\*?[ \t]*([\w$]+)"),
    ("function", _MOD + r"(?:const|let|var)[ \t]+([\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^;{}]*?\)[^=;{}]*=>|[\w$]+[ \t]*=>)"),
    ("variable", _MOD + r"(?:const|let|var)[ \t]+([\w$]+)"),
    ("method", _MOD + r"(?:(?:get|set)[ \t]+)?(?!(?:if|for|while|switch|catch|return|function|new)\b)([\w$]+)[ \t]*(?:<[^>\n]*>)?\([^;{}]*\)[^;{}=\n]*\{"),
)
_DECLARED: dict[str, list[tuple[str, re.Pattern]]] = {
    "typescript": _TS,
    "javascript": _TS,
    "java": _table(
        ("class", _JAVA + r"(?:class|record)[ \t]+(\w+)"),
        ("interface", _JAVA + r"@?interface[ \t]+(\w+)"),
        ("enum", _JAVA + r"enum[ \t]+(\w+)"),
        ("method", _JAVA + r"(?:<[^>\n]*>[ \t]*)?" + _RETURNS + r"(\w+)[ \t]*\([^;{}]*\)[^;{}=]*[{;]"),
        ("method", r"^[ \t]*(?:public|private|protected)[ \t]+([A-Z]\w*)[ \t]*\([^;{}]*\)[^;{}=]*\{"),
        ("constant", r"^[ \t]*(?:(?:public|private|protected)[ \t]+)?static[ \t]+final[ \t]+[\w.<>\[\], ]+?[ \t](\w+)[ \t]*="),
    ),
    "csharp": _table(
        ("module", r"^[ \t]*namespace[ \t]+([\w.]+)"),
        ("class", _JAVA + r"(?:readonly[ \t]+)?(?:class|record|struct)[ \t]+(\w+)"),
        ("interface", _JAVA + r"interface[ \t]+(\w+)"),
        ("enum", _JAVA + r"enum[ \t]+(\w+)"),
        ("method", _JAVA + _RETURNS + r"(\w+)(?:<[^>\n]*>)?[ \t]*\([^;{}]*\)[^;{}=]*(?:[{;]|=>)"),
        ("method", r"^[ \t]*(?:public|private|protected|internal)[ \t]+([A-Z]\w*)[ \t]*\([^;{}]*\)[^;{}=]*\{"),
        ("constant", _JAVA + r"const[ \t]+[\w.]+[ \t]+(\w+)"),
        ("variable", _JAVA + _RETURNS + r"(\w+)[ \t]*\{[ \t]*(?:get|set|init)\b"),
    ),
    "go": _table(
        ("method", r"^func[ \t]*\([^)]*\)[ \t]*(\w+)"),
        ("function", r"^func[ \t]+(\w+)"),
        ("class", r"^(?:type[ \t]+|[ \t]+)(\w+)(?:\[[^\]]*\])?[ \t]+struct\b"),
        ("interface", r"^(?:type[ \t]+|[ \t]+)(\w+)(?:\[[^\]]*\])?[ \t]+interface\b"),
        ("type", r"^type[ \t]+(\w+)[ \t]+(?!struct\b|interface\b)[\w*\[(=]"),
        ("constant", r"^const[ \t]+(\w+)"),
        ("variable", r"^var[ \t]+(\w+)"),
    ),
    "rust": _table(
        ("class", _MOD + r"struct[ \t]+(\w+)"),
        ("interface", _MOD + r"trait[ \t]+(\w+)"),
        ("enum", _MOD + r"enum[ \t]+(\w+)"),
        ("type", _MOD + r"type[ \t]+(\w+)"),
        ("module", _MOD + r"mod[ \t]+(\w+)"),
        ("impl", r"^[ \t]*impl(?:<[^>\n]*>)?[ \t]+(?:[\w:<>, ]+?[ \t]+for[ \t]+)?(\w+)"),
        ("function", _MOD + r"(?:const[ \t]+)?fn[ \t]+(\w+)"),
        ("constant", _MOD + r"(?:const|static)[ \t]+(?:mut[ \t]+)?([A-Z]\w*)[ \t]*:"),
    ),
}


def _ends(code: str) -> dict[int, int]:
    """Place of each opening brace -> of the closing one; the unclosed are left out."""
    open_, pairs = [], {}
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            pairs[open_.pop()] = m.start()
    return pairs


def _doc(lines: list[str], line: int) -> str | None:
    """The comment right above a line, decorators between."""
    k = line - 2
    while k >= 0 and lines[k].lstrip().startswith(("@", "#[")):
        k -= 1
    stop = k
    if k >= 0 and lines[k].rstrip().endswith("*/"):
        while k >= 0 and "/*" not in lines[k]:
            k -= 1
        return "\n".join(x.strip() for x in lines[max(k, 0) : stop + 1])
    while k >= 0 and lines[k].lstrip().startswith("///"):
        k -= 1
    return "\n".join(x.strip()[3:].strip() for x in lines[k + 1 : stop + 1]) or None


def _ts_edges(code: str, text: str, out: Rows, line_of: Callable[[int], int]) -> None:
    """Import, export and re-export clauses; sources are read from the text at the place of the blanked string."""
    quoted = r"[ \t\n]*(?P<q>[\"'])(?P<s>[^\"'\n]+)(?P=q)"
    names = lambda body: [(x[0], x[1] if len(x) > 1 else None, t) for part in body.split(",") if part.strip() for t in [part.strip().startswith("type ")] for x in [re.split(r"\s+as\s+", part.strip().removeprefix("type ").strip())]]
    for m in re.finditer(r"^[ \t]*import\b(?P<type>[ \t]+type\b)?(?P<body>[^;\"'()]*?)(?:\bfrom)?" + quoted, text, re.M):
        if code[m.start("body") - 1 : m.start("body")] == " " and not code[m.start() : m.end()].strip():
            continue  # within a comment
        body, line, typed = m["body"].strip(), line_of(m.start() + len(m.group()) - len(m.group().lstrip())), bool(m["type"])
        inner = re.search(r"\{([^}]*)\}", body)
        star = re.search(r"\*\s*as\s+([\w$]+)", body)
        default = re.match(r"[\w$]+", body)
        if default:
            out.edge("import", default.group(), m["s"], line, default=True, typed=typed)
        if star:
            out.edge("import", None, m["s"], line, alias=star[1], star=True, typed=typed)
        for name, alias, t in names(inner[1]) if inner else []:
            out.edge("import", name, m["s"], line, alias=alias, typed=typed or t)
        if not body:
            out.edge("import", None, m["s"], line)
    for m in re.finditer(r"^[ \t]*export\b(?P<type>[ \t]+type\b)?[ \t]*(?:\*(?:[ \t]+as[ \t]+(?P<ns>[\w$]+))?|\{(?P<body>[^}]*)\})(?:\s*from" + quoted + ")?", text, re.M):
        if code[m.start() : m.end()].strip()[:6] != "export":
            continue
        line, typed, kind = line_of(m.start("type") if m["type"] else m.start()), bool(m["type"]), "re-export" if m["s"] else "export"
        if m["body"] is None:
            out.edge(kind, m["ns"], m["s"], line, star=True, typed=typed)
        for name, alias, t in names(m["body"]) if m["body"] else []:
            out.edge(kind, name if m["s"] else alias or name, m["s"], line, alias=alias, typed=typed or t, default=alias == "default")
    for m in re.finditer(r"\b(?P<how>import|require)(?:\.resolve)?\(" + quoted, text):
        if code[m.start("how") : m.end("how")] == m["how"]:
            out.edge("dynamic-import" if m["how"] == "import" else "require", None, m["s"], line_of(m.start()))


_IMPORTS = {
    "java": re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<s>[\w.]+?)(?P<star>\.\*)?;", re.M),
    "csharp": re.compile(r"^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:(?P<alias>\w+)[ \t]*=[ \t]*)?(?P<s>[\w.]+);", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub[ \t]+)?use[ \t]+(?P<s>[\w:]+?)(?:::\{(?P<body>[^}]*)\}|(?P<star>::\*)|[ \t]+as[ \t]+(?P<alias>\w+))?;", re.M),
    "go": re.compile(r"^(?:import[ \t]+|[ \t]+)(?:(?P<alias>[\w.]+)[ \t]+)?\"(?P<s>[^\"\n]+)\"[ \t]*$", re.M),
}
_EXPORTED = {"java": re.compile(r"\bpublic\b"), "csharp": re.compile(r"\bpublic\b"), "rust": re.compile(r"\bpub\b"), "typescript": re.compile(r"^\s*export\b"), "javascript": re.compile(r"^\s*export\b")}


def braces(language: str, text: str) -> Rows:
    out, code, lines = Rows(), blank(text), text.split("\n")
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line_of = lambda at: bisect.bisect_right(starts, at)
    pairs = _ends(code)
    opens = sorted(pairs)
    depth_at = lambda at: [o for o in opens[: bisect.bisect_right(opens, at)] if pairs[o] > at]
    found: dict[int, tuple[str, re.Match, int | None]] = {}
    for kind, pattern in _DECLARED[language]:
        for m in pattern.finditer(code):
            at = m.start(1)
            if at in found or m[1] in _CONTROL:
                continue
            # the body opens before the statement ends
            stop = code.find(";", m.end(1))
            k = bisect.bisect_left(opens, m.end(1))
            body = opens[k] if k < len(opens) and (stop < 0 or opens[k] < stop) and kind not in ("variable", "constant", "type") else None
            found[at] = (kind, m, body)
    bodies = {b: (kind, m[1]) for kind, m, b in found.values() if b is not None}
    declared = set()
    for at, (kind, m, body) in sorted(found.items()):
        around = depth_at(at)
        owner = bodies.get(around[-1]) if around else None
        if owner and owner[0] not in TYPES:
            continue  # local
        if around and not owner and kind in ("method", "variable", "constant", "function"):
            continue
        scope = owner[1] if owner and owner[0] != "module" else None
        if kind == "method" and language in ("typescript", "javascript") and scope is None:
            continue  # a call followed by a block
        name, line = m[1], line_of(at)
        if kind == "impl":
            continue
        head = lines[line - 1]
        if language in ("typescript", "javascript") and scope is None:
            if kind == "function":
                kind = "hook" if re.match(r"use[A-Z]", name) else kind
            elif kind == "variable" and re.fullmatch(r"[A-Z][A-Z0-9_]*", name):
                kind = "constant"
        if language == "rust" and kind == "function" and scope:
            kind = "method"
        if language == "go" and kind == "method":
            scope = re.search(r"(\w+)(?:\[[^\]]*\])?\s*\)\s*$", code[m.start() : at])[1]
        signature = None
        if kind in ("function", "method", "hook"):
            paren = code.find("(", m.end(1))
            end = body if body is not None else code.find(";", m.end(1))
            if 0 <= paren and (end < 0 or paren < end):
                signature = " ".join(text[paren : end if end >= 0 else starts[line] if line < len(starts) else len(text)].split()).removesuffix("=>").strip()
        out.symbol(name, kind, line, at - starts[line - 1], line_of(pairs[body]) if body is not None else line, signature, scope, _doc(lines, line))
        declared.add(at)
        exported = name[0].isupper() if language == "go" else bool(_EXPORTED[language].search(head))
        if scope is None and exported and kind != "module":
            out.edge("export", name, None, line, default=bool(re.search(r"\bdefault\b", head)) and language in ("typescript", "javascript"), typed=kind in ("interface", "type") and language == "typescript")
        if kind in ("class", "interface") and body is not None:
            _heritage(language, code[m.end(1) : body], name, kind, line, out)
    if language in ("typescript", "javascript"):
        _overrides(out)
        _ts_edges(code, text, out, line_of)
    else:
        for m in _IMPORTS[language].finditer(text):
            g = m.groupdict()
            if language == "go" and not re.search(r"^import\b", text[: m.start() + 6].rsplit("\n\n", 1)[-1], re.M):
                continue
            for name in [x.strip() for x in g["body"].split(",")] if g.get("body") else [re.split(r"\.|::|/", g["s"])[-1] if not g.get("star") else None]:
                out.edge("import", name, g["s"], line_of(m.start("s")), alias=g.get("alias"), star=bool(g.get("star")))
    for m in _IDENT.finditer(code):
        if m.group() not in _IGNORED[language]:
            line = line_of(m.start())
            out.occurrences.append({"name": m.group(), "line": line, "col": m.start() - starts[line - 1], "context": lines[line - 1].strip()[:200], "confidence": "heuristic", "ref_kind": "declaration" if m.start() in declared else _use(code, m)})
    return out


def _heritage(language: str, head: str, name: str, kind: str, line: int, out: Rows) -> None:
    head = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", head))
    if language == "csharp":
        m = re.search(r":\s*([^{]*)", head)
        for k, t in enumerate(x.strip() for x in re.sub(r"\bwhere\b.*", "", m[1], flags=re.S).split(",")) if m else ():
            inherits = "extends_interface" if kind == "interface" else "implements" if re.match(r"I[A-Z]", t) or k else "extends_class"
            out.relation(name, inherits, t, line)
        return
    for word, body in re.findall(r"\b(extends|implements)\s+([\w$.,\s]+?)(?=\bimplements\b|\bextends\b|$)", head):
        for t in filter(None, (x.strip() for x in body.split(","))):
            out.relation(name, "implements" if word == "implements" else "extends_interface" if kind == "interface" else "extends_class", t, line)


def _overrides(out: Rows) -> None:
    """A method of a class with a parent may override the parent's: ``Parent.method``, told of the method."""
    parents: dict[str, list[str]] = {}
    for r in out.relations:
        if r["kind"] == "extends_class":
            parents.setdefault(r["source_name"], []).append(r["target_name"])
    for s in out.symbols:
        if s["kind"] == "method" and s["name"] != "constructor" and not s["name"].startswith("#"):
            for p in parents.get(s["scope"], ()):
                out.relation(s["name"], "overrides_method", f"{p}.{s['name']}", s["line"])


def _use(code: str, m: re.Match) -> str:
    """How a name is used, by its neighbours."""
    before, after = code[max(0, m.start() - 40) : m.start()].rstrip(), code[m.end() : m.end() + 3].lstrip()
    if re.search(r"\b(?:const|let|var|function|class|interface|type|enum)$", before):
        return "declaration"
    if re.search(r"\b(?:extends|implements|as)$", before) or (before.endswith(":") and "?" not in before[-20:] and not re.search(r"[{,]\s*[\w$]+\s*:$", before)):
        return "type-ref"
    if after.startswith("("):
        return "call"
    return "write" if re.match(r"(?:[+\-*/%&|^]?=(?![=>])|\+\+|--)", after) else "read"


# --- CSS ---------------------------------------------------------------------------------------------------------------


def css(text: str) -> Rows:
    """Selectors with the path of outer ones as scope, custom properties, media and keyframes; var() uses are exact."""
    out = Rows()
    code = re.sub(r"/\*.*?(?:\*/|\Z)|\"[^\"\n]*\"|'[^'\n]*'", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    pairs, lines = _ends(code), text.split("\n")
    stack: list[tuple[int, str]] = []
    for m in re.finditer(r"([^{};]+)(\{|;|(?=\}))", code):
        at = m.start() + len(m[1]) - len(m[1].lstrip())
        head, line = " ".join(m[1].split()), code.count("\n", 0, at) + 1
        col = at - (code.rfind("\n", 0, at) + 1)
        stack = [s for s in stack if s[0] > m.start()]
        scope = " > ".join(s[1] for s in stack) or None
        if m[2] == "{" and m.start(2) in pairs:
            end = code.count("\n", 0, pairs[m.start(2)]) + 1
            kind = "media" if head.startswith("@media") else "keyframes" if "keyframes" in head[:20] and head.startswith("@") else "selector"
            out.symbol(head.split(None, 1)[1] if kind == "keyframes" and " " in head else head, kind, line, col, end, None, scope)
            stack.append((pairs[m.start(2)], head))
        elif head.startswith("--"):
            out.symbol(head.split(":")[0].strip(), "variable", line, col, line, None, scope)
    for m in re.finditer(r"var\(\s*(--[\w-]+)", code):
        line = code.count("\n", 0, m.start(1)) + 1
        out.occurrences.append({"name": m[1], "line": line, "col": m.start(1) - (code.rfind("\n", 0, m.start(1)) + 1), "context": lines[line - 1].strip()[:200], "confidence": "exact", "ref_kind": None})
    return out


# --- registry ----------------------------------------------------------------------------------------------------------

EXTRACTORS: dict[str, Callable[[str], Rows]] = {"python": python, "css": css}
for _name in _DECLARED:
    EXTRACTORS[_name] = lambda text, _n=_name: braces(_n, text)

#: How far each language's rows can be relied on.
CAPABILITIES = {name: {"symbols": "parsed" if name == "python" else "patterns", "edges": name != "css", "ref_kinds": "parsed" if name == "python" else None if name == "css" else "neighbours", "relations": name in ("python", "typescript", "javascript", "java", "csharp")} for name in EXTRACTORS}


def register(language: str, extractor: Callable[[str], Rows]) -> None:
    """Adds a language; the function must be importable, or picklable by value, on executors."""
    EXTRACTORS[language] = extractor


def extract(files: DataFrame) -> DataFrame:
    """files(file_id, language, text) -> one row per file; ``error`` says why a file has no rows."""
    ship(files.sparkSession)
    known = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f in b.itertuples():
                try:
                    r, error = known[f.language](f.text or ""), None
                except KeyError:
                    r, error = Rows(), f"no extractor for {f.language}"
                except (SyntaxError, ValueError, RecursionError) as e:
                    r, error = Rows(), f"{type(e).__name__}: {e}"
                rows.append((f.file_id, r.symbols, r.edges, r.occurrences, r.relations, error))
            yield pd.DataFrame(rows, columns=["file_id", "symbols", "edges", "occurrences", "relations", "error"])

    return files.select("file_id", "language", "text").mapInPandas(run, EXTRACTED)


def rows(extracted: DataFrame, part: str) -> DataFrame:
    """Flat rows of ``symbols``, ``edges``, ``occurrences`` or ``relations``."""
    return extracted.select("file_id", F.explode(part).alias("r")).select("file_id", "r.*")
