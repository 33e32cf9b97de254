"""Structured documents: JSON with comments, YAML and TOML subsets, and four kinds of lock files."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a document of each kind may have (fixed values of the data model).
CAPS = {"manifest": 1 << 20, "generic": 5 << 20, "lock": 20 << 20}


def value_at(text: Column | str, path: str, kind: str = "string") -> Column:
    """Value at a dotted path of a JSON column; a numeric segment reads an array, or else a key of that name."""
    v = F.try_parse_json(F.col(text) if isinstance(text, str) else text)
    paths = ["$"]
    for seg in path.split("."):
        paths = [p + x for p in paths for x in ([f"[{seg}]", f"['{seg}']"] if seg.isdigit() else [f"['{seg}']"])]
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def _scalar(s: str) -> Any:
    s = s.strip()
    if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    if s in ("", "~", "null"):
        return None
    if s in ("true", "false"):
        return s == "true"
    if re.fullmatch(r"-?\d+", s):
        return int(s)
    if re.fullmatch(r"-?\d+\.\d+", s):
        return float(s)
    if s[0] == "[" and s[-1] == "]":
        return [_scalar(x) for x in re.split(r",(?![^\[{]*[\]}])", s[1:-1]) if x.strip()]
    if s[0] == "{" and s[-1] == "}":
        return {k.strip().strip("\"'"): _scalar(v) for k, v in (x.split(":", 1) for x in s[1:-1].split(",") if ":" in x)}
    return s


_KEY = re.compile(r"""((?:"[^"]*"|'[^']*'|[^\s#"'\[{][^#]*?))\s*:(?:\s+(.*))?$""")


def _bare(line: str) -> str:
    """A line without its comment; a mark inside quotes begins none."""
    return re.sub(r"""((?:^|[\s:\[,{])(?:"(?:\\.|[^"\\])*"|'[^']*'))|\s+#.*$""", lambda m: m[1] or "", line)


def parse_yaml(text: str) -> Any:
    """The block subset of YAML: nested maps, lists, scalars, literal blocks, flow lists."""
    rows = [(len(x) - len(x.lstrip()), _bare(x.strip())) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]
    at = 0

    def block(indent: int) -> Any:
        nonlocal at
        if rows[at][1].startswith("- ") or rows[at][1] == "-":
            out: list = []
            while at < len(rows) and rows[at][0] == indent and (rows[at][1].startswith("- ") or rows[at][1] == "-"):
                rest = rows[at][1][1:].strip()
                if not rest:
                    at += 1
                    out.append(block(rows[at][0]) if at < len(rows) and rows[at][0] > indent else None)
                elif _KEY.match(rest):
                    rows[at] = (indent + 2, rest)
                    out.append(block(indent + 2))
                else:
                    at += 1
                    out.append(_scalar(rest))
            return out
        got: dict = {}
        while at < len(rows) and rows[at][0] == indent:
            m = _KEY.match(rows[at][1])
            if not m:
                at += 1
                continue
            key, rest = m[1].strip().strip("\"'"), (m[2] or "").strip()
            at += 1
            if rest[:1] in ("|", ">"):
                part = []
                while at < len(rows) and rows[at][0] > indent:
                    part.append(rows[at][1])
                    at += 1
                got[key] = ("\n" if rest[0] == "|" else " ").join(part)
            elif rest:
                got[key] = _scalar(rest)
            elif at < len(rows) and (rows[at][0] > indent or (rows[at][0] == indent and rows[at][1].startswith("-"))):
                got[key] = block(rows[at][0])
            else:
                got[key] = None
        return got

    return block(rows[0][0]) if rows else None


def parse(text: str, path: str) -> Any:
    """Value of a document by its extension."""
    low = path.lower()
    if low.endswith(".toml") or low.endswith("cargo.lock"):
        return tomllib.loads(text)
    if low.endswith((".yml", ".yaml")):
        return parse_yaml(text)
    return json.loads(strip_jsonc(text))


def dotted(value: Any, path: str) -> tuple[bool, Any]:
    for seg in path.split(".") if path else []:
        if isinstance(value, dict) and seg in value:
            value = value[seg]
        elif isinstance(value, list) and seg.isdigit() and int(seg) < len(value):
            value = value[int(seg)]
        else:
            return False, None
    return True, value


def value_kind(v: Any) -> str:
    return "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string"


def preview(v: Any) -> str | None:
    """A scalar as JSON, strings of more than 78 characters cut to 75; None for containers."""
    if isinstance(v, str):
        v = v if len(v) <= 78 else v[:75] + "..."
    return None if isinstance(v, dict | list) else canonical_json(v)


def outline(value: Any) -> list[dict]:
    """Top-level entries: key, kind, length of arrays, preview of scalars."""
    entries = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else []
    return [{"key": str(k), "value_kind": value_kind(v), "length": len(v) if isinstance(v, list) else None, "preview": preview(v)} for k, v in entries]


def canonical_json(v: Any) -> str:
    """JSON with sorted keys and without spaces; whole numbers have no fraction."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical_json, v)) + "]"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        v = int(v)
    return json.dumps(v, ensure_ascii=False)


def input_hash(text: Column | str) -> Column:
    """First 16 hex digits of the digest of a JSON column's canonical form; null where it can't be read."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else hashlib.sha256(canonical_json(json.loads(t)).encode()).hexdigest()[:16]
            except ValueError:
                return None

        return texts.map(one)

    return run(F.col(text) if isinstance(text, str) else text)


def _strings(v: Any, keys: list[str]) -> dict:
    return {k: v[k] for k in keys if isinstance(v.get(k), str)} if isinstance(v, dict) else {}


TYPED = ("package_json", "tsconfig_json", "cargo_toml", "gha_workflow")


def typed(value: Any, kind: str) -> Any:
    """The known part of a package.json, tsconfig.json, Cargo.toml or workflow: fields of another type are left out; else the value."""
    if kind not in TYPED:
        return value
    if not isinstance(value, dict):
        raise ValueError(f"the root of a {kind} must be a table")
    tables = lambda keys: {k: value[k] for k in keys if isinstance(value.get(k), dict)}
    if kind == "package_json":
        return _strings(value, ["name", "version", "description", "main", "type"]) | tables(["scripts", "dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "engines"])
    if kind == "tsconfig_json":
        lists = {k: value[k] for k in ("include", "exclude", "files", "references") if isinstance(value.get(k), list)}
        return {k: value[k] for k in ("extends",) if isinstance(value.get(k), str | list)} | tables(["compilerOptions"]) | lists
    if kind == "cargo_toml":
        out: dict = {"package": _strings(value["package"], ["name", "version", "edition"])} if isinstance(value.get("package"), dict) else {}
        out |= tables(["dependencies", "dev-dependencies"])
        if isinstance(value.get("workspace"), dict):
            members = value["workspace"].get("members")
            out["workspace"] = {"members": members} if isinstance(members, list) and all(isinstance(x, str) for x in members) else {}
        return out
    if kind == "gha_workflow":
        out = _strings(value, ["name"]) | ({"on": value["on"]} if "on" in value else {})
        if isinstance(value.get("jobs"), dict):
            out["jobs"] = {}
            for name, job in value["jobs"].items():
                if not isinstance(job, dict):
                    continue
                on = job.get("runs-on")
                mine: dict = {"runs-on": on} if isinstance(on, str) or isinstance(on, list) and all(isinstance(x, str) for x in on) else {}
                if isinstance(job.get("steps"), list):
                    mine["steps"] = [_strings(x, ["name", "uses", "run"]) for x in job["steps"] if isinstance(x, dict)]
                out["jobs"][name] = mine
        return out
    return value


#: The cap that holds for each kind of document.
CAP_OF = {k: CAPS["manifest"] for k in ("package_json", "tsconfig_json", "cargo_toml", "gha_workflow")} | {k: CAPS["lock"] for k in ("package_lock", "yarn_lock", "pnpm_lock", "cargo_lock")}


def outline_table(docs: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """docs(path, kind, text) → (path, key, value_kind, length, preview, error, limit, actual) of the typed part's entries.

    A document over its cap gives one row with ``file_too_large``, the cap and its bytes and isn't parsed; one that can't be
    read gives one with ``unreadable``.
    """
    from quarry.shipping import ship

    ship(docs.sparkSession)
    schema = "path string, key string, value_kind string, length int, preview string, error string, limit long, actual long"
    cap = F.create_map(*[F.lit(x) for kv in (CAP_OF | (caps or {})).items() for x in kv])
    sized = docs.withColumn("limit", F.coalesce(F.element_at(cap, F.col("kind")), F.lit(CAPS["generic"])).cast("long")).withColumn("actual", F.octet_length("text").cast("long"))
    null = lambda kind: F.lit(None).cast(kind)
    large = sized.where("actual > limit").select("path", null("string").alias("key"), null("string").alias("value_kind"), null("int").alias("length"), null("string").alias("preview"), F.lit("file_too_large").alias("error"), "limit", "actual")

    def run(frames):
        columns = [c.split()[0] for c in schema.split(", ")]
        for f in frames:
            out = []
            for path, kind, text in zip(f["path"], f["kind"], f["text"]):
                try:
                    out += [(path, e["key"], e["value_kind"], e["length"], e["preview"], None, None, None) for e in outline(typed(parse(text, path), kind))]
                except (ValueError, TypeError, IndexError):
                    out.append((path, None, None, None, None, "unreadable", None, None))
            got = pd.DataFrame(out, columns=columns)
            for c in ("length", "limit", "actual"):
                got[c] = got[c].astype("Int64")
            yield got

    return sized.where("actual <= limit").select("path", "kind", "text").mapInPandas(run, schema).union(large)


def _yarn(text: str) -> list[tuple[str, str]]:
    out, name = [], None
    for line in text.split("\n"):
        if line and not line[0].isspace() and not line.startswith("#"):
            spec = line.rstrip(":").split(",")[0].strip().strip('"')
            name = spec[: spec.rfind("@")] if spec.rfind("@") > 0 else spec
        elif name and (m := re.match(r'\s+version:?\s+"?([^"\s]+)"?', line)):
            out.append((name, m[1]))
            name = None
    return out


def _package_lock(text: str) -> list[tuple[str, str]]:
    doc, out = json.loads(text), []
    if "packages" in doc:
        return [(k.rpartition("node_modules/")[2], v["version"]) for k, v in doc["packages"].items() if k and "version" in v]
    todo = [doc.get("dependencies") or {}]
    for deps in todo:
        for k, v in deps.items():
            if "version" in v:
                out.append((k, v["version"]))
            if v.get("dependencies"):
                todo.append(v["dependencies"])
    return out


def _pnpm(text: str) -> list[tuple[str, str]]:
    out = []
    for key in (parse_yaml(text) or {}).get("packages") or {}:
        k = key.split("(")[0].lstrip("/")
        at = k.rfind("@")
        if at <= 0:
            at = k.rfind("/")
        if at > 0:
            out.append((k[:at], k[at + 1 :].split("_")[0]))
    return out


def lockfile_deps(text: str, path: str) -> list[tuple[str, str]]:
    """(name, version) of yarn.lock, package-lock.json, pnpm-lock.yaml or Cargo.lock."""
    base = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    if base == "yarn.lock":
        return _yarn(text)
    if base == "package-lock.json":
        return _package_lock(text)
    if base == "pnpm-lock.yaml":
        return _pnpm(text)
    if base == "cargo.lock":
        return [(p["name"], p["version"]) for p in tomllib.loads(text).get("package", [])]
    return []


def lockfile_table(docs: DataFrame) -> DataFrame:
    """docs(path, text) → (path, name, version); documents over the cap or unreadable give no rows."""
    from quarry.shipping import ship

    ship(docs.sparkSession)

    def run(frames):
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"]):
                try:
                    rows += [(path, n, v) for n, v in lockfile_deps(text, path)]
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "name", "version"])

    return docs.where(F.octet_length("text") <= CAPS["lock"]).select("path", "text").mapInPandas(run, "path string, name string, version string")
