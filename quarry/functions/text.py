"""Column expressions for names, paths, docs and scores; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x: Column | str) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(col(x), UPPER, LOWER)


def same_name(x: Column | str, name: str) -> Column:
    return ascii_lower(x) == name.translate(TO_LOWER)


def posix(x: Column | str) -> Column:
    return F.translate(col(x), "\\", "/")


def basename(x: Column | str) -> Column:
    """Last segment without its extension."""
    return F.regexp_replace(F.element_at(F.split(col(x), "/"), -1), r"\.[^.]+$", "")


def dirname(x: Column | str) -> Column:
    return F.regexp_extract(col(x), "^(.*)/", 1)


def first_doc_line(x: Column | str) -> Column:
    return F.trim(F.element_at(F.split(col(x), "\n"), 1))


def doc_summary(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.element_at(F.split(F.regexp_replace(col(x), r"^\s*/\*+\s*", ""), "\n"), 1), r"\*/\s*$", ""))


def tokens_of(x: Column | str) -> Column:
    """camelCase, snake_case and spaced parts."""
    return F.filter(F.split(col(x), r"(?=[A-Z])|[_\-\s]+"), lambda t: t != "")


def estimate_tokens(x: Column | str) -> Column:
    return F.ceil(F.length(col(x)) / 4)


def context(x: Column | str) -> Column:
    return F.substring(F.trim(col(x)), 1, 200)


def under(path: Column | str, prefix: str | None) -> Column:
    """Literal path prefix, in any case."""
    return F.lit(True) if not prefix else F.lower(posix(path)).startswith(prefix.replace("\\", "/").lower())


def subsequence_score(query: str, x: Column | str) -> Column:
    """Greedy match of the query's letters in order: 0.3 + 0.05 a neighbour - at most 0.2 of 0.05 a gap, within 0.1 and 0.6; else 0."""
    q = F.array(*[F.lit(c) for c in query.lower()])
    start = F.struct(F.lit(1).alias("qi"), F.lit(-1).alias("last"), F.lit(0).alias("near"), F.lit(0).alias("gaps"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        hit = (a["qi"] <= len(query)) & (c == F.element_at(q, F.least(a["qi"], F.lit(len(query)))))
        near = hit & (a["last"] == a["i"] - 1) & (a["last"] >= 0)
        return F.struct(
            (a["qi"] + hit.cast("int")).alias("qi"), F.when(hit, a["i"]).otherwise(a["last"]).alias("last"), (a["near"] + near.cast("int")).alias("near"), (a["gaps"] + (hit & ~near).cast("int")).alias("gaps"), (a["i"] + 1).alias("i")
        )

    got = F.aggregate(F.split(F.lower(col(x)), ""), start, step)
    score = F.greatest(F.lit(0.1), F.least(F.lit(0.6), F.lit(0.3) + got["near"] * 0.05 - F.least(got["gaps"] * 0.05, F.lit(0.2))))
    could = F.lower(col(x)).rlike(".*".join(re.escape(c) for c in query.lower()))
    return F.when(could & (got["qi"] > len(query)), score).otherwise(0.0)


def fuzzy_score(query: str, x: Column | str, loose: bool = True) -> Column:
    """1 exact, .95 in any case, .9 prefix, .7 to .85 inside, else the subsequence score."""
    t, low = col(x), F.lower(col(x))
    at = F.instr(low, query.lower()) - 1
    inside = F.lit(0.7) + F.greatest(F.lit(0.0), F.lit(0.15) * (1 - at / F.length(t)))
    rest = subsequence_score(query, t) if loose else F.lit(0.0)
    return F.when(t == query, 1.0).when(low == query.lower(), 0.95).when(low.startswith(query.lower()), 0.9).when(at > 0, inside).otherwise(F.coalesce(rest, F.lit(0.0)))


def multi_field_score(words: list[str], fields: dict[str, float], loose: bool = True) -> Column:
    """Best weighted field per word; mean over all words times the root of the share matched; 0 if under half of several match."""
    best = [F.greatest(*[F.coalesce(fuzzy_score(w, f, loose), F.lit(0.0)) * k for f, k in fields.items()], F.lit(0.0)) for w in words]
    n = len(words)
    hit = sum((b > 0).cast("int") for b in best)
    total = sum(best[1:], best[0])
    share = hit / n
    score = total / n * F.sqrt(share)
    return F.when((hit == 0) | (F.lit(n > 1) & (share < 0.5)), 0.0).otherwise(score)


def doc_params(x: Column | str) -> Column:
    """Names of @param tags in order, repeats kept."""
    clean = F.regexp_replace(F.regexp_replace(col(x), r"^\s*/\*+", ""), r"\*/\s*$", "")
    return F.regexp_extract_all(clean, F.lit(r"(?m)^\s*\*?\s*@param\s+(?:\{[^}]*\}\s*)?\[?(?:\.\.\.)?([A-Za-z_$][\w$]*)"), F.lit(1))


def missing_from(a: Column | str, b: Column | str) -> Column:
    """Elements of a that b lacks, repeats kept."""
    return F.filter(col(a), lambda x: ~F.array_contains(col(b), x))


def bucket_risk(n: Column | str) -> Column:
    return F.when(col(n) <= 2, "low").when(col(n) <= 10, "medium").otherwise("high")


def test_path(path: Column | str) -> Column:
    """declared: *.test.* or *.spec.*, or below __tests__; derived: below tests or test at the root; else null."""
    p = F.lower(posix(path))
    parts = F.split(p, "/")
    base = F.split(F.element_at(parts, -1), r"\.")
    mark = (F.size(base) >= 3) & F.element_at(base, F.greatest(F.size(base) - 1, F.lit(1))).isin("test", "spec")
    return F.when(mark | F.array_contains(parts, "__tests__"), "declared").when((F.size(parts) >= 2) & F.element_at(parts, 1).isin("tests", "test"), "derived")


def clamp(x: int, low: int, high: int) -> int:
    return min(max(x, low), high)


def has_returns(x: Column | str) -> Column:
    """Whether a doc has a tag for what is returned."""
    return F.coalesce(col(x).rlike(r"(^|\n)\s*\*?\s*@returns?\b"), F.lit(False))


#: What a name's spelling tells (fixed values).
TRAITS = {"hook": "^use[A-Z]", "component": "^[A-Z][a-zA-Z0-9]*$", "constant": "^[A-Z][A-Z0-9_]*$", "exported": "^[A-Z]", "interface": "^I[A-Z]"}


def name_traits(x: Column | str) -> Column:
    """struct of booleans: hook, component, constant, exported (by a capital), interface (by an I and a capital)."""
    return F.struct(*[col(x).rlike(p).alias(k) for k, p in TRAITS.items()])


def normalize_path(x: Column | str) -> Column:
    """Collapse . and .. segments; .. above the root is ignored."""
    fold = F.aggregate(
        F.split(col(x), "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(fold, "/")


def relative_to(path: Column | str, root: str) -> Column:
    """A path from the root where it is below it, else as it is but with slashes; relative paths start at the root.

    Drive letters count as absolute.
    """
    p, top = posix(path), root.replace("\\", "/")
    absolute = p.startswith("/") | p.rlike("^[a-zA-Z]:/")
    whole = normalize_path(F.when(absolute, p).otherwise(F.concat(F.lit(top + "/"), p)))
    base = "/".join(x for x in top.split("/") if x not in ("", "."))
    if not base:
        return F.when(p.startswith("/"), whole).otherwise(F.when(absolute, p).otherwise(whole))
    return F.when(whole == base, "").when(whole.startswith(base + "/"), F.substr(whole, F.lit(len(base) + 2))).otherwise(p)


def porcelain_paths(x: Column | str) -> Column:
    """Paths of a short status, new names of renames, each once; untracked files are left out."""
    rows = F.filter(F.split(col(x), "\n"), lambda r: (F.length(r) >= 4) & ~r.startswith("??"))
    rest = F.transform(rows, lambda r: F.substr(r, F.lit(4)))
    new = F.transform(rest, lambda r: F.when(F.instr(r, " -> ") > 0, F.substr(r, F.instr(r, " -> ") + 4)).otherwise(r))
    return F.array_distinct(F.transform(new, lambda r: posix(F.trim(r))))


def name_status(x: Column | str) -> Column:
    """array of struct(status, path) of a NUL-separated status list; a rename or copy is a removal and an addition."""
    change = lambda s, p: F.struct(s.alias("status"), p.alias("path"))
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("code"), none.alias("old"), F.array().cast("array<struct<status:string,path:string>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        moved = a["code"].rlike("^[RC]")
        done = a["code"].isNotNull() & (~moved | a["old"].isNotNull())
        status = F.when(a["code"].isin("A", "D"), a["code"]).otherwise("M")
        said = F.when(moved, F.array(change(F.lit("D"), a["old"]), change(F.lit("A"), t))).otherwise(F.array(change(status, t)))
        return F.struct(
            F.when(a["code"].isNull(), t).when(~done, a["code"]).alias("code"),
            F.when(a["code"].isNotNull() & ~done, t).alias("old"),
            F.when(done, F.concat(a["out"], said)).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(F.filter(F.split(col(x), "\\x00"), lambda t: t != ""), start, step, lambda a: a["out"])


def csv_escape(x: Column | str) -> Column:
    t = col(x).cast("string")
    return F.when(t.isNull(), "").when(t.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def format_us(x: Column | str) -> Column:
    v = col(x)
    return F.when(v.isNull(), "-").when(v < 1000, F.concat(v.cast("string"), F.lit("us"))).otherwise(F.format_string("%.1fms", v / 1000))


def format_ms(x: Column | str) -> Column:
    v = col(x).cast("double")
    return F.when(v.isNull(), "-").when(v < 1, F.format_string("%.0fus", v * 1000)).otherwise(F.format_string("%.1fms", v))


def format_percent(x: Column | str) -> Column:
    return F.format_string("%.1f%%", col(x).cast("double") * 100)


def format_bytes(x: Column | str) -> Column:
    v = col(x).cast("double")
    k, m, g = 1 << 10, 1 << 20, 1 << 30
    return F.when(v < k, F.format_string("%.0f B", v)).when(v < m, F.format_string("%.1f KB", v / k)).when(v < g, F.format_string("%.1f MB", v / m)).otherwise(F.format_string("%.2f GB", v / g))
