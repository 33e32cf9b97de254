"""File scans, path classification and ignore rules."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import col, name_status, posix
from quarry.operators.overlay import merge_change_sets

# Names, extensions and folders that the results depend on.
BASENAMES = {
    "package.json": "package_json",
    "package-lock.json": "package_lock",
    "yarn.lock": "yarn_lock",
    "pnpm-lock.yaml": "pnpm_lock",
    "cargo.toml": "cargo_toml",
    "cargo.lock": "cargo_lock",
}
LANGUAGES = {
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "csharp": [".cs"],
    "css": [".css"],
}
GENERIC = {".json": "json_generic", ".yml": "yaml_generic", ".yaml": "yaml_generic", ".toml": "toml_generic"}
EXCLUDES = ["node_modules", "dist", ".next", ".nuxt", "build", "out", ".git", "__pycache__", "target", "bin", "obj"]
MAX_BYTES, MINIFIED_LINE, HEAD = 1_048_576, 500, 10_240

SCANNED = "path string, mtime double, size long, hash string, content binary"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key)


def classify_path(path: Column | str, languages: dict[str, list[str]] | None = None) -> Column:
    """struct(kind, language) of a workspace path; ``languages`` maps further extensions and wins over the usual ones."""
    p = posix(path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    low = F.lower(name)
    extension = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    known = {e: lang for lang, exts in LANGUAGES.items() for e in exts}
    own: dict[str, str] = {}
    for lang, exts in (languages or {}).items():
        for e in exts:
            own.setdefault((e if e.startswith(".") else f".{e}").lower(), lang)
    language = _lookup(known | own, extension)
    workflow = low.rlike(r"\.ya?ml$") & (F.size(parts) == 3) & (F.element_at(parts, 1) == ".github") & (F.try_element_at(parts, F.lit(2)) == "workflows")
    special = F.coalesce(
        _lookup(BASENAMES, low),
        F.when(low.startswith("tsconfig") & low.endswith(".json"), "tsconfig_json"),
        F.when(workflow, "gha_workflow"),
    )
    found = F.array(F.struct(special.alias("special"), language.alias("language"), _lookup(GENERIC, extension).alias("generic")))
    kind = lambda x: F.coalesce(x["special"], F.when(x["language"].isNotNull(), "source"), x["generic"], F.lit("ignored"))
    both = F.transform(found, lambda x: F.struct(kind(x).alias("kind"), F.when(x["special"].isNull(), x["language"]).alias("language")))
    return F.when(p.isNotNull(), F.get(both, F.lit(0)))


def minified(text: Column | str, size: Column | str) -> Column:
    """Files over 1 KiB whose first 10,240 bytes hold long lines on average, or next to no line breaks."""
    n = F.length(F.regexp_replace(col(text), "[^\n]", ""))
    long_lines = F.length(col(text)) / (n + 1) > MINIFIED_LINE
    return (col(size) > 1024) & ((n == 0) | long_lines | ((n < 5) & (col(size) >= HEAD)))


def _glob(pattern: str) -> str:
    """Java regex of a gitignore glob; with a slash it holds from the root, else for any segment."""
    out, rest = [], pattern[1:] if pattern.startswith("/") else pattern
    token = re.compile(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|.", re.S)
    fixed = {"**/": "(?:.+/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "[]": "(?!)", "[^]": r"[\s\S]"}
    for t in token.findall(rest):
        if t in fixed:
            out.append(fixed[t])
        elif len(t) > 1:
            out.append("[" + t[1:-1].replace("[", r"\[").replace("&", r"\&") + "]")
        else:
            out.append(re.escape(t))
    return ("^" if "/" in pattern else "(?:^|/)") + "".join(out) + "(?:/|$)"


def ignored(path: Column | str, *lists: list[str], is_dir: bool = False) -> Column:
    """Whether gitignore-style lines exclude a path; the default folders come first and the last match wins."""
    p = posix(path)
    parent = F.regexp_extract(p, "^(.*)/", 1)
    verdicts = []
    for line in [f"{x}/" for x in EXCLUDES] + [x for lines in lists for x in lines]:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        if line.endswith("/") and not is_dir:
            hit = p.contains("/") & parent.rlike(_glob(line[:-1]))
        else:
            hit = p.rlike(_glob(line.removesuffix("/")))
        verdicts.append(F.when(hit, F.lit(not keep)))
    return F.coalesce(*reversed(verdicts), F.lit(False))


def list_git(root: str) -> list[str] | None:
    """Tracked and untracked paths that git doesn't ignore; None where git can't tell."""
    try:
        said = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return None
    return sorted({os.fsdecode(x) for x in said.stdout.split(b"\0") if x})


def list_directory(root: str) -> list[str]:
    """Paths below root; folders that are always left out aren't entered."""
    found = []
    for top, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in EXCLUDES)
        found += [os.path.relpath(os.path.join(top, n), root).replace(os.sep, "/") for n in names]
    return sorted(found)


def _reader(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b.path:  # one file at a time in memory
                full = os.path.join(root, path)
                try:
                    stat = os.stat(full)
                    if stat.st_size > MAX_BYTES or not os.path.isfile(full):
                        continue
                    with open(full, "rb") as f:
                        data = f.read()
                except OSError:  # gone since the listing
                    continue
                yield pd.DataFrame({"path": [path], "mtime": [stat.st_mtime * 1000], "size": [stat.st_size], "hash": [hashlib.sha256(data).hexdigest()], "content": [data]})

    return read


def _sources(found: DataFrame, languages: dict[str, list[str]] | None) -> DataFrame:
    found = found.withColumn("c", classify_path("path", languages))
    text = F.make_valid_utf8(F.substring("content", 1, HEAD).cast("string"))
    found = found.where(~minified(text, "size"))
    return found.select("path", "mtime", "size", "hash", F.col("c.language").alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def scan(spark: SparkSession, root: str, excludes: list[str] | None = None, languages: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, mtime, size, hash, language, text) of a work tree's sources; the tree is on a folder that all executors mount.

    Only names are listed on the driver; executors read, hash and filter.
    """
    paths = list_git(root)
    lists = [excludes or []]
    if paths is None:
        paths, own = list_directory(root), os.path.join(root, ".gitignore")
        if os.path.exists(own):
            with open(own, encoding="utf-8") as f:
                lists.insert(0, f.read().split("\n"))
    names = spark.createDataFrame([(p,) for p in paths], "path string")
    names = names.where((classify_path("path", languages)["kind"] == "source") & ~ignored("path", *lists))
    names = names.repartition(max(1, min(len(paths) // 64, 10_000)))
    return _sources(names.mapInPandas(_reader(root), SCANNED), languages)


def scan_store(spark: SparkSession, uri: str, excludes: list[str] | None = None, languages: dict[str, list[str]] | None = None) -> DataFrame:
    """The same from any store that Spark reads; Spark leaves out names that begin with a dot or an underscore."""
    at = spark._jvm.org.apache.hadoop.fs.Path(uri)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    # the limit on length reaches the scan: larger files aren't read
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri).where(F.col("length") <= MAX_BYTES)
    found = found.withColumn("path", F.substr("path", F.lit(len(base) + 2)))
    found = found.where((classify_path("path", languages)["kind"] == "source") & ~ignored("path", excludes or []))
    found = found.select("path", (F.unix_millis("modificationTime").cast("double")).alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), "content")
    return _sources(found, languages)


_CHANGES = "path string, status string"


def _diff(spark: SparkSession, root: str, *args: str) -> DataFrame:
    said = subprocess.run(["git", "-C", root, "diff", "--name-status", "--no-renames", "-z", *args], capture_output=True, check=True).stdout.decode(errors="replace")
    return spark.createDataFrame([(said,)], "t string").select(F.inline(name_status("t"))).select("path", "status")


def git_changes(spark: SparkSession, root: str, ref: str, other: str = "HEAD") -> DataFrame:
    """(path, status) by git between two revisions; a rename is a removal and an addition."""
    return _diff(spark, root, f"{ref}...{other}")


def git_staged(spark: SparkSession, root: str) -> DataFrame:
    return _diff(spark, root, "--cached", "HEAD")


def git_unstaged(spark: SparkSession, root: str) -> DataFrame:
    return _diff(spark, root)


def git_untracked(spark: SparkSession, root: str) -> DataFrame:
    said = subprocess.run(["git", "-C", root, "ls-files", "--others", "--exclude-standard", "-z"], capture_output=True, check=True).stdout.decode(errors="replace")
    return spark.createDataFrame([(p, "A") for p in said.split("\0") if p], _CHANGES)


def working_changes(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path, status) of a work tree since ``base``: committed, staged, unstaged, untracked; the later source wins."""
    return merge_change_sets(git_changes(spark, root, base), git_staged(spark, root), git_unstaged(spark, root), git_untracked(spark, root))


def is_ancestor(root: str, ref: str, other: str = "HEAD") -> bool:
    return subprocess.run(["git", "-C", root, "merge-base", "--is-ancestor", ref, other], capture_output=True).returncode == 0


def git_show(root: str, ref: str, path: str) -> str | None:
    """A file's text at a revision; None if it isn't there."""
    said = subprocess.run(["git", "-C", root, "show", f"{ref}:{path}"], capture_output=True)
    return said.stdout.decode(errors="replace") if said.returncode == 0 else None
