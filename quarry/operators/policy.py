"""Tool-event rules as columns: the first that decides wins; one pass over all events.

Events have hook_event, tool_name, session_id, tool_input (JSON text) and tool_response (JSON text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import bucket_risk, col, posix, relative_to
from quarry.sources.scan import classify_path

#: What a rule says; decision null: nothing.
SAYS = "struct<decision:string,reason:string,additional_context:string>"

# Patterns that the decisions depend on.
NON_CODE_GLOB = r"(?i)\.(md|json|yaml|yml|toml|env|lock|txt|csv|html|xml|sql|sh|bat|cmd|log)$"
NON_CODE_TYPE = r"(?i)^(md|json|yaml|yml|toml)$"
NON_CODE_PATH = r"(?i)(node_modules|\.git|/?docs/|\.env|\.claude/)"
NON_CODE_TASK = r"(?i)^\s*(commit|deploy|push|git|install|lint|format|test|build|review|pr|release|merge|rebase|stash|status|telemetry|configure|setup)\b"
GIT_TRIGGERS = {
    "commit": r"^git\s+commit(\s|$)",
    "push": r"^git\s+push(\s|$)",
    "pr_create": r"^gh\s+pr\s+create(\s|$)",
}
TEST_COMMANDS = [
    r"^npm\s+(?:run\s+)?test(?::\S+)?(?:\s|$)",
    r"^pnpm\s+(?:run\s+)?test(?::\S+)?(?:\s|$)",
    r"^yarn\s+(?:run\s+)?test(?::\S+)?(?:\s|$)",
    r"^vitest(?:\s|$)",
    r"^jest(?:\s|$)",
    r"^pytest(?:\s|$)",
    r"^go\s+test(?:\s|$)",
    r"^cargo\s+test(?:\s|$)",
]
STRUCTURED = ["package_json", "tsconfig_json", "cargo_toml", "gha_workflow", "json_generic", "yaml_generic", "toml_generic"]
LOCKS = ["package_lock", "yarn_lock", "pnpm_lock", "cargo_lock"]


def _input(key: str) -> Column:
    return F.coalesce(F.get_json_object("tool_input", f"$.{key}"), F.lit(""))


def _say(decision: str, reason: str | Column | None = None, context: str | None = None) -> Column:
    reason = reason if isinstance(reason, Column) else F.lit(reason)
    return F.struct(F.lit(decision).alias("decision"), reason.alias("reason"), F.lit(context).alias("additional_context")).cast(SAYS)


def segments(command: Column | str) -> Column:
    """Parts of a shell line between && || and ;, without leading assignments."""
    bare = lambda s: F.regexp_replace(F.trim(s), r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", "")
    return F.transform(F.split(col(command), r"\s*(?:&&|\|\||;)\s*"), bare)


def git_trigger(command: Column | str) -> Column:
    """commit, push or pr_create by the first segment that is one; else null."""
    kind = lambda s: F.coalesce(*[F.when(s.rlike(p), k) for k, p in GIT_TRIGGERS.items()])
    return F.get(F.filter(F.transform(segments(command), kind), lambda k: k.isNotNull()), F.lit(0))


def test_command(command: Column | str) -> Column:
    """The first segment that runs tests; else null."""
    return F.get(F.filter(segments(command), lambda s: s.rlike("|".join(TEST_COMMANDS))), F.lit(0))


def grep_on_code() -> Column:
    glob, kind, path = _input("glob"), _input("type"), _input("path")
    said = F.when(glob.rlike(NON_CODE_GLOB), _say("allow", "non-code glob")).when(kind.rlike(NON_CODE_TYPE), _say("allow", "non-code type")).when(path.rlike(NON_CODE_PATH), _say("allow", "non-code path"))
    return F.when(F.col("tool_name") == "Grep", said.otherwise(_say("deny", "search code through the index")))


def agent_discipline(tool_prefix: str = "quarry_") -> Column:
    """Agents are let go if their prompt names a tool of the index, or if the task isn't about code."""
    names = _input("prompt").rlike(rf"(?i)\b{tool_prefix}\w+")
    explore = _input("subagent_type") == "Explore"
    said = F.when(explore & names, _say("allow", "explore-with-index")).when(explore, _say("deny", "explore through the index")).when(names, _say("allow", "prompt-mentions-index"))
    return F.when(F.col("tool_name") == "Agent", said.when(_input("description").rlike(NON_CODE_TASK), _say("allow", "non-code-description")).otherwise(_say("deny", "name the index tools in the prompt")))


def _touched(root: str) -> Column:
    """The event's path, from the root where it is below it."""
    return relative_to(_input("file_path"), root)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once; repeated in place it would outgrow generated code."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def read_on_structured(root: str = "/") -> Column:
    said = lambda k: F.when(k.isin(STRUCTURED), _say("ask", F.concat(F.lit("query its values instead: "), k))).when(k.isin(LOCKS), _say("ask", F.concat(F.lit("list its dependencies instead: "), k)))
    return F.when((F.col("tool_name") == "Read") & (_input("file_path") != ""), _let(classify_path(_touched(root))["kind"], said))


def read_on_source(root: str = "/") -> Column:
    paged = F.get_json_object("tool_input", "$.offset").isNotNull() | F.get_json_object("tool_input", "$.limit").isNotNull()
    source = classify_path(_touched(root))["kind"] == "source"
    fits = (F.col("tool_name") == "Read") & (_input("file_path") != "") & ~paged & ~posix(_input("file_path")).rlike(NON_CODE_PATH) & source
    return F.when(fits, _say("allow", None, "an outline or one symbol's source may do"))


def default_rules(root: str = "/", tool_prefix: str = "quarry_") -> dict[str, Column]:
    return {"grep-on-code": grep_on_code(), "agent-discipline": agent_discipline(tool_prefix), "read-on-structured": read_on_structured(root), "read-on-source": read_on_source(root)}


def dispatch(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Events with rule, decision, reason and additional_context (never with a denial); none decides: allow, rule null."""
    said = F.array(*[F.struct(F.lit(name).alias("rule"), column.alias("s")) for name, column in rules.items()])
    first = F.get(F.filter(said, lambda x: F.coalesce(x["s"]["decision"], F.lit("noop")) != "noop"), F.lit(0))
    e = events.withColumn("__d", first)
    context = F.when(F.col("__d.s.decision") != "deny", F.col("__d.s.additional_context"))
    return e.withColumns({"rule": F.col("__d.rule"), "decision": F.coalesce(F.col("__d.s.decision"), F.lit("allow")), "reason": F.col("__d.s.reason"), "additional_context": context}).drop("__d")


def test_runs(events: DataFrame) -> DataFrame:
    """(session_id, ts_ms, cmd) of test commands that ended well."""
    e = events.where("hook_event = 'PostToolUse' and tool_name = 'Bash' and coalesce(session_id, '') <> ''").where(F.get_json_object("tool_response", "$.exit_code") == "0")
    return e.select("session_id", "ts_ms", test_command(_input("command")).alias("cmd")).where("cmd is not null")


def stale_hint(touched: DataFrame, last_indexed_ms: int | None) -> DataFrame:
    """touched(path, mtime) with stale: changed since the index was built, or no index at all."""
    return touched.withColumn("stale", F.lit(True) if last_indexed_ms is None else F.coalesce(F.col("mtime") > last_indexed_ms, F.lit(False)))


def risk_max(risks: DataFrame, by: list[str]) -> DataFrame:
    """The highest of low, medium and high by key."""
    level = F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high")]), F.col("risk"))
    return risks.groupBy(*by).agg(F.max_by("risk", level).alias("risk"))


def preedit_impact(edits: DataFrame, files: DataFrame, importers: DataFrame, impact: DataFrame) -> DataFrame:
    """edits(id, path) with the importers of the file, its symbols' callers and their highest risk.

    importers(file_id, resolved_file_id), impact(file_id, name, callers, risk): one row per symbol.
    """
    f = edits.join(files.select(F.col("id").alias("file_id"), "path"), "path")
    n = importers.groupBy(F.col("resolved_file_id").alias("r")).agg(F.countDistinct("file_id").alias("importers"))
    i = impact.groupBy(F.col("file_id").alias("i")).agg(F.sum("callers").alias("callers")).join(risk_max(impact.withColumnRenamed("file_id", "j"), ["j"]), F.col("i") == F.col("j")).drop("j")
    j = f.join(n, F.col("file_id") == F.col("r"), "left").join(i, F.col("file_id") == F.col("i"), "left")
    return j.select("id", "path", F.coalesce("importers", F.lit(0)).alias("importers"), F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("risk", F.lit("low")).alias("risk"))


def evidence(changes: DataFrame, symbols: DataFrame, exports: DataFrame, calls: DataFrame, unused: DataFrame, tested: DataFrame, most: int = 50) -> DataFrame:
    """What a commit, push or pull request can show for itself, for each of changes(change_id, file_id).

    affected: exported top-level symbols of the changed files; max_callers and their risk (each symbol's callers are counted
    up to ``most``); new_unused: their unused exports; tests_run: whether tested(change_id) has it; evidence_ok: tests ran, the risk
    isn't high, nothing is unused. A change without affected symbols has no row.
    """
    x = exports.select(F.col("file_id").alias("x_file"), F.col("name").alias("x_name")).distinct()
    s = symbols.where("coalesce(scope, '') = ''").join(x, (F.col("file_id") == F.col("x_file")) & (F.col("name") == F.col("x_name"))).select("file_id", F.col("name").alias("symbol"))
    n = calls.groupBy("callee").agg(F.least(F.countDistinct("caller_id"), F.lit(most)).alias("callers"))
    c = changes.join(s, "file_id").join(n, F.col("symbol") == F.col("callee"), "left").groupBy("change_id").agg(F.count("*").alias("affected"), F.max(F.coalesce("callers", F.lit(0))).alias("max_callers"))
    u = changes.join(unused.select("file_id", F.col("name").alias("u")), "file_id").groupBy("change_id").agg(F.count("*").alias("new_unused"))
    t = tested.select("change_id", F.lit(True).alias("tests_run")).distinct()
    j = c.join(u, "change_id", "left").join(t, "change_id", "left").na.fill({"new_unused": 0, "tests_run": False}).withColumn("risk", bucket_risk("max_callers"))
    return j.withColumn("evidence_ok", F.col("tests_run") & (F.col("risk") != "high") & (F.col("new_unused") == 0))


def evidence_text(rows: DataFrame) -> DataFrame:
    """evidence's rows with a line of text for people."""
    said = F.concat_ws("; ", F.format_string("%d exported symbols touched", "affected"), F.format_string("up to %d callers (%s risk)", "max_callers", "risk"), F.when(F.col("new_unused") > 0, F.format_string("%d unused exports", "new_unused")), F.when(F.col("tests_run"), "tests ran").otherwise("no tests ran"))
    return rows.withColumn("summary", said)
