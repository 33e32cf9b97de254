"""Analytics over the event log and pack runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERRIDE_MS, MIN_EVENTS, MAX_OVERRIDE, P50_US, P95_US = 300_000, 30, 0.10, 50_000, 150_000
#: Ranges of values in which ranks are looked for.
RANGES = 1024
HIT_WARN, HIT_FAIL, USE_WARN, USE_FAIL, MIN_RUNS = 0.20, 0.40, 0.85, 0.90, 30


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Element min(n - 1, floor(p * n)) of each group's ascending values.

    Counts by ranges of values (of equal width between the group's ends) tell which range holds each rank; only the rows of
    those ranges are sorted. Ties are one row. A group is a single value and range in the worst case, never all its rows.
    """
    some = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    one = [F.lit(0).alias("__one")] if not by else []
    some = some.select("*", *one)
    keys = [*by, *(["__one"] if one else [])]
    ends = some.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__all"))
    bound = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__lo", "__hi", "__all")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    step = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (RANGES - 1))).otherwise(0).cast("int")
    placed = some.join(bound, on).withColumn("__r", step)
    per = placed.groupBy(*keys, "__all", "__r").agg(F.sum("__n").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*keys).orderBy("__r")) - F.col("__m")  # at most RANGES rows a group
    wanted = F.array(*[F.struct(F.lit(k).alias("share"), F.least(F.col("__all") - 1, F.floor(F.lit(p) * F.col("__all"))).alias("at")) for k, p in shares.items()])
    held = per.withColumn("__before", before).withColumn("w", F.explode(wanted)).where("w.at >= __before and w.at < __before + __m")
    held = held.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.col("__r").alias("__hr"), "__before", "w")
    on = F.col("__r") == F.col("__hr")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__h{i}"))
    near = placed.join(held, on)
    upto = near.withColumn("__hi", F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "w.share").orderBy("__v")))
    kind = df.schema[value].dataType
    return upto.groupBy(*keys).agg(*[F.min(F.when((F.col("w.share") == k) & (F.col("__hi") > F.col("w.at")), F.col("__v"))).cast(kind).alias(k) for k in shares]).drop("__one")


def rule_decisions(events: DataFrame) -> DataFrame:
    return events.where("hook_event = 'PreToolUse' and rule is not null").groupBy("rule", "decision").agg(F.count("*").alias("n"))


def overrides(events: DataFrame, window_ms: int = OVERRIDE_MS, distinct: bool = False) -> DataFrame:
    """Per rule: asks and those followed by a post event of the same session and input within the window.

    ``distinct``: an ask counts once however many events follow it. Joined on (session, input, bin of time) with the two
    bins that a window can touch, so a long session is spread over many keys.
    """
    pre = events.where("hook_event = 'PreToolUse' and decision = 'ask'").select("id", "rule", "session_id", "input_hash", "ts_ms")
    post = events.where("hook_event = 'PostToolUse'").select(F.col("session_id").alias("p_s"), F.col("input_hash").alias("p_h"), F.col("ts_ms").alias("p_ts"), F.floor(F.col("ts_ms") / window_ms).alias("p_bin"))
    bins = pre.withColumn("bin", F.explode(F.array(F.floor(F.col("ts_ms") / window_ms), F.floor(F.col("ts_ms") / window_ms) + 1)))
    hit = bins.join(post, (F.col("session_id") == F.col("p_s")) & (F.col("input_hash") == F.col("p_h")) & (F.col("bin") == F.col("p_bin")) & F.col("p_ts").between(F.col("ts_ms"), F.col("ts_ms") + window_ms))
    n = hit.groupBy("id").agg(F.count("*").alias("hits")).withColumnRenamed("id", "h_id")
    j = pre.join(n, F.col("id") == F.col("h_id"), "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    if distinct:
        return j.groupBy("rule").agg(F.count("*").alias("asks"), F.count_if(F.col("hits") > 0).alias("overridden"))
    return j.groupBy("rule").agg(F.sum(F.greatest("hits", F.lit(1))).alias("asks"), F.sum("hits").alias("overridden"))


def latency_percentiles(events: DataFrame) -> DataFrame:
    return nearest_rank(events.where("rule is not null"), ["rule"], "latency_us", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def metrics_gate(events: DataFrame, window_ms: int = OVERRIDE_MS) -> DataFrame:
    """Verdict per rule."""
    n = events.where("hook_event = 'PreToolUse' and rule is not null").groupBy("rule").agg(F.count("*").alias("events"))
    o = overrides(events, window_ms)
    j = n.join(o, "rule", "left").join(latency_percentiles(events), "rule", "left")
    rate = F.coalesce(F.when(F.col("asks") > 0, F.col("overridden") / F.col("asks")), F.lit(0.0))
    verdict = F.when(F.col("events") < MIN_EVENTS, "insufficient_data").when(F.col("rate") > MAX_OVERRIDE, "fail").when((F.col("p50") > P50_US) | (F.col("p95") > P95_US), "warn").otherwise("pass")
    return j.withColumn("rate", rate).select("rule", "events", F.round("rate", 6).alias("rate"), verdict.alias("verdict"))


def overall(verdicts: DataFrame) -> DataFrame:
    any_ = lambda v: F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False))
    every = F.coalesce(F.bool_and(F.col("verdict") == "insufficient_data"), F.lit(True))
    return verdicts.agg(F.when(any_("fail"), "fail").when(every, "insufficient_data").when(any_("warn"), "warn").otherwise("pass").alias("verdict"))


def digest(events: DataFrame, window_ms: int = OVERRIDE_MS) -> DataFrame:
    """(section, key, value): decisions by rule, asks and overrides, percentiles of latency, changes of opting, each by name."""
    row = lambda section, key, value: F.struct(F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))
    flat = lambda df, *facts: df.select(F.inline(F.array(*facts)))
    at = lambda suffix: F.concat("rule", F.lit(f":{suffix}"))
    parts = [
        flat(rule_decisions(events), row("decisions", F.concat_ws(":", "rule", "decision"), F.col("n"))),
        flat(overrides(events, window_ms), row("overrides", at("asks"), F.col("asks")), row("overrides", at("overridden"), F.col("overridden"))),
        flat(latency_percentiles(events), row("latency", at("p50"), F.col("p50")), row("latency", at("p95"), F.col("p95")), row("latency", at("p99"), F.col("p99"))),
        flat(opt_transitions(events), row("opt", F.col("hook_event"), F.col("n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def gate_text(verdicts: DataFrame) -> DataFrame:
    """metrics_gate's rows as lines of a report."""
    return verdicts.select("rule", F.format_string("%s: %s (%d events, %.1f%% overridden)", "rule", "verdict", "events", F.col("rate") * 100).alias("line"))


def pack_gate(runs: DataFrame) -> DataFrame:
    """One row: runs, hits of the budget, mean utilisation (runs with a budget), mean skipped, p50 and p95 of time, verdict."""
    hit = (F.col("budget_tokens") > 0) & (F.col("total_tokens") >= F.col("budget_tokens"))
    use = F.avg(F.when(F.col("budget_tokens") > 0, F.col("total_tokens") / F.col("budget_tokens")))
    a = runs.agg(F.count("*").alias("runs"), F.count_if(hit).alias("hits"), use.alias("use"), F.avg("skipped_count").alias("skipped"))
    p = nearest_rank(runs, [], "timing_ms", {"p50": 0.5, "p95": 0.95})
    rate = F.col("hits") / F.greatest("runs", F.lit(1))
    verdict = F.when(F.col("runs") < MIN_RUNS, "insufficient_data").when((rate >= HIT_FAIL) | (F.col("use") >= USE_FAIL), "fail").when((rate >= HIT_WARN) | (F.col("use") >= USE_WARN), "warn").otherwise("pass")
    return a.join(p, how="left").select("runs", "hits", F.round("use", 6).alias("mean_use"), F.round("skipped", 6).alias("mean_skipped"), F.round("p50", 2).alias("p50"), F.round("p95", 2).alias("p95"), verdict.alias("verdict"))


def ledger_summary(runs: DataFrame, last: int = 50) -> DataFrame:
    """Over the newest runs; a run without a budget counts as 0."""
    r = runs.orderBy(F.desc("ts_ms"), F.desc("id")).limit(last)
    return r.agg(F.count("*").alias("runs"), F.sum("total_tokens").alias("tokens"), F.round(F.avg(F.when(F.col("budget_tokens") > 0, F.col("total_tokens") / F.col("budget_tokens")).otherwise(0.0)), 6).alias("mean_use"))


def opt_transitions(events: DataFrame) -> DataFrame:
    """Opt events that change the session's state, by kind; the first of a session does."""
    o = events.where("hook_event in ('opt_in', 'opt_out')")
    before = F.lag("hook_event").over(Window.partitionBy("session_id").orderBy("ts_ms", "id"))
    return o.withColumn("__b", before).where("__b is distinct from hook_event").groupBy("hook_event").agg(F.count("*").alias("n"))


def _newest(events: DataFrame) -> DataFrame:
    return F.broadcast(events.agg(F.max("ts_ms").alias("__now")))  # one row


def decision_totals(events: DataFrame, now_ms: int | None = None, recent_ms: int = 3_600_000) -> DataFrame:
    """Events by decision, all and those of the last hour; without ``now_ms`` the newest event's time counts as now."""
    e = events.crossJoin(_newest(events)) if now_ms is None else events.withColumn("__now", F.lit(now_ms))
    return e.groupBy("decision").agg(F.count("*").alias("n"), F.count_if(F.col("ts_ms") >= F.col("__now") - recent_ms).alias("recent"))


def retained(events: DataFrame, now_ms: int | None = None, days: int = 30, rows: int = 100_000) -> DataFrame:
    e = events.crossJoin(_newest(events)) if now_ms is None else events.withColumn("__now", F.lit(now_ms))
    return e.where(F.col("ts_ms") >= F.col("__now") - days * 86_400_000).drop("__now").orderBy(F.desc("id")).limit(rows)
