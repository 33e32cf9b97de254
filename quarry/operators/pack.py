"""Greedy bundles under a token budget, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the budget that a phase may fill, counted from the start: outlines, sources, outlines of imports.
SHARES = {"A": 0.3, "B": 0.6, "C": 1.0}
MIN_BUDGET, MAX_BUDGET = 200, 50_000


def items_of(hits: DataFrame, outlines: DataFrame, sources: DataFrame, imports: DataFrame) -> DataFrame:
    """The items of searches: hits(query_id, rank, id, file_id, name) in the order of their rank.

    A: the outline of each hit's file; B: each hit's source, once for a file and name; C: the outlines of what the hits' files
    import, a group for each file in the order of its first hit. outlines(file_id, tokens), sources(id, tokens),
    imports(file_id, resolved_file_id, line). The outline of a file has the same key in A and C.
    """
    out = lambda df, phase, order, grp, key, tokens: df.select("query_id", F.lit(phase).alias("phase"), order.cast("long").alias("ord"), grp.cast("string").alias("grp"), key.cast("string").alias("key"), tokens.cast("long").alias("tokens"))
    o = outlines.select(F.col("file_id").alias("o_file"), F.col("tokens").alias("o_tokens"))
    files = hits.groupBy("query_id", "file_id").agg(F.min("rank").alias("rank"))
    a = out(files.join(o, F.col("file_id") == F.col("o_file")), "A", F.col("rank"), F.lit(None), F.concat(F.lit("file:"), "file_id"), F.col("o_tokens"))
    first = hits.groupBy("query_id", "file_id", "name").agg(F.min_by("id", "rank").alias("id"), F.min("rank").alias("rank"))
    b = out(first.join(sources.select("id", "tokens"), "id"), "B", F.col("rank"), F.lit(None), F.concat(F.lit("symbol:"), "id"), F.col("tokens"))
    i = imports.where("resolved_file_id is not null").groupBy(F.col("file_id").alias("i_file"), "resolved_file_id").agg(F.min("line").alias("line"))
    c = files.join(i, F.col("file_id") == F.col("i_file")).join(o, F.col("resolved_file_id") == F.col("o_file"))
    c = out(c, "C", F.col("rank") * 1_000_000 + F.col("line"), F.col("file_id"), F.concat(F.lit("file:"), "resolved_file_id"), F.col("o_tokens"))
    return a.union(b).union(c)


def pack(items: DataFrame, budget: int = 4000) -> DataFrame:
    """items(query_id, phase, ord, grp, key, tokens) folded in order into (query_id, total, taken, skipped), keys in order.

    A key that was taken in its phase is passed over. A miss is noted as skipped and ends phase A, ends its group in
    phase C, and ends phase B only once that is full. Items come from a query's top hits, so a fold is short.
    """
    budget = min(max(budget, MIN_BUDGET), MAX_BUDGET)
    cap = lambda x: F.coalesce(*[F.when(x["phase"] == p, F.lit(int(budget * s))) for p, s in SHARES.items()])
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).cast("long").alias("total"), none.alias("taken"), none.alias("skipped"), none.alias("ended"), none.alias("keys"), F.lit("").alias("group"), F.lit(True).alias("entered"))

    def step(a: Column, x: Column) -> Column:
        # outlines of imports share the keys of outlines
        key = F.concat(F.when(x["phase"] == "B", "B").otherwise("A"), F.lit(":"), x["key"])
        group = F.concat(x["phase"], F.lit(":"), F.when(x["phase"] == "C", F.coalesce(x["grp"], F.lit(""))).otherwise(""))
        # a group of phase C is only begun while there is room
        entered = F.when(a["group"] == group, a["entered"]).otherwise((x["phase"] != "C") | (a["total"] < budget))
        seen = F.array_contains(a["keys"], key) | F.array_contains(a["ended"], group) | ~entered
        fits = a["total"] + x["tokens"] <= cap(x)
        take, miss = ~seen & fits, ~seen & ~fits
        ends = miss & ((x["phase"] != "B") | (a["total"] >= cap(x)))
        add = lambda to, when, what: F.when(when, F.array_append(to, what)).otherwise(to)
        return F.struct(
            F.when(take, a["total"] + x["tokens"]).otherwise(a["total"]).alias("total"), add(a["taken"], take, x["key"]).alias("taken"), add(a["skipped"], miss, x["key"]).alias("skipped"), add(a["ended"], ends, group).alias("ended"), add(a["keys"], take, key).alias("keys"), group.alias("group"), entered.alias("entered")
        )

    row = F.struct("phase", F.col("ord").cast("long").alias("ord"), F.col("grp").cast("string").alias("grp"), F.col("key").cast("string").alias("key"), F.col("tokens").cast("long").alias("tokens"))
    got = items.groupBy("query_id").agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step).alias("p"))
    return got.select("query_id", "p.total", "p.taken", "p.skipped")
