"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in a shard drawn by digest; in each round a hub per group of
equal texts counts its members by shard, a join brings the counts to the members, and each wants the shard that holds
most of them (ties by a digest of group and shard, so that a group agrees). Moves into a shard are admitted up to its free
capacity: a group that fits moves whole, of larger ones as many members as fit. What the rounds leave cut though it would
fit a shard is then packed whole, largest first, into the room that whole groups leave: members of groups over one shard's
size yield their places, as these are cut in any case. Where that doesn't suffice, all groups are packed anew. Documents
without links fill what is left; so all shards end with counts at most one apart (law ``rows``), and only groups over a
shard's size are cut, or such that find no shard with room when packed largest first.

Ranks, for the fill and for slots, come from counts by digest prefix (`hash_rank`); no task sorts a shard. All of this is
done on narrow rows; ``assign`` then moves each text once, to meet its place.

Edge cases: null text has size 1, CRC 0 and no links; a null doc_id is a row like others; repeated rows are linked rows;
with fewer rows than shards some shards are empty; an empty table gives an empty result; further columns pass through
``assign`` untouched, whatever their names, but for an input's own ``shard`` and ``slot``, which the new ones replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import HOT, hash_rank, join_one, packed, stage, unstage

ROUNDS = 6
#: Up to so many repetitions of one row its places are one list.
LISTED = 10_000


def _group() -> F.Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def _row(seed: int) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(F.col("text").isNull(), "null").otherwise(_group())))


def propagate(members: DataFrame, shards: int, capacity: int) -> DataFrame:
    """members(node, draw, hub, shard) → the same with shards after label propagation; moves into a shard are drawn so that
    they fill its free capacity on average (`pack` mends what that leaves)."""
    cur = members
    total = cur.count()
    for _ in range(ROUNDS):
        hubs = cur.groupBy("hub").agg(F.array(*[F.count_if(F.col("shard") == i) for i in range(shards)]).alias("by"))
        tie = lambda i: F.pmod(F.xxhash64("hub", F.lit(i)), F.lit(1 << 30))
        best = F.array_max(F.array(*[F.struct(F.col("by")[i].alias("n"), tie(i).alias("t"), F.lit(i).alias("to")) for i in range(shards)]))
        hubs = hubs.select("hub", best["to"].alias("to"), F.expr("aggregate(by, 0L, (x, y) -> x + y)").alias("members"))
        want = stage(join_one(cur, hubs.withColumn("weight", F.col("members")), "hub", "weight", total).select("node", "draw", "hub", "shard", "to", "members"), "shard_want")
        load = {r["shard"]: r for r in want.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("to") != F.col("shard")).alias("leave")).collect()}
        asked = {r["to"]: r["n"] for r in want.where("`to` <> shard").groupBy("to").agg(F.count("*").alias("n")).collect()}
        if not asked:
            unstage(want)
            break
        free = {s: capacity - (load[s]["n"] - load[s]["leave"] if s in load else 0) for s in range(shards)}
        share = {s: max(0.0, min(1.0, free[s] / n)) for s, n in asked.items()}
        f = F.lit(0.0)
        room = F.lit(0)
        for s, x in share.items():
            f = F.when(F.col("to") == s, F.lit(x)).otherwise(f)
            room = F.when(F.col("to") == s, F.lit(max(0, free[s]))).otherwise(room)
        whole = F.col("members") * 8 <= room
        draw = F.pmod(F.when(whole, F.xxhash64("hub", F.lit("m"))).otherwise(F.col("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        new = stage(want.withColumn("shard", F.when((F.col("to") != F.col("shard")) & (draw < f), F.col("to")).otherwise(F.col("shard"))).select("node", "draw", "hub", "shard"), "shard_round")
        unstage(want)
        unstage(cur)
        cur = new
    return cur


def _fill(count: dict[int, int], free: list[int]) -> tuple[list[tuple[int, int, int, int]], bool]:
    """Largest first into the freest shards: (size, shard, from, to) by rank of the groups of a size, and if all fit."""
    free, out, every = list(free), [], True
    for size in sorted(count, reverse=True):
        done = 0
        for s in sorted(range(len(free)), key=lambda s: (-free[s], s)):
            some = min(count[size] - done, max(0, free[s]) // size)
            if some:
                out.append((size, s, done, done + some))
                free[s] -= some * size
                done += some
        every &= done == count[size]
    return out, every


def pack(members: DataFrame, shards: int, capacity: int, rows: int) -> DataFrame:
    """members(node, draw, hub, shard) → (node, shard, whole): groups of up to capacity in one shard each, as far as these have room.

    The driver sees how many groups there are of each size, at most sqrt(2 * rows) numbers.
    """
    spark = members.sparkSession
    groups = stage(members.groupBy("hub").agg(F.count("*").alias("n"), F.min("shard").alias("least"), F.max("shard").alias("most")), "shard_groups")
    sizes_ = groups.select("hub", F.col("n").alias("weight"))
    groups = groups.where(F.col("n") <= capacity)
    kept = F.col("least") == F.col("most")
    load = {r["least"]: r["n"] for r in groups.where(kept).groupBy("least").agg(F.sum("n").alias("n")).collect()}
    sizes = lambda df: {r["n"]: r["count"] for r in df.groupBy("n").count().collect()}
    free = [capacity - load.get(s, 0) for s in range(shards)]
    ranges, fits = _fill(sizes(groups.where(~kept)), free)
    if not fits or min(free) < 0:
        anew = _fill(sizes(groups), [capacity] * shards)
        # whole groups keep their shards unless these are overfull or packing anew places all
        if anew[1] or min(free) < 0:
            kept, ranges = F.lit(False), anew[0]
    where = spark.createDataFrame(ranges, "size long, to int, low long, high long")
    ranked = hash_rank(groups.where(~kept).select("hub", "n"), ["n"], ["hub"], rows)
    to = ranked.join(F.broadcast(where), (F.col("n") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("hub", "to")
    to = to.union(groups.where(kept).select("hub", F.col("least").alias("to")))
    to = stage(sizes_.join(to, "hub", "left"), "shard_packed")
    return join_one(members, to, "hub", "weight", members.count()).select("node", F.coalesce("to", "shard").alias("shard"), F.col("to").isNotNull().alias("whole"))


def layout(docs: DataFrame, shards: int = 8, seed: int = 5) -> DataFrame:
    """h (digest of the row), doc_id, size, text_crc32, shard, slot for every row of docs; staged."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    base = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.when(F.col("text").isNotNull(), _group()).alias("hub"), _row(seed).alias("h"))
    # a repeated row is a node of its own
    base = stage(base.withColumn("node", F.monotonically_increasing_id()), "shard_rows")
    n = base.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")
    several = base.where("hub is not null").groupBy("hub").agg(F.count("*").alias("weight")).where("weight > 1").withColumn("linked", F.lit(True))
    nodes = stage(join_one(base, several, "hub", "weight", n).select(*base.columns, "linked"), "shard_nodes")
    linked = nodes.where("linked")
    moved = propagate(stage(linked.select("node", F.xxhash64("h", F.lit("m")).alias("draw"), "hub", start.alias("shard")), "shard_start"), shards, min(quota) if n else 0)
    packs = pack(moved, shards, min(quota) if n else 0, n)
    placed = linked.select("node", "h", "doc_id", "size", "text_crc32").join(packs, "node")
    placed = stage(hash_rank(placed, ["shard", "whole"], ["h"], n).withColumnRenamed("rank", "slot"), "shard_placed")
    unstage(moved)
    whole = {r["shard"]: r["n"] for r in placed.where("whole").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # members of cut groups come after those of whole ones
    after, fits = F.lit(0), F.lit(False)
    for s in range(shards):
        after = F.when(F.col("shard") == s, F.lit(whole.get(s, 0))).otherwise(after)
        fits = F.when(F.col("shard") == s, F.col("slot") < quota[s]).otherwise(fits)
    ranked = placed.withColumn("slot", F.col("slot") + F.when(F.col("whole"), 0).otherwise(after)).drop("whole")
    held = {r["shard"]: r["n"] for r in ranked.where(fits).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    cols = ["h", "doc_id", "size", "text_crc32"]
    pool = hash_rank(nodes.where("linked is null").select(*cols).union(ranked.where(~fits).select(*cols)), [], ["h"], n)
    shard, slot, low = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        high = low + quota[s] - held.get(s, 0)
        here = (F.col("rank") >= low) & (F.col("rank") < high)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("rank") - low + held.get(s, 0)).otherwise(slot)
        low = high
    filled = pool.select(*cols, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    out = stage(ranked.where(fits).select(*cols, "shard", F.col("slot").cast("long").alias("slot")).union(filled), "shard_places")
    for x in (base, nodes, placed):
        unstage(x)
    return out


def shard_table(docs: DataFrame, shards: int = 8, seed: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    return layout(docs, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def assign(docs: DataFrame, shards: int = 8, seed: int = 5) -> DataFrame:
    """The rows of docs with ``shard`` and ``slot``; repeated rows each get a place."""
    places = layout(docs, shards, seed)
    n = places.count()
    hot = F.broadcast(stage(places.groupBy("h").count().where(F.col("count") > max(LISTED, HOT * n)).select("h"), "shard_hot"))
    rows = packed(docs, "doc_id", "text").select("row", _row(seed).alias("h"))
    lists = places.join(hot, "h", "left_anti").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("at"))
    nth = F.row_number().over(Window.partitionBy("h").orderBy(F.xxhash64("row")))
    out = rows.join(hot, "h", "left_anti").join(lists, "h").withColumn("to", F.col("at")[nth - 1]).select("row", "to.shard", "to.slot")
    if not hot.isEmpty():
        # the repetitions of a hot row meet its places by rank, both in the order of digests of their own
        some = stage(rows.join(hot, "h").withColumn("u", F.monotonically_increasing_id()), "shard_hot_rows")
        mine = hash_rank(some.select("h", "u", F.md5(F.col("u").cast("string")).alias("d")), ["h"], ["d"], n).select("h", "u", "rank")
        theirs = hash_rank(places.join(hot, "h").withColumn("d", F.md5(F.concat_ws(":", "shard", "slot"))), ["h"], ["d"], n).select("h", "rank", "shard", "slot")
        out = out.union(some.join(mine.join(theirs, ["h", "rank"]).select("u", "shard", "slot"), "u").select("row", "shard", "slot"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
