"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only. Sizes are counts of ``[^\\x20\\x09-\\x0D]+``. Sources in code-point order, null last, weigh
1, 2, 3, repeating. Together they share the corpus' words; a source's target stops at ``max_epochs`` times its size and
what it can't take goes to the others by weight. Sorted by cap over weight, the filled sources are a prefix, so the level
of the rest follows from two running sums over one row per source and no iteration is needed.

A source's epochs are target / size: every document is repeated floor(epochs) times and a seeded subset once more. The
subset is a prefix of the source in the order of a digest of id and text, cut where its running size comes nearest to what
is left of the target. The cut is found by sums over digest prefixes, level by level, so that no task sorts a whole source;
only digests that share six hex digits with the cut are sorted, a row for each. Repeated rows at the cut are counted.

Edge cases: null text has size 0; null is a source of its own, last; a source of size 0 has target 0 and takes nothing;
of repeated rows (equal id and text) at the cut as many are taken as the target asks for, whichever; rows without an id are
told apart by their texts; an empty table gives an empty result; further columns pass through ``mix`` untouched, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import packed, stage, unstage

WORD = r"[^\x20\x09-\x0D]+"
LEVELS, DIGITS = 2, 3


def _size() -> F.Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def _digest(seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def targets(sizes: DataFrame, max_epochs: int = 3, cycle: int = 3) -> DataFrame:
    """sizes(source, size): one row per source with source_size, weight, target (double)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1).cast("long")
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    per = per.withColumns({"n": F.row_number().over(order), "full": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(everything)})
    per = per.withColumn("level", (F.col("total") - F.coalesce("full", F.lit(0))) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("n", "level"))).over(everything)["level"]
    return per.withColumn("water", level).select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def plan(sized: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sized(source, size, h): per source the target, the whole repetitions, and where the rows end that are taken once more:
    all below ``prefix``; below it those up to the digest ``last``, of whose rows ``part`` (null: all)."""
    t = targets(sized, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    cuts = stage(t.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit("")), "mix_cut")
    for k in range(LEVELS):
        at = cuts.select(F.col("source").alias("s0"), "rest", "before", "prefix")
        near = sized.join(at, F.col("source").eqNullSafe(F.col("s0")) & F.col("h").startswith(F.col("prefix")))
        sums = near.groupBy("source", F.substring("h", 1, (k + 1) * DIGITS).alias("p")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        end = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("p"))
        first = sums.withColumn("end", end).where("end > rest").groupBy(F.col("source").alias("s1")).agg(F.min(F.struct("p", (F.col("end") - F.col("n")).alias("b"))).alias("cut"))
        old, cuts = cuts, cuts.join(first, F.col("source").eqNullSafe(F.col("s1")), "left").withColumn("prefix", F.coalesce("cut.p", "prefix")).withColumn("before", F.coalesce("cut.b", "before")).drop("s1", "cut")
        cuts = stage(cuts, "mix_cut")
        unstage(old)
    at = cuts.select(F.col("source").alias("s0"), "rest", "before", "prefix")
    near = sized.join(at, F.col("source").eqNullSafe(F.col("s0")) & F.col("h").startswith(F.col("prefix")) & (F.length("prefix") > 0))
    runs = near.groupBy("source", "h").agg(F.max("size").alias("size"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row is taken where its middle lies within the rest
    fits = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("upto")) / F.col("size") + 0.5)).otherwise(F.when(F.col("upto") <= F.col("rest"), F.col("n")).otherwise(0))
    runs = runs.withColumn("upto", upto).withColumn("taken", F.least(fits, F.col("n")).cast("long")).where("taken > 0")
    last = runs.groupBy(F.col("source").alias("s1")).agg(F.max(F.struct("h", F.when(F.col("taken") < F.col("n"), F.col("taken")).alias("part"))).alias("last"))
    cuts = cuts.join(last, F.col("source").eqNullSafe(F.col("s1")), "left").select("source", "source_size", "weight", "target", "whole", "prefix", F.col("last.h").alias("last"), F.col("last.part").alias("part"))
    return stage(cuts, "mix_plan")


def _joined(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows(source, h, ...) with source_size, target, whole and extra: 1, 0, or null for repeated rows some of which are taken."""
    named = cuts.withColumnRenamed("source", "s0")
    h = F.col("h")
    extra = F.when(F.length("prefix") == 0, 0).when(~h.startswith(F.col("prefix")), (F.substring("h", 1, LEVELS * DIGITS) < F.col("prefix")).cast("int"))
    extra = extra.when((h == F.col("last")) & F.col("part").isNotNull(), F.lit(None)).otherwise(F.coalesce((h <= F.col("last")).cast("int"), F.lit(0)))
    return rows.join(named, rows["source"].eqNullSafe(named["s0"]), "left").withColumn("extra", extra).drop("s0", "prefix", "last", "weight")


def amounts(docs: DataFrame, max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, times for every row of docs."""
    sized = stage(docs.select("doc_id", "source", _size().alias("size"), _digest(seed).alias("h")), "mix_sizes")
    out = _joined(sized, plan(sized, max_epochs))
    clear = out.where("extra is not null").withColumn("times", F.col("whole") + F.col("extra"))
    # repeated rows are one row with a count until it is told how many of them are taken
    tied = out.where("extra is null").groupBy("doc_id", "size", "source_size", "target", "source", "whole", "part").agg(F.count("*").alias("n"))
    tied = tied.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("times", F.col("whole") + (F.col("k") <= F.col("part")).cast("int"))
    cols = ["doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "source", F.col("times").cast("long").alias("times")]
    return clear.select(*cols).union(tied.select(*cols))


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it."""
    sized = stage(docs.select("source", _size().alias("size"), _digest(seed).alias("h")), "mix_sizes")
    cuts = plan(sized, max_epochs)
    out = _joined(packed(docs, "source", _digest(seed).alias("h")), cuts)
    clear = out.where("extra is not null").select("row", (F.col("whole") + F.col("extra")).alias("times"))
    if not cuts.where("part is not null").isEmpty():
        order = Window.partitionBy("source").orderBy(F.xxhash64("row"))
        tied = out.where("extra is null").groupBy("source", "whole", "part", "row").agg(F.count("*").alias("n"))
        tied = tied.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        some = F.greatest(F.lit(0), F.least(F.col("n"), F.col("part") - F.col("before")))
        clear = clear.union(tied.select("row", F.col("n") * F.col("whole") + some))
    unstage(sized)
    return clear.where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))).select("row.*")


SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('11:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight
  from d group by source),
r as (select *, 3 * source_size as cap, (3 * source_size) / weight as ratio from s),
o as (
  select *, row_number() over (order by ratio, source nulls last) as n,
         coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as filled,
         (sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following))::bigint as open,
         (sum(source_size) over ())::bigint as total
  from r),
l as (select *, ((total - filled)::double / open::double) as level from o),
w as (select level as water from l where level <= ratio order by n limit 1),
t as (
  select source, source_size, least(cap::double, water * weight) as target from l, w),
p as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
c as (
  select d.doc_id, d.size, p.source_size, p.target, p.source, p.whole, p.target - p.whole * p.source_size as rest,
         (sum(d.size) over (partition by d.source order by d.h, d.size rows between unbounded preceding and current row))::bigint as upto
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, source,
       whole + case when source_size > 0 and 2 * upto - size <= 2 * rest then 1 else 0 end as times,
       (whole + case when source_size > 0 and 2 * upto - size <= 2 * rest then 1 else 0 end) * size as taken
from c
"""
