"""Symbols as line intervals: enclosing symbol, range scans, end-line fallback, bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def export_name(edges: DataFrame) -> Column:
    """An export's name; one without is told by what it is."""
    default = [F.when(F.col("is_default"), "<default>")] if "is_default" in edges.columns else []
    return F.coalesce("name", *default, F.when(F.col("is_star"), "*"))


#: Lines of one bin of the range join; a symbol is one row for each bin that it touches.
BIN = 256


def enclosing(points: DataFrame, symbols: DataFrame, bin_lines: int = BIN) -> DataFrame:
    """points(file_id, line, ...) with the smallest symbol around each, ties to the lowest id; points outside all are dropped.

    Joined on (file, bin of lines), so a very long file spreads over many keys.
    """
    bins = F.sequence(F.floor(F.col("line") / bin_lines), F.floor(F.col("end_line") / bin_lines))
    s = symbols.where("end_line is not null and end_line >= line").select(
        F.col("file_id").alias("s_file"), F.col("line").alias("s_line"), F.col("end_line").alias("s_end"), F.col("id").alias("s_id"), F.col("name").alias("s_name"), F.explode(bins).alias("s_bin")
    )
    # one row per interval end suffices: of equal lines, the smallest interval wins
    p = points.withColumn("__bin", F.floor(F.col("line") / bin_lines))
    lines = p.select("file_id", "line", "__bin").distinct()
    hit = lines.join(s, (F.col("file_id") == F.col("s_file")) & (F.col("__bin") == F.col("s_bin")) & (F.col("line") >= F.col("s_line")) & (F.col("line") <= F.col("s_end")))
    inner = hit.groupBy("file_id", "line").agg(F.min_by(F.struct("s_id", "s_name", "s_line", "s_end"), F.struct(F.col("s_end") - F.col("s_line"), "s_id")).alias("e"))
    inner = inner.select("file_id", "line", F.col("e.s_id").alias("enclosing_id"), F.col("e.s_name").alias("enclosing_name"), F.col("e.s_line").alias("enclosing_line"), F.col("e.s_end").alias("enclosing_end"))
    return points.join(inner, ["file_id", "line"])


def in_range(occurrences: DataFrame, ranges: DataFrame, bin_lines: int = BIN) -> DataFrame:
    """occurrences within ranges(file_id, start, stop, range_id); joined on (file, bin of lines)."""
    return binned(occurrences, ranges, bin_lines).drop("r_file", "r_bin")


def binned(occurrences: DataFrame, ranges: DataFrame, bin_lines: int = BIN) -> DataFrame:
    """in_range with the keys of its join, r_file and r_bin: what is grouped by them needs no further shuffle."""
    bins = F.sequence(F.floor(F.col("start") / bin_lines), F.floor(F.col("stop") / bin_lines))
    r = ranges.where("stop >= start").select(F.col("file_id").alias("r_file"), "start", "stop", "range_id", F.explode(bins).alias("r_bin"))
    on = (F.col("file_id") == F.col("r_file")) & (F.floor(F.col("line") / bin_lines) == F.col("r_bin")) & F.col("line").between(F.col("start"), F.col("stop"))
    return occurrences.join(r, on)


def end_lines(symbols: DataFrame, line_counts: DataFrame) -> DataFrame:
    """Symbols with ``end``: their own, else the line before the next symbol, else 49 lines on or the file's end."""
    order = ["line", *(["col"] if "col" in symbols.columns else []), "id"]
    nxt = F.lead("line").over(Window.partitionBy("file_id").orderBy(*order))
    s = symbols.withColumn("__next", nxt).join(line_counts.select("file_id", "n_lines"), "file_id")
    return s.withColumn("end", F.coalesce("end_line", F.col("__next") - 1, F.least(F.col("line") + 49, F.col("n_lines")))).drop("__next")


def bodies(ended: DataFrame, texts: DataFrame) -> DataFrame:
    """ended(file_id, line, end, ...) with the source between, from texts(file_id, text)."""
    body = F.array_join(F.slice(F.split("text", "\n"), F.col("line"), F.greatest(F.col("end") - F.col("line") + 1, F.lit(0))), "\n")
    return ended.join(texts, "file_id").withColumn("source", body).drop("text")


def bodies_of_files(ended: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, source) of ended(id, file_id, line, end): bodies for many symbols of a file, whose text is moved and split once."""
    packs = ended.groupBy("file_id").agg(F.collect_list(F.struct("id", "line", "end")).alias("packed"))
    body = lambda lines, x: F.array_join(F.slice(lines, x["line"], F.greatest(x["end"] - x["line"] + 1, F.lit(0))), "\n")
    each = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("packed", lambda x: F.struct(x["id"].alias("id"), body(lines, x).alias("source"))))
    return texts.select("file_id", "text").join(packs, "file_id").select(F.inline(each[0]))


def outline(symbols: DataFrame) -> DataFrame:
    """Flat outline: parent is the latest symbol before, at top level, whose name is the scope; else null. Depth 0 or 1.

    One pass over each file and name: the parents and those that name them as their scope stand in one order.
    """
    own = symbols.select("file_id", "id", "name", "line", F.col("scope").alias("key"), F.lit(None).cast("long").alias("top"), F.lit(1).alias("k"))
    top = symbols.where("coalesce(scope, '') = ''").select("file_id", "id", "name", "line", F.col("name").alias("key"), F.col("id").cast("long").alias("top"), F.lit(0).alias("k"))
    w = Window.partitionBy("file_id", "key").orderBy("line", "k", "id").rowsBetween(Window.unboundedPreceding, 0)
    got = top.union(own.where("key is not null")).withColumn("parent_id", F.last("top", True).over(w)).where("k = 1")
    every = got.select("file_id", "id", "name", "line", "parent_id").union(own.where("key is null").select("file_id", "id", "name", "line", F.lit(None).cast("long")))
    return every.withColumn("depth", F.when(F.col("parent_id").isNull(), 0).otherwise(1))


def file_outlines(files: DataFrame, symbols: DataFrame, edges: DataFrame, paths: list[str]) -> DataFrame:
    """(path, missing, language, exports, imports, symbols) for each of some paths; lists in the order of their lines."""
    asked = files.sparkSession.createDataFrame([(p,) for p in paths], "asked string")
    f = asked.join(files, F.lower("path") == F.lower("asked"), "left")
    listed = lambda df, value, name: df.groupBy(F.col("file_id").alias(f"{name}_file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", value.alias("v")))), lambda x: x["v"]), ",").alias(name))
    x = listed(edges.where("kind in ('export', 're-export')"), export_name(edges), "exports")
    i = listed(edges.where("kind in ('import', 'dynamic-import', 'require')"), F.col("source"), "imports")
    s = listed(symbols, F.col("name"), "symbols")
    for df, name in ((x, "exports"), (i, "imports"), (s, "symbols")):
        f = f.join(df, F.col("id") == F.col(f"{name}_file"), "left").drop(f"{name}_file")
    lists = [F.coalesce(c, F.lit("")).alias(c) for c in ("exports", "imports", "symbols")]
    return f.select(F.col("asked").alias("path"), F.col("id").isNull().alias("missing"), "language", *lists)
