"""Scored search over symbol names, suggestions, and grep over lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import fuzzy_score, multi_field_score, under
from quarry.operators.lookup import best_rank


def search(rows: DataFrame, query: str, limit: int = 20, loose: bool = True) -> DataFrame:
    """rows(id, name, base, scope, doc): best matches. One word looks at the name, else at base and doc; several at all fields."""
    words = query.split()
    if len(words) > 1:
        score = multi_field_score(words, {"name": 1.0, "base": 0.7, "scope": 0.6, "doc": 0.4}, loose)
    else:
        own = fuzzy_score(query, "name", loose)
        other = F.greatest(F.coalesce(fuzzy_score(query, "base", loose), F.lit(0.0)) * 0.7, F.coalesce(fuzzy_score(query, F.substring("doc", 1, 200), loose), F.lit(0.0)) * 0.4)
        score = F.when(own > 0, own).otherwise(other)
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def suggestions(names: DataFrame, query: str, limit: int = 5, loose: bool = True) -> DataFrame:
    """Closest distinct names by the best of the query's words, at 0.15 or more.

    Where there are none: by the words' parts of three letters or more, at 0.4 or more, times 0.7.
    """
    best = lambda parts: F.greatest(*[F.coalesce(fuzzy_score(w, "name", loose), F.lit(0.0)) for w in parts], F.lit(0.0))
    words = query.split()
    parts = [t for w in words for t in re.split(r"(?=[A-Z])|[_\-\s]+", w) if len(t) >= 3]
    s = names.select("name").distinct()
    rank = F.when(best(words) >= 0.15, 0)
    if parts:
        rank = rank.when(best(parts) >= 0.4, 1)
    s = best_rank(s.withColumns({"rank": rank, "score": F.when(best(words) >= 0.15, best(words)).otherwise(best(parts) * 0.7 if parts else 0.0)}), F.col("rank")).drop("rank")
    return s.orderBy(F.desc("score"), "name").limit(limit)


def search_or_suggest(rows: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """search's rows (suggested false); where there are none, suggestions for the query, without an id."""
    found = search(rows, query, limit).select("id", "name", "score", F.lit(False).alias("suggested"), F.lit(0).alias("k"))
    other = suggestions(rows, query).select(F.lit(None).cast("long").alias("id"), "name", "score", F.lit(True).alias("suggested"), F.lit(1).alias("k"))
    return best_rank(found.withColumn("id", F.col("id").cast("long")).union(other), F.col("k")).drop("k")


def grep(lines: DataFrame, files: DataFrame, pattern: str, prefix: str | None = None, language: str | None = None, limit: int = 50) -> DataFrame:
    """First match of each line of indexed files, any case, by path and line; col counts from 0. A pattern that can't be read matches nothing."""
    f = files.where((F.col("status") == "indexed") & under("path", prefix))
    if language:
        f = f.where(F.col("language") == language)
    try:
        re.compile(pattern)
    except re.error:
        return lines.join(f.select(F.col("id").alias("file_id"), "path"), "file_id").limit(0)
    p = "(?i)" + pattern
    hit = lines.where(F.col("content").rlike(p)).join(f.select(F.col("id").alias("file_id"), "path"), "file_id")
    m = F.regexp_substr("content", F.lit(p))
    hit = hit.select("path", "line", (F.regexp_instr("content", F.lit(p)) - 1).alias("col"), m.alias("match"), F.substring("content", 1, 200).alias("context"))
    return hit.orderBy("path", "line").limit(limit)
