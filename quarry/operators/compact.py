"""Short output: short keys, nothing empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The short keys.
KEYS = {
    "actual": "ac",
    "alias": "a",
    "call_sites": "cs",
    "callers": "cl",
    "caller": "c",
    "change_type": "ct",
    "children": "ch",
    "col": "cc",
    "confidence": "cf",
    "context": "x",
    "count": "n",
    "deps": "dp",
    "direction": "dr",
    "doc": "d",
    "doc_summary": "ds",
    "end_line": "el",
    "entries": "es",
    "exports": "ex",
    "file": "f",
    "found": "fd",
    "imports": "im",
    "is_default": "id",
    "is_star": "is",
    "is_type": "it",
    "key": "ke",
    "kind": "k",
    "language": "lg",
    "length": "ln",
    "limit": "lm",
    "line": "l",
    "lines": "ls",
    "match": "m",
    "name": "nm",
    "names": "nms",
    "outline": "o",
    "path": "p",
    "payload": "pl",
    "preview": "pr",
    "results": "r",
    "scope": "sc",
    "signature": "s",
    "source": "src",
    "status": "st",
    "symbol_count": "sn",
    "target": "tg",
    "tokens": "t",
    "truncated": "tr",
    "type": "ty",
    "value": "v",
    "value_kind": "vk",
    "version": "ve",
}


def _shrink(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.nullif(x, F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.when(x, x)
    if isinstance(kind, T.ArrayType):
        short = F.array_compact(F.transform(x, lambda y: _shrink(y, kind.elementType)))
        return F.when(F.size(short) > 0, short)
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[_shrink(x[f.name], f.dataType).alias(KEYS.get(f.name, f.name)) for f in kind.fields]))
    return x


def compact(rows: DataFrame) -> DataFrame:
    """Rows with short column names, nested ones too; null for what is empty or false, so to_json leaves it out."""
    return rows.select(*[_shrink(F.col(f"`{f.name}`"), f.dataType).alias(KEYS.get(f.name, f.name)) for f in rows.schema.fields])


def compact_json(rows: DataFrame) -> DataFrame:
    """(json) one line per row."""
    short = compact(rows)
    return short.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in short.columns])).alias("json"))
