"""Parameter names of signatures."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, QUOTES = "([{<", ")]}>", "\"'`"
_LEAD = re.compile(r"(?:@\w+(?:\([^)]*\))?\s+)?(?:(?:public|private|protected|readonly)\s+){0,2}(?:\.\.\.)?")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_TOKEN = re.compile(r"\"(?:\\.|[^\"\\])*(?:\"|$)|'(?:\\.|[^'\\])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|$)|.", re.S)


def parameters(signature: str | None) -> list[str | None]:
    """Names within the first balanced parentheses, in order; None for a destructured one, [] without parentheses."""
    if signature is None or "(" not in signature:
        return []
    # round brackets alone end the list, all brackets guard commas
    round_, nested, part, parts = 0, 0, "", []
    for t in _TOKEN.findall(signature[signature.index("(") :]):
        round_ += (t == "(") - (t == ")")
        if t == "(" and round_ == 1:
            continue
        if round_ == 0:
            break
        nested += (t in OPEN) - (t in CLOSE)
        if t == "," and nested == 0:
            parts.append(part)
            part = ""
        else:
            part += t
    else:
        return []
    if part.strip():
        parts.append(part)
    names = []
    for p in parts:
        p = p.strip()
        hit = _NAME.match(p, _LEAD.match(p).end())
        names.append(hit.group() if hit else None)
    return names


@F.pandas_udf(T.ArrayType(T.StringType()))
def signature_params(signatures: pd.Series) -> pd.Series:
    return signatures.map(parameters)
