"""Highlighted snippets: a window of 24 words around the first hit, with hits marked."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skald.operators.query import tokens

BEFORE, LENGTH = 12, 24
_START, _END = "\0S\0", "\0E\0"


def _escaped(s: str) -> str:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = s.replace(sign, entity)
    return s


def mark(snippet: str | None, query: str) -> str | None:
    words = (snippet or "").split()
    if not words:
        return snippet
    own = [next(iter(tokens(w)), "") for w in words]
    asked = set(tokens(query))
    hits: set[int] = set()
    first = None
    for run in filter(None, (tokens(p) for p in re.findall('"([^"]*)"', query))):
        for i in range(len(own) - len(run) + 1):
            if own[i : i + len(run)] == run:
                hits.update(range(i, i + len(run)))
                first = i if first is None else first
    singles = [i for i, t in enumerate(own) if t and t in asked]
    hits.update(singles)
    first = first if first is not None else singles[0] if singles else 0
    start = max(0, first - BEFORE)
    end = min(start + LENGTH, len(words))
    line = " ".join(f"{_START}{words[i]}{_END}" if i in hits else words[i] for i in range(start, end))
    line = _escaped(unescape(line)).replace(_START, "<mark>").replace(_END, "</mark>")
    return (". " if start else "") + line + (" ." if end < len(words) else "")


def highlighted(snippet: Column, query: str) -> Column:
    """Runs on a result page only, where no built-in can mark words by their stems."""

    @F.pandas_udf(StringType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda s: mark(s, query))

    return run(snippet)
