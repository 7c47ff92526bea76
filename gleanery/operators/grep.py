"""Where a pattern occurs in texts."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import anchor_safe

FOUND = "struct<matches:array<struct<start:int,end:int,line:int,column:int>>,limited:boolean>"


def find(text: str, pattern: str, regex: bool = False, case_sensitive: bool = False, most: int = 20_000) -> tuple[list[tuple[int, int, int, int]], bool]:
    """(start, end, line, column) of matches, and whether there are more than `most`.

    A plain string is found wherever it begins, overlapping itself; a regular expression's matches do not overlap. Places count
    UTF-16 units, lines and columns from 1.
    """
    if not pattern or most < 1:
        return [], False
    body = pattern if regex else f"(?=({re.escape(pattern)}))"
    found = re.finditer(body, text, 0 if case_sensitive else re.IGNORECASE)
    breaks = [-1, *(m.start() for m in re.finditer("\n", text))]
    wide = any(ord(c) > 0xFFFF for c in text)
    unit = (lambda a, b: len(text[a:b].encode("utf-16-le")) // 2) if wide else (lambda a, b: b - a)
    out = []
    for match in found:
        if len(out) == most:
            return out, True
        start, end = match.span() if regex else match.span(1)
        line = bisect_right(breaks, start - 1)
        out.append((unit(0, start), unit(0, end), line, unit(breaks[line - 1] + 1, start) + 1))
    return out, False


def matches(texts: DataFrame, text: Column, pattern: str, regex: bool = False, case_sensitive: bool = False, most: int = 20_000) -> DataFrame:
    """texts with `found`: matches and whether there were more. Patterns that could take too long are refused."""
    if regex and (why := anchor_safe(pattern)) is not None:
        raise ValueError(why)

    @F.pandas_udf(FOUND)
    def search(column: pd.Series) -> pd.DataFrame:
        rows = [find(t or "", pattern, regex, case_sensitive, most) for t in column]
        keys = ("start", "end", "line", "column")
        return pd.DataFrame([([dict(zip(keys, m)) for m in found], more) for found, more in rows], columns=["matches", "limited"])

    # said to be nondeterministic so that a filter on what is found does not search a second time
    return texts.withColumn("found", search.asNondeterministic()(text))


def nearest_match(matches: Column, line: Column) -> Column:
    """The place (from 0) of the first match in a line or after it, else of the last one; -1 where there is none."""
    before = F.size(F.filter(matches, lambda m: m["line"] < line))
    return F.when(matches.isNotNull(), F.least(before, F.size(matches) - 1)).otherwise(-1)
