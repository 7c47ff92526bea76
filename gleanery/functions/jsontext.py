"""JSON with comments as `path: value` leaves."""

from __future__ import annotations

import json
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|$)', re.S)
_COMMAS = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.S)


def _shown(value) -> str:
    """A leaf as JavaScript prints it."""
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, float):
        if value.is_integer() and abs(value) < 1e21:
            return str(int(value))
        return re.sub(r"e([+-])0*(\d)", r"e\1\2", repr(value))
    return str(value)


def bare(text: str) -> str:
    """text with spaces in place of comments and trailing commas, so that every place stays."""
    blank = lambda m: m[1] or re.sub(r"[^\n]", " ", m[0])
    return _COMMAS.sub(blank, _PARTS.sub(blank, text))


def _below(path: str, key: str | int) -> str:
    return f"{path}[{key}]" if isinstance(key, int) else f"{path}.{key}" if path else key


def leaves(text: str) -> list[tuple[str, str]] | None:
    """(path, value) of every scalar, in order; None if the text is no JSON even without comments and trailing commas."""
    try:
        waiting = [("", json.loads(bare(text)))]
    except ValueError:
        return None
    found = []
    while waiting:
        path, value = waiting.pop()
        if isinstance(value, dict | list):
            entries = value.items() if isinstance(value, dict) else enumerate(value)
            waiting += reversed([(_below(path, k), v) for k, v in entries])
        else:
            found.append((path or "$", _shown(value)))
    return found


def places(text: str) -> dict[str, tuple[int, int]]:
    """Where the value of each path stands in a well-formed text, in one pass; of a repeated key the last counts."""
    found: dict[str, tuple[int, int]] = {}
    open_: list[list] = []  # the path of each open container, and the key or index that is due in it
    for match in _TOKENS.finditer(bare(text)):
        token, first = match[0], match[0][0]
        if first in "{[":
            path = _below(open_[-1][0], open_[-1][1]) if open_ else ""
            open_.append([path, 0 if first == "[" else None])
        elif first in "}]":
            open_.pop()
        elif first == ",":
            open_[-1][1] = open_[-1][1] + 1 if isinstance(open_[-1][1], int) else None
        elif first != ":":
            if open_ and open_[-1][1] is None:
                open_[-1][1] = json.loads(token)
            else:
                found[_below(open_[-1][0], open_[-1][1]) if open_ else "$"] = match.span()
    return found


_TOKENS = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)


def placed_leaves(text: str) -> list[dict] | None:
    """leaves with their lines (from 1) and offsets."""
    found = leaves(text)
    if found is None:
        return None
    at, breaks = places(text), [m.start() for m in re.finditer("\n", text)]
    out = []
    for path, value in found:
        start, end = at.get(path, (0, 0))
        out.append({"path": path, "value": value, "start_line": bisect_left(breaks, start) + 1, "end_line": bisect_left(breaks, end) + 1, "start_offset": start, "end_offset": end})
    return out


def json_leaves(text: Column) -> Column:
    """array<struct<path, value, ...>> of a JSON text, with lines and offsets; null if it is malformed."""

    @F.pandas_udf("array<struct<path:string,value:string,start_line:int,end_line:int,start_offset:long,end_offset:long>>")
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([placed_leaves(t or "") for t in texts], dtype=object)

    return parse(text)
