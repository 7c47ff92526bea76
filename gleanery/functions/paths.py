"""Paths below a root, in one spelling."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def composed(text: Column) -> Column:
    """text in Unicode NFC."""

    @F.pandas_udf("string")
    def nfc(column: pd.Series) -> pd.Series:
        return column.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))

    return nfc(text)


def normal_path(path: Column) -> Column:
    """A path below a root with slashes, without empty and dot parts, in Unicode NFC; null where none is left.

    Backslashes are slashes. A part `..` takes the part before it away; null for a path that leaves the root so, or that is
    absolute. A slash at the end stays away.
    """
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/", -1), lambda x: (x != "") & (x != "."))
    up = F.lit("..")
    # a part counts 1 and `..` takes one off: where the count falls below 0 the path has left the root
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("left"))
    shorter = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))

    def step(acc: Column, x: Column) -> Column:
        left = acc["left"] | ((x == up) & (F.size(acc["kept"]) == 0))
        kept = F.when(x == up, shorter(acc["kept"])).otherwise(F.array_append(acc["kept"], x))
        return F.struct(kept.alias("kept"), left.alias("left"))

    folded = F.aggregate(parts, start, step, lambda acc: F.when(~acc["left"] & (F.size(acc["kept"]) > 0), F.array_join(acc["kept"], "/")))
    plain = F.when(F.exists(parts, lambda x: x == up), folded).otherwise(F.when(F.size(parts) > 0, F.array_join(parts, "/")))
    return composed(F.when(~F.startswith(slashed, F.lit("/")) & ~slashed.rlike(r"^[A-Za-z]:/"), plain))
