"""Places in a normalized text and in the text it was made from, in UTF-16 code units.

Normalization changes the text only at line ends, so the map between the two is one number a line: where the line begins in
either. It is made by running totals over a file's lines, and places are looked up by sorting them among the lines.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept

_BREAK = r"\r\n|\r|\n"
# What a reader of the index is told about a text.
LINE_ENDINGS, REPLACED = "LINE_ENDINGS_NORMALIZED", "INVALID_UNICODE_REPLACED"


def units16(text: Column) -> Column:
    """The UTF-16 code units of a text: a character each, two beyond U+FFFF."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def decoded(content: Column) -> Column:
    """struct<text, replaced> of a file's bytes: UTF-16 where a byte-order mark says so, else UTF-8; the mark is no text.

    What is no character comes as U+FFFD, one for each broken sequence, and `replaced` tells that there was such.
    """
    head = F.hex(F.substring(content, 1, 3))
    marked = F.when(F.startswith(head, F.lit("FFFE")), "LE").when(F.startswith(head, F.lit("FEFF")), "BE")
    plain = F.when(head == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content).cast("string")
    wide = _wide(F.when(marked.isNotNull(), content))
    read = F.struct(F.make_valid_utf8(plain).alias("text"), (~F.is_valid_utf8(plain)).alias("replaced"))
    return F.when(marked.isNotNull(), wide).otherwise(read)


def _wide(content: Column) -> Column:
    """struct<text, replaced> of marked UTF-16 bytes (null: empty); Spark's own decoder refuses broken ones."""

    @F.pandas_udf("text string, replaced boolean")
    def read(contents: pd.Series) -> pd.DataFrame:
        said = [b"" if c is None else bytes(c) for c in contents]
        kinds = ["utf-16-le" if c[:2] == b"\xff\xfe" else "utf-16-be" for c in said]
        texts = [c[2:].decode(kind, "replace") for c, kind in zip(said, kinds)]
        return pd.DataFrame({"text": texts, "replaced": [t.encode(kind) != c[2:] for t, kind, c in zip(texts, kinds, said)]})

    return read(content)


def warnings(text: Column, replaced: Column | None = None) -> Column:
    """Codes of what normalization changes, or decoding has changed, in a text."""
    found = [F.when(replaced, F.lit(REPLACED))] if replaced is not None else []
    return F.array_compact(F.array(*found, F.when(F.contains(text, F.lit("\r")), F.lit(LINE_ENDINGS))))


def line_places(files: DataFrame) -> DataFrame:
    """file_id, line (from 1), text, start and end in the normalized text, origin in the text as it was. Every file has a line.

    files: file_id and text; a null text is empty. Line ends of any kind count one unit in the normalized text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    paired = F.arrays_zip(F.split(text, _BREAK, -1).alias("text"), F.regexp_extract_all(text, F.lit(_BREAK), F.lit(0)).alias("break"))
    rows = files.select("file_id", F.posexplode(paired).alias("line", "x")).select("file_id", (F.col("line") + 1).alias("line"), "x.text", "x.break")
    rows = rows.withColumn("size", units16(F.col("text")))
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("long")
    origin = F.coalesce(F.sum(F.col("size") + F.length("break")).over(before), F.lit(0)).cast("long")
    return rows.select("file_id", "line", "text", start.alias("start"), (start + F.col("size")).alias("end"), origin.alias("origin"))


def original_ranges(ranges: DataFrame, places: DataFrame) -> DataFrame:
    """ranges (file_id, start, end in the normalized text, other columns kept) with start_line, end_line and the places
    original_start and original_end in the text as it was.

    Starts before the text and ends behind it or before the start are taken as the nearest place within. A range that ends at
    the beginning of a line does not reach into it; ranges of files without lines are left out. Ranges and lines of a file are
    sorted together, none is compared with every other.
    """
    size = places.groupBy("file_id").agg(F.max("end").alias("__size"))
    numbered = ranges.join(size, "file_id").withColumn("__range", F.monotonically_increasing_id())
    low = F.least(F.greatest(F.col("start").cast("long"), F.lit(0)), F.col("__size"))
    numbered = kept(numbered, "ranges")  # their numbers stay as they are
    numbered = numbered.withColumn("__low", low).withColumn("__high", F.greatest(low, F.least(F.col("end").cast("long"), F.col("__size"))))
    none = lambda kind: F.lit(None).cast(kind)
    line_rows = places.select("file_id", F.col("start").alias("at"), F.lit(1).alias("turn"), "line", "start", "origin", none("long").alias("range"), none("int").alias("side"))
    ends = F.array(F.struct(F.col("__low").alias("at"), F.lit(2).alias("turn"), F.lit(0).alias("side")), F.struct(F.col("__high").alias("at"), F.lit(2).alias("turn"), F.lit(1).alias("side")), F.struct(F.col("__high").alias("at"), F.lit(0).alias("turn"), F.lit(2).alias("side")))
    asked = numbered.select("file_id", F.col("__range").alias("range"), F.explode(ends).alias("e"))
    asked = asked.select("file_id", "e.at", "e.turn", none("int").alias("line"), none("long").alias("start"), none("long").alias("origin"), "range", "e.side")
    order = Window.partitionBy("file_id").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(order)
    met = line_rows.unionByName(asked).select("file_id", "range", "side", "at", last("line").alias("in_line"), last("start").alias("line_start"), last("origin").alias("line_origin")).where("range is not null")
    place = F.col("line_origin") + F.col("at") - F.col("line_start")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, c))
    found = met.groupBy("range").agg(pick(0, F.col("in_line")).alias("start_line"), F.coalesce(pick(2, F.col("in_line")), F.lit(1)).alias("end_line"), pick(0, place).alias("original_start"), pick(1, place).alias("original_end"))
    return numbered.join(found.withColumnRenamed("range", "__range"), "__range").drop("__range", "__size", "__low", "__high")


_QUOTED = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`|//[^\n]*+|/\*.*?\*/"""


def _bare(text: Column) -> Column:
    """text without its strings and comments. (Java's patterns recurse at every escape of a string, and long ones break them.)"""

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: re.sub(_QUOTED, " ", x))

    return strip(text)


def unbalanced(files: DataFrame) -> DataFrame:
    """file_id of script files (file_id, text) whose brackets do not match or in which a string or comment stays open.

    Brackets outside strings and comments are rows with their depth; at each depth an opening one is followed by its own
    closing one, whatever lies deeper between them. Running totals and one sort, linear in the file but for that.
    """
    rows = files.select("file_id", _bare(F.coalesce("text", F.lit(""))).alias("bare"))
    loose = rows.where(F.col("bare").rlike(r"[\"'`]|/\*")).select("file_id")
    signs = rows.select("file_id", F.posexplode(F.split(F.regexp_replace("bare", r"[^()\[\]{}]", ""), "")).alias("at", "sign")).where("sign != ''")
    opens = F.col("sign").isin("(", "[", "{")
    by_file = Window.partitionBy("file_id").orderBy("at")
    depth = F.sum(F.when(opens, 1).otherwise(-1)).over(by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.when(opens, 0).otherwise(1)
    marked = signs.withColumn("opens", opens).withColumn("depth", depth)
    level = Window.partitionBy("file_id", "depth").orderBy("at")
    last = F.lag("sign").over(level)
    pairs = F.translate(last, "([{", ")]}")
    wrong = F.when(F.col("opens"), F.coalesce(F.lead("opens").over(level), F.lit(True))).otherwise(~F.coalesce((pairs == F.col("sign")) & last.isin("(", "[", "{"), F.lit(False)))
    return loose.unionByName(marked.withColumn("wrong", wrong).where("wrong").select("file_id")).distinct()
