"""Running totals within groups of any size, without gathering a group in one task."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KEY_BITS = 60


def spread_key(*columns) -> F.Column:
    """A number of 60 bits, evenly spread, that depends on the columns alone (null as empty)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def running_totals(rows: DataFrame, groups: list[str], key: str, value: str, out: str, count: int, ties: tuple[str, ...] = (), leaf_rows: int = 64) -> DataFrame:
    """rows with `out`: the sum of `value` over the rows before it in its group, by `key` (from spread_key) and ties.

    The key's leading bits cut each group into leaves of about `leaf_rows` of the `count` rows. Leaf sums are added up in two
    levels, and only a leaf's own rows are summed in order, so no task sees more than a leaf's rows or the square root of the
    number of leaves at once. One shuffle of the rows. Groups may be null. Rows equal in key and ties follow in any order.
    """
    bits = min(40, max(0, ceil(log2(max(1, count / leaf_rows)))))
    half = bits // 2
    leafed = rows.withColumn("__leaf", F.shiftright(F.col(key), KEY_BITS - bits)).withColumns({f"__g{k}": F.coalesce(F.xxhash64(F.col(g)), F.lit(0)) for k, g in enumerate(groups)})
    by = [f"__g{k}" for k in range(len(groups))]
    before = (Window.unboundedPreceding, -1)
    leaves = leafed.groupBy(*by, "__leaf").agg(F.sum(value).alias("__sum")).withColumn("__twig", F.shiftright("__leaf", half))
    twigs = leaves.groupBy(*by, "__twig").agg(F.sum("__sum").alias("__sum"))
    twigs = twigs.select(*by, "__twig", F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__twig").rowsBetween(*before)), F.lit(0)).alias("__twig_base"))
    leaves = leaves.withColumn("__leaf_base", F.coalesce(F.sum("__sum").over(Window.partitionBy(*by, "__twig").orderBy("__leaf").rowsBetween(*before)), F.lit(0)))
    bases = leaves.join(twigs, [*by, "__twig"]).select(*by, "__leaf", (F.col("__leaf_base") + F.col("__twig_base")).alias("__base"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "__leaf").orderBy(key, *ties).rowsBetween(*before)), F.lit(0))
    summed = leafed.withColumn("__own", own).join(bases, [*by, "__leaf"])
    return summed.withColumn(out, F.col("__own") + F.col("__base")).drop("__leaf", "__own", "__base", *by)


def in_order(rows: DataFrame, order: list[Column], place: str, sums: dict[str, str] | None = None) -> DataFrame:
    """rows with `place` (from 0) in the whole order, and for each column of sums the sum over the rows before, by its new name.

    Ranges of the order are numbered each by itself, and added up over one row a range. Rows that are equal in the order meet in
    one range.
    """
    sums = sums or {}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__sum_{c}") for c in sums])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__base{c}") for c in ("__n", *[f"__sum_{c}" for c in sums])])
    own = Window.partitionBy("__range").orderBy(*order)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    found = ranges.join(F.broadcast(bases), "__range").withColumn(place, F.col("__base__n") + F.row_number().over(own) - 1)
    found = found.withColumns({new: F.col(f"__base__sum_{c}") + F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c, new in sums.items()})
    return found.select(*rows.columns, place, *sums.values())
