"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight at time t of training (0 to 1) is its share times 1 + slope * (2t - 1): later sources by name gain, earlier
ones lose, and all add up to 1 at every t. The integral of that schedule is the source's cumulative demand for words; inverting
it at a document's place in its source's stream says when in training the document is due. Documents are sorted by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written
from .prefix import in_order, running_totals, spread_key

WEIGHTS = (5, 2, 1)
PASSES = 3
RAMP = 0.5
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, ramp: float = RAMP) -> DataFrame:
    """source, source_size, target, quota (whole words) and slope, from source and source_size.

    Sources by code point, null last, weigh `weights` in turn. A level is poured over them: target = least(passes * size,
    level * weight), with the level at which targets add up to all words. Sources may be as many as hosts: they are numbered and
    added up by ranges, and only sums over all come in one row.
    """
    weight = F.array(*[F.lit(w) for w in weights])
    named = in_order(sizes, [F.col("source").asc_nulls_last()], "at").withColumn("weight", F.get(weight, F.pmod("at", F.lit(len(weights)))))
    named = named.withColumn("cap", passes * F.col("source_size")).withColumn("full_at", F.col("cap").cast("double") / F.col("weight"))
    filled = in_order(named, [F.col("full_at"), F.col("at")], "turn", {"cap": "earlier", "weight": "closed_weight"})
    whole = filled.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"), F.count("*").alias("n"))
    level = (F.col("all_size") - F.col("earlier")).cast("double") / (F.col("all_weight") - F.col("closed_weight"))
    poured = filled.crossJoin(F.broadcast(whole)).withColumn("level", level)
    poured = written(poured.drop("level").crossJoin(F.broadcast(poured.agg(F.max("level").alias("level")))), "levels")  # one row
    poured = poured.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    poured = poured.withColumn("quota", F.least("cap", F.floor(F.col("target") + 0.5)))
    sums = poured.agg(F.sum("quota").alias("all_quota"), F.sum(F.col("quota") * F.col("at")).alias("quota_at"))
    poured = poured.crossJoin(F.broadcast(sums))  # one row
    mean = F.col("quota_at").cast("double") / F.greatest("all_quota", F.lit(1))
    slope = ramp * (F.col("at") - mean) / F.greatest(F.col("n") - 1, F.lit(1))
    return poured.select("source", "source_size", "target", "quota", slope.alias("slope"), "all_quota")


def due(share: Column, slope: Column) -> Column:
    """The time at which a source has met this share of its demand: t + slope * (t * t - t) = share, solved for t."""
    rest = 1 - slope
    return 2 * share / (rest + F.sqrt(rest * rest + 4 * slope * share))


def _planned(docs: DataFrame, weights, passes, ramp, id_col, source_col, text_col) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("text_hash"))
    rows = written(rows.withColumn("key", spread_key("doc_id")), "sizes")
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    count = sizes.agg(F.sum("n")).first()[0] or 0
    placed = running_totals(rows, ["source"], "key", "size", "place", count, ("doc_id", "size", "text_hash"))
    targets = source_targets(sizes.select("source", "source_size"), weights, passes, ramp).withColumnRenamed("source", "name")
    joined = placed.join(targets, placed.source.eqNullSafe(targets["name"])).drop("name")
    exposures = F.expr(f"transform(sequence(0, {passes - 1}), p -> named_struct('pass', p, 'words', greatest(0L, least(size, quota - source_size * p - place)), 'share', (source_size * p + place) / cast(greatest(quota, 1L) as double)))")
    taken = joined.withColumn("exposures", F.filter(exposures, lambda x: x["words"] > 0))
    placed_at = lambda x: F.struct(x["pass"].alias("pass"), x["words"].alias("words"), (due(x["share"], F.col("slope")) * F.col("all_quota")).alias("position"))
    taken = taken.withColumn("exposures", F.transform("exposures", placed_at))
    total = F.aggregate("exposures", F.lit(0).cast("long"), lambda at, x: at + x["words"])
    return taken.withColumn("taken", total).withColumn("position", F.get("exposures", F.lit(0))["position"])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, ramp: float = RAMP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs, sorted by position: doc_id, size, source_size, target, taken, position, exposures.

    A source's stream is its documents in an order fixed by their ids, again and again up to `passes` times; the mix takes its
    first `target` words (to the nearest whole word), so at each source's end one document is taken in part. exposures: pass,
    words and training position (in words) of each time that a document is taken; position: the first one (null: not taken).

    A null text has size 0, a null source is a source of its own; size 0 takes nothing. Repeated rows are documents of their
    own. Reruns agree. Other columns of docs are ignored; an empty table gives an empty result. Sources may hold any part of
    the rows: places are found by running_totals, and only one row a source is joined to the documents.
    """
    planned = _planned(docs, weights, passes, ramp, id_col, source_col, text_col)
    return planned.select("doc_id", "size", "source_size", "target", "taken", "position", "exposures").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs as the mix has them: a row for each exposure, sorted by training position; what is not taken goes.

    Texts stay whole: the document in which a source's target falls is kept entire. Columns are those of docs.
    """
    plan = _planned(docs, options.get("weights", WEIGHTS), options.get("passes", PASSES), options.get("ramp", RAMP), id_col, source_col, text_col)
    copies = Window.partitionBy("__id", "__source", "__hash").orderBy("__hash")
    named = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__hash": F.xxhash64(text_col)}).withColumn("__copy", F.row_number().over(copies))
    same = Window.partitionBy("doc_id", "source", "text_hash").orderBy("place")
    plan = plan.withColumn("copy", F.row_number().over(same)).where(F.size("exposures") > 0).select("doc_id", "source", "text_hash", "copy", "exposures")
    plan = plan.toDF("__p_id", "__p_source", "__p_hash", "__p_copy", "__exposures")
    taken = named.alias("d").join(plan, F.expr("__id <=> __p_id and __source <=> __p_source and __hash = __p_hash and __copy = __p_copy"))
    return taken.withColumn("__x", F.explode("__exposures")).orderBy("__x.position").select(*[F.col(f"d.`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and what the curriculum makes of a document: how often it is shown and when (in words) at first."""
    planned = _planned(read_table(spark, sf_dir, "documents"), WEIGHTS, PASSES, RAMP, "doc_id", "source", "text")
    shown = planned.select("doc_id", "size", "source_size", "target", "taken", F.size("exposures").cast("long").alias("exposures"), F.round("position", 6).alias("position"))
    return shown.orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP4_SQL = r"""
with sized as (
  select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as k
  from documents),
placed as (
  select doc_id, source, size,
         coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as place
  from sized),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place_no from sized group by source),
weighed as (
  select *, case mod(place_no, 3) when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from sources),
levels as (
  select *, ((sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / weight, place_no rows between unbounded preceding and 1 preceding), 0))::double
             / sum(weight) over (order by cap::double / weight, place_no rows between current row and unbounded following)) as level
  from weighed),
targets as (
  select source, source_size, place_no, least(cap::double, max(level) over () * weight) as target, cap from levels),
quotas as (
  select *, least(cap, floor(target + 0.5)::bigint) as quota from targets),
sums as (
  select sum(quota)::bigint as all_quota, sum(quota * place_no)::bigint as quota_at, count(*) as n from quotas),
schedules as (
  select *, 0.5::double * (place_no - quota_at::double / greatest(all_quota, 1)) / greatest(n - 1, 1) as slope from quotas, sums),
shown as (
  select p.doc_id, p.size, q.source_size, q.target, slope, all_quota, p.place::double / greatest(q.quota, 1)::double as share,
         greatest(0, least(p.size, q.quota - p.place)) as w0, greatest(0, least(p.size, q.quota - q.source_size - p.place)) as w1,
         greatest(0, least(p.size, q.quota - 2 * q.source_size - p.place)) as w2
  from placed p join schedules q on p.source is not distinct from q.source)
select doc_id, size, source_size, target, (w0 + w1 + w2)::bigint as taken, ((w0 > 0)::int + (w1 > 0)::int + (w2 > 0)::int)::bigint as exposures,
       case when w0 > 0 then round(2 * share / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) * all_quota, 6) end as position
from shown
"""
