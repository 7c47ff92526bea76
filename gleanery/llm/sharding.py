"""Sharding by balanced label propagation.

Documents of equal text are linked. Every document starts on a shard by hash; in each round the linked ones learn on which
shard most of their neighbours are and ask to move there, and a shard admits as many as its quota of rows leaves room for. Groups
that the rounds leave cut, or that do not fit where they are, are then packed whole, the largest first; at most one group a
shard that would have fitted into one is cut by this. Documents without links fill what remains, and a last step evens all
shards out to the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, remove, written
from .prefix import running_totals, spread_key

SHARDS = 24


def _room(counts: dict[int, int], quota: list[int]) -> dict[int, int]:
    return {s: max(0, q - counts.get(s, 0)) for s, q in enumerate(quota)}


def _lookup(values: dict[int, int] | list[int], shard) -> F.Column:
    """The number for a shard, of as many as there are shards."""
    listed = values if isinstance(values, list) else [values[s] for s in range(len(values))]
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in listed]), shard)


def _round(state: DataFrame, quota: list[int], count: int) -> tuple[DataFrame, int]:
    """Labels after one round, and how many documents moved. Shard counts alone come to the driver."""
    linked = state.where("linked")
    held = {r.label: r.n for r in linked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    room = _room(held, quota)
    spread = linked.groupBy("text_key", "label").agg(F.count("*").alias("n")).withColumn("room", _lookup(room, F.col("label"))).where("room > 0")
    # each group's fullest shards that have room, as many as could hold it all; most groups need one. A group has a row a shard.
    fullest = Window.partitionBy("text_key").orderBy(F.desc("n"), "label").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn("before", F.coalesce(F.sum(F.col("n") + F.col("room")).over(fullest), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("text_key")))
    wanted = spread.where("before < total").groupBy("text_key").agg(F.array_sort(F.collect_list("label")).alias("targets"))
    asked = linked.join(wanted, "text_key").where(~F.array_contains("targets", F.col("label")) & (_lookup(room, F.col("label")) > 0))
    asked = asked.withColumn("to", F.get("targets", F.pmod("key", F.size("targets")).cast("int"))).drop("targets")
    asked = running_totals(asked.withColumn("one", F.lit(1).cast("long")), ["to"], "key", "one", "turn", count, ("doc_id", "text_key"))
    moves = written(asked.where(F.col("turn") < _lookup(room, F.col("to"))).select("row", "to"), "moves")
    moved = moves.count()
    after = state.join(moves, "row", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    return after, moved


def _pack(sizes: dict[int, int], vacant: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int, int]]]:
    """Shards for groups (size: how many), the largest first; `vacant` is drawn down. Only groups that fit into no shard are cut.

    Whole groups: (size, first, end, shard) for the first-th to the last before the end-th of their size. Cut ones: (size, turn,
    first, end, shard) for rows of the turn-th. Each piece but a group's last fills a shard.
    """
    whole, cut = [], []
    for size in sorted(sizes, reverse=True):
        turn = 0
        for shard in range(len(vacant)):
            fit = min(sizes[size] - turn, vacant[shard] // size)
            if fit:
                whole.append((size, turn, turn + fit, shard))
                vacant[shard] -= fit * size
                turn += fit
        for turn in range(turn, sizes[size]):
            at = 0
            while at < size:
                holding = [s for s, v in enumerate(vacant) if v >= size - at]
                shard = min(holding, key=lambda s: vacant[s]) if holding else max(range(len(vacant)), key=lambda s: vacant[s])
                take = min(size - at, vacant[shard])
                cut.append((size, turn, at, at + take, shard))
                vacant[shard] -= take
                at += take
    return whole, cut


def _packed(state: DataFrame, quota: list[int], largest: int, count: int) -> DataFrame:
    """Labels under which linked documents keep to the quotas: large groups, then whole small ones that fit where they are, then the rest.

    A group has one row here. Group counts by size come to the driver (sizes differ, so there are at most sqrt(2 * count)), and
    as many ranges go back.
    """
    spark = state.sparkSession
    spread = state.where("linked").groupBy("text_key", "label").agg(F.count("*").alias("n"))
    groups = spread.groupBy("text_key").agg(F.sum("n").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    groups = groups.withColumns({"group_key": spread_key("text_key"), "one": F.lit(1).cast("long"), "kept": (F.col("n") <= largest) & (F.col("low") == F.col("high"))})
    vacant = list(quota)
    big = {r.n: r.many for r in groups.where(f"n > {largest}").groupBy("n").agg(F.count("*").alias("many")).collect()}
    whole, cut = _pack(big, vacant)
    # whole groups stay as far as there is room
    stay = running_totals(groups.where("kept"), ["low"], "group_key", "n", "before", count, ("text_key",))
    stay = stay.withColumn("kept", F.col("before") + F.col("n") <= _lookup(list(vacant), F.col("low"))).drop("before")
    groups = written(groups.where("not kept").unionByName(stay), "groups")
    for r in groups.where("kept").groupBy("low").agg(F.sum("n").alias("n")).collect():
        vacant[r.low] -= r.n
    small = {r.n: r.many for r in groups.where(f"not kept and n <= {largest}").groupBy("n").agg(F.count("*").alias("many")).collect()}
    for have, more in zip((whole, cut), _pack(small, vacant)):
        have += more
    ranges = spark.createDataFrame(whole + [(size, turn, turn + 1, -1) for size, turn in {c[:2] for c in cut}], "n long, first long, end long, to int")
    turned = running_totals(groups.where("not kept"), ["n"], "group_key", "one", "turn", count, ("text_key",))
    dealt = turned.join(F.broadcast(ranges), "n").where("turn >= first and turn < end").select("text_key", "n", "turn", "to")
    dealt = written(dealt, "dealt")
    plan = dealt.select("text_key", "to").unionByName(groups.where("kept").select("text_key", F.col("low").alias("to")))
    state = written(state.join(plan, "text_key", "left").withColumn("label", F.coalesce("to", "label")).drop("to"), "state")
    if not cut:
        return state
    pieces = spark.createDataFrame(cut, "n long, turn long, first long, end long, to int")
    pieces = F.broadcast(dealt.where("to < 0").drop("to").join(F.broadcast(pieces), ["n", "turn"]).select("text_key", "first", "end", "to"))  # each but a group's last fills a shard
    rows = running_totals(state.where("label < 0").withColumn("one", F.lit(1).cast("long")), ["text_key"], "key", "one", "place", count, ("doc_id", "row"))
    rows = rows.join(pieces, "text_key").where("place >= first and place < end").withColumn("label", F.col("to"))
    return written(state.where("label >= 0").unionByName(rows.select(*state.columns)), "state")


def cut_rows(state: DataFrame) -> int:
    """Linked rows that are not on the shard where most of their group is: the edges that the present shards cut, one a row."""
    spread = state.where("linked").groupBy("text_key", "label").agg(F.count("*").alias("n"))
    return spread.groupBy("text_key").agg((F.sum("n") - F.max("n")).alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def shard_documents(docs: DataFrame, shards: int = SHARDS, large_share: int = 8, id_col: str = "doc_id", text_col: str = "text", report: list[dict] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: counts of any two shards differ by one at most. Equal texts (null texts among themselves) share a shard
    as far as its quota lets them; a group larger than a shard fills several. size is the UTF-8 bytes of the text plus 8 (null:
    8, and the CRC-32 of nothing). slot counts each shard's rows from 0; grown_shard is null under this law. Null ids and
    repeated rows are rows like any other; other columns of docs are ignored. An empty table gives an empty result.

    Rounds go on until one cuts no fewer rows than the one before. Groups of any size ask for as many shards as they fill. What
    stays cut is packed when the rounds are over, groups of more than a `large_share`-th of a shard first, as they need the room,
    and they leave a shard that others fill. `report` gets the rows moved by each round and the rows
    cut before it, then the rows that packing and evening out leave cut.

    Groups of any size are met only as counts by shard; turns and slots come from running_totals. Each state is written to the
    shared folder, and removed once the next one is there.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("text_key"),
    )
    rows = written(rows.withColumn("key", spread_key("doc_id", "text_key")).withColumn("row", F.monotonically_increasing_id()), "rows")
    count = rows.count()
    quota = [count // shards + (s < count % shards) for s in range(shards)]
    groups = rows.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select("text_key", F.lit(True).alias("more"))
    start = F.pmod("key", F.lit(shards)).cast("int")
    state = written(rows.join(groups, "text_key", "left").select(*rows.columns, start.alias("label"), F.coalesce("more", F.lit(False)).alias("linked")), "state")
    largest, report, cut = max(1, quota[0] // large_share), [] if report is None else report, cut_rows(state)
    while cut:
        after, moved = _round(state, quota, count)
        after = written(after, "state")
        left = cut_rows(after)
        report.append({"moved": moved, "cut": cut})
        if not moved or left >= cut:
            remove(after)
            break
        remove(state)
        state, cut = after, left
    placed = _packed(state, quota, largest, count)
    remove(state)
    found = written(_evened(placed, quota, count), "sharded")
    remove(placed)
    report.append({"moved": 0, "cut": cut_rows(found.withColumn("label", F.col("shard")))})
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _evened(state: DataFrame, quota: list[int], count: int) -> DataFrame:
    """Slots, linked documents first; what a shard holds beyond its quota goes to the vacant slots of the others in turn."""
    counts: dict[int, int] = {}
    linked: dict[int, int] = {}
    for r in state.groupBy("label", "linked").agg(F.count("*").alias("n")).collect():
        counts[r.label] = counts.get(r.label, 0) + r.n
        if r.linked:
            linked[r.label] = r.n
    shards = range(len(quota))
    vacant = [max(0, quota[s] - counts.get(s, 0)) for s in shards]
    excess = [max(0, counts.get(s, 0) - quota[s]) for s in shards]
    excess_before = [sum(excess[:s]) for s in shards]
    vacant_before = [sum(vacant[:s]) for s in shards]
    ranked = running_totals(state.withColumn("one", F.lit(1).cast("long")), ["label", "linked"], "key", "one", "turn", count, ("doc_id", "row"))
    place = F.when(F.col("linked"), F.col("turn")).otherwise(F.col("turn") + _lookup([linked.get(s, 0) for s in shards], F.col("label")))
    ranked = ranked.withColumn("place", place).withColumn("over", F.col("place") - _lookup(quota, F.col("label")))
    number = F.col("over") + _lookup(excess_before, F.col("label"))
    # the last shard whose vacant slots begin at or before this number
    begins = F.array(*[F.lit(v).cast("long") for v in [b for s, b in enumerate(vacant_before) if vacant[s]] or [0]])
    hosts = F.array(*[F.lit(s) for s in [s for s in shards if vacant[s]] or [0]])
    host = F.get(hosts, F.size(F.filter(begins, lambda b: b <= number)) - 1)
    moved = ranked.withColumn("shard", F.when(F.col("over") < 0, F.col("label")).otherwise(host))
    slot = F.when(F.col("over") < 0, F.col("place")).otherwise(_lookup([counts.get(s, 0) for s in shards], F.col("shard")) + number - _lookup(vacant_before, F.col("shard")))
    return moved.withColumn("slot", slot)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
