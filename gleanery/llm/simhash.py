"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits in `blocks` blocks. Two that differ in at most `distance` bits agree on some blocks - distance of
them, so every choice of that many blocks is a join key and close pairs meet under at least one. Wide keys keep chance
meetings rare; keys that many fingerprints share (near copies of one text) are compared tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written
from .components import components

SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(end + 1 for end in ends[:-1])]
    hashed = xxhash.xxh64_digest
    spans = zip(starts, ends[shingle - 1 :]) if len(words) > shingle else [(0, len(line))]
    digests = b"".join([hashed(line[a:b], SEED) for a, b in spans])
    count = len(digests) // 8
    ones = np.zeros(64, np.int64)
    for k in range(0, count, 1 << 15):  # whole texts, but a bounded array of bits
        part = np.frombuffer(digests[8 * k : 8 * (k + (1 << 15))], np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > count).view(">i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(text if isinstance(text, str) else None, shingle) for text in texts], dtype="int64")

    return fingerprints(text)


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks (signed) of every choice of blocks - distance blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _tile_links(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what links within distance connect among a few thousand fingerprints: one per further member."""
    if len(prints) == 2:
        a, b = prints.tolist()
        return [(max(a, b), min(a, b))] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance else []
    prints = np.unique(prints)
    bits = prints.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance
    label = np.arange(len(prints))
    while True:
        lower = np.where(near, label[None, :], len(prints)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    far = np.flatnonzero(label != np.arange(len(prints)))
    return list(zip(prints[far].tolist(), prints[label[far]].tolist()))


def close_links(prints: DataFrame, distance: int = 3, blocks: int = 6, tile: int = 1024) -> DataFrame:
    """(a, b): links among the distinct fingerprints `fp` that connect all and only what pairs within distance connect.

    A key shared by n fingerprints is cut into n / tile parts by hash, and each pair of parts is compared by itself: no task
    sees a whole hot key, none emits its pairs, and no pair is missed.
    """
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(blocks, distance)])
    rows = prints.select("fp", F.posexplode(keys).alias("table", "key"))
    shared = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile).cast("int")
    members = rows.join(shared, ["table", "key"]).select("table", "key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"))
    tiled = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.groupBy("table", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def linked(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in _tile_links(np.asarray(x, np.int64), distance)] for x in lists], dtype=object)

    return tiled.select(F.explode(linked("fps")).alias("link")).select("link.*")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.

    Equal fingerprints are one class, compared once. Texts that are null, empty or blank have fingerprint 0 and link like any
    other. Repeated rows come out as often as they went in. Rows with a null id are compared too, but name no component: one
    of null ids only has a null component_id. Other columns of docs are ignored. An empty table gives an empty result.
    """
    prints = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    named = rooted_classes(prints, distance, blocks).select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def rooted_classes(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """fp, root (one fingerprint of the group) and component_id of every distinct fingerprint of prints (doc_id, fp)."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = components(close_links(classes.select("fp"), distance, blocks), "a", "b")
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, distance: int = 3, shingle: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: the one of smallest id, of equal ids the one of smallest text hash.

    Rows without an id cannot be named as the one to stay; of those in a group one stays besides.
    """
    text_hash = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null"))
    prints = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp"), text_hash.alias("text_hash")), "fingerprints")
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    firsts = prints.groupBy("fp", F.col("doc_id").isNull().alias("nameless")).agg(least)
    stay = firsts.join(rooted_classes(prints, distance, blocks), "fp").groupBy("root", "nameless").agg(F.min("least").alias("least"))
    stay = stay.select(F.col("least.doc_id").alias("__stay_id"), F.col("least.text_hash").alias("__stay_hash"))
    hashed = docs.withColumn("__hash", text_hash)
    kept = hashed.join(stay, F.col(id_col).eqNullSafe(F.col("__stay_id")) & (F.col("__hash") == F.col("__stay_hash")), "left_semi")
    return kept.dropDuplicates([id_col, "__hash"]).drop("__hash")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
