"""Changes between snapshots, reuse of what is known, and rows replaced by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Compared one by one when contents agree.
METADATA = ("canonical_path", "format", "mime_family", "read_status", "index_status", "last_error", "size", "modified_at_ns", "changed_at_ns", "device_id", "inode")


def classify_changes(previous: DataFrame, current: DataFrame, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """file_id and change (added, deleted, content-changed, metadata-only, failed, unchanged) of two manifests.

    Both have file_id, read_status, content_hash and the metadata columns; a null never equals a value.
    """
    columns = list(dict.fromkeys(["read_status", "content_hash", *metadata]))
    pick = lambda df, side: df.select("file_id", F.lit(True).alias(f"{side}_here"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    both = pick(previous, "p").join(pick(current, "c"), "file_id", "full_outer")
    p = lambda c: F.col(f"p_{c}")
    c = lambda c: F.col(f"c_{c}")
    ready = c("read_status") == "ready"
    same_hash = p("content_hash").eqNullSafe(c("content_hash"))
    same_rest = F.lit(True)
    for name in metadata:
        same_rest = same_rest & p(name).eqNullSafe(c(name))
    change = (
        F.when(F.col("c_here").isNull(), "deleted")
        .when(F.col("p_here").isNull(), F.when(ready, "added").otherwise("failed"))
        .when(~p("read_status").eqNullSafe(c("read_status")), F.when(ready, "content-changed").otherwise("failed"))
        .when(~ready, F.when(same_hash & same_rest, "unchanged").otherwise("failed"))
        .when(~same_hash, "content-changed")
        .when(~same_rest, "metadata-only")
        .otherwise("unchanged")
    )
    return both.select("file_id", change.alias("change"))


def reuse_vectors(new: DataFrame, prior: DataFrame, keys: list[str], new_order: str, prior_order: str, carried: list[str]) -> DataFrame:
    """new with the carried columns of prior rows of equal keys, each prior row used once, in order; null where none is left."""
    number = lambda df, order: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    held = number(prior, prior_order).select(*keys, "__n", *carried)
    return number(new, new_order).join(held, [*keys, "__n"], "left").drop("__n")


def replaced(table: DataFrame, key: str, window: DataFrame, rows: DataFrame) -> DataFrame:
    """table with all rows of the window's keys replaced by `rows` (fewer, more or none)."""
    return table.join(window.select(key).distinct(), key, "left_anti").unionByName(rows)


def upserted(table: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    return replaced(table, key, rows, rows)


def deleted(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def latest(feed: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last event of each key, if it is not a deletion (op = 'delete')."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return feed.withColumn("__n", F.row_number().over(last)).where("__n = 1 and op != 'delete'").drop("__n")


def index_decision(stored: Column, compatible: Column, same_fingerprint: Column, ready: Column, status: Column) -> Column:
    """What indexing does with a file: skipped, failed, unchanged, metadata or content."""
    refused = status.isin("unsupported", "malformed")
    return F.when(~ready & refused, "skipped").when(~ready, "failed").when(stored & compatible & same_fingerprint, "unchanged").when(stored & compatible, "metadata").otherwise("content")


#: Settings that say how an index is described; where they alone differ, its tables stay as they are.
DESCRIBING = ("descriptor_version", "application_version")


def differences(stored: dict[str, object], wanted: dict[str, object]) -> list[str]:
    """Names of the settings in which a stored index differs from what is wanted, in the order of `wanted`."""
    return [name for name, value in wanted.items() if name not in stored or stored[name] != value]


def compatibility(stored: dict[str, object], wanted: dict[str, object]) -> tuple[str, list[str]]:
    """`rebuild`, `migrate` or `compatible`, and the settings that say so; `missing` where nothing is stored.

    Whatever an index was made from outweighs how it is described.
    """
    if not stored:
        return "missing", []
    differing = differences(stored, wanted)
    made = [name for name in differing if name not in DESCRIBING]
    return ("rebuild", made) if made else ("migrate", differing) if differing else ("compatible", [])


def reusable(identity: Column, vector: Column, wanted: str, dimension: int) -> Column:
    """Whether a stored vector can stand for a new one: made under the same identity, as long as it must be, of finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((identity == wanted) & (F.size(vector) == dimension) & finite, F.lit(False))
