"""Relevance, distributions and gates."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim


# Kinds of judged queries.
CATEGORIES = ("filename-path", "symbol-config", "error-message", "concept", "synonym", "mixed")

JUDGMENTS = """version int, name string, corpus string, judgments array<struct<id:string,query:string,expectedFiles:array<string>,category:string,
rationale:string,relevantSections:map<string,array<string>>>>"""


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, category, rationale, item and sections (may be null) of judgment files (JSON), a row an expected file.

    ValueError names the files or judgments that are incomplete, repeat an id or name sections of files that are not expected.
    """
    sets = spark.read.schema(JUDGMENTS).option("multiLine", True).json(path)
    blank = lambda c: c.isNull() | (js_trim(c) == "")
    strings = lambda c: c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: ~blank(x))
    whole = (F.col("version") == 1) & ~blank(F.col("name")) & ~blank(F.col("corpus")) & (F.size("judgments") > 0)
    refused = sets.where(~F.coalesce(whole, F.lit(False))).limit(1).count()
    if refused or sets.isEmpty():
        raise ValueError("a judgment set is incomplete or of another version")
    each = sets.select(F.inline("judgments"))
    sections = F.col("relevantSections")
    placed = F.forall(F.map_entries(sections), lambda e: strings(e["value"]) & F.array_contains("expectedFiles", e["key"]))
    good = ~blank(F.col("id")) & ~blank(F.col("query")) & ~blank(F.col("rationale")) & strings(F.col("expectedFiles")) & F.col("category").isin(*CATEGORIES) & (sections.isNull() | placed)
    judged = each.groupBy("id").agg(F.count("*").alias("n"), F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good"))
    wrong = [r.id for r in judged.where("n > 1 or good = 0").orderBy("id").limit(10).collect()]
    if wrong:
        raise ValueError(f"judgments that are invalid or repeat an id: {wrong}")
    return each.select(F.col("id").alias("query_id"), "query", "category", "rationale", F.explode(F.array_distinct("expectedFiles")).alias("item"), sections.alias("sections")).withColumn("sections", F.try_element_at("sections", F.col("item")))


def remaining_ms(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """Milliseconds left if the rest goes as fast as what is done; null before the first and after the last."""
    return F.when((done > 0) & (done < total), F.floor(F.greatest(elapsed_ms, F.lit(0)) / done * (total - done) + 0.5))


def query_metrics(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, recall_5, recall_10, reciprocal_rank, distinct_ratio from expected (query_id, item) and ranked (query_id, item, rank)."""
    wanted = expected.select("query_id", "item").distinct()
    hits = wanted.join(ranked.groupBy("query_id", "item").agg(F.min("rank").alias("rank")), ["query_id", "item"], "left")
    within = lambda k: F.count_distinct(F.when(F.col("rank") <= k, F.col("item"))) / F.count_distinct("item")
    found = hits.groupBy("query_id").agg(within(5).alias("recall_5"), within(10).alias("recall_10"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))
    shown = ranked.where("rank <= 10").groupBy("query_id").agg((F.count_distinct("item") / F.count("*")).alias("distinct_ratio"))
    return found.join(shown, "query_id", "left").withColumn("distinct_ratio", F.coalesce("distinct_ratio", F.lit(1.0)))


def summary(metrics: DataFrame) -> DataFrame:
    """Means over queries; 0 where there are none. With section_hit (see there), its mean over the queries that name sections."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(c)
    if "section_hit" in metrics.columns:
        metrics = metrics.withColumn("section_hit", F.col("section_hit").cast("double"))
        return metrics.agg(F.count("*").alias("queries"), *[mean(c) for c in ("recall_5", "recall_10", "reciprocal_rank", "distinct_ratio", "section_hit")])
    return metrics.agg(F.count("*").alias("queries"), *[mean(c) for c in ("recall_5", "recall_10", "reciprocal_rank", "distinct_ratio")])


def section_hit(excerpts: Column, sections: Column) -> Column:
    """Whether any excerpt's headings hold any of the sections, regardless of case; null if no sections are named."""
    hit = F.exists(excerpts, lambda e: F.exists(sections, lambda s: F.contains(F.lower(e), F.lower(s))))
    return F.when(F.size(sections) > 0, hit)


def distribution(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, extremes, mean and nearest-rank percentiles of finite values."""
    v = F.col(value)
    finite = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{round(p * 100)}")
    return finite.groupBy(*by).agg(F.count("*").alias("count"), F.min(v).alias("min"), F.round(F.avg(v), 6).alias("mean"), at(0.5), at(0.95), at(0.99), F.max(v).alias("max"))


@dataclass(frozen=True)
class Definition:
    """What a benchmark asks, and how often."""

    queries: tuple[str, ...]
    warm_runs: int
    ignore: tuple[str, ...]
    cells_from: int

    @staticmethod
    def read(text: str) -> Definition:
        """From the JSON text of a definition file; ValueError, which says what is wrong, if it is none."""
        said = json.loads(text)
        if not isinstance(said, dict) or said.get("schemaVersion") != 1:
            raise ValueError("not a benchmark definition of version 1")
        texts = {k: said.get(k) for k in ("queries", "ignorePatterns")}
        counts = {"warmRuns": 10, "annThreshold": 1}
        wrong = [k for k, v in texts.items() if not isinstance(v, list) or not all(isinstance(x, str) and x.strip() for x in v)]
        wrong += [k for k, least in counts.items() if type(said.get(k)) is not int or said[k] < least]
        wrong += ["queries"] if texts["queries"] == [] else []
        if wrong:
            raise ValueError(f"missing or out of range: {', '.join(sorted(set(wrong)))}")
        return Definition(tuple(texts["queries"]), said["warmRuns"], tuple(texts["ignorePatterns"]), said["annThreshold"])


def upper_median(values: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The middle value of each group, of an even number the upper one."""
    order = Window.partitionBy(*by).orderBy(value)
    placed = values.where(F.col(value).isNotNull()).withColumn("__at", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    return placed.where(F.col("__at") == F.floor(F.col("__n") / 2)).select(*by, F.col(value).alias(name))


def warm_medians(samples: DataFrame, by: list[str], cold: int = 1) -> DataFrame:
    """Of each group the number of queries, the median of their medians and the 95th percentile of all runs that are warm.

    samples: columns of by, query_id, run (from 1) and ms; the first `cold` runs of a query are left out.
    """
    warm = samples.where(F.col("run") > cold)
    medians = upper_median(warm, [*by, "query_id"], "ms", "median")
    counts = medians.groupBy(*by).agg(F.count("*").alias("queries"))
    high = warm.groupBy(*by).agg(F.expr("percentile_disc(0.95) within group (order by ms)").alias("p95"))
    return counts.join(upper_median(medians, by, "median", "p50"), by).join(high, by)


#: Settings in which reports of two models may differ.
OF_MODEL = ("provider", "dimension")


def incomparable(one: dict[str, object], other: dict[str, object]) -> list[str]:
    """Names of the settings, other than the model's own, in which two benchmark reports differ: with any, figures don't compare."""
    return sorted(k for k in one.keys() | other.keys() if k not in OF_MODEL and one.get(k) != other.get(k))


def report_lines(figures: DataFrame, key: str) -> DataFrame:
    """A table in Markdown, a line a row of `line` (from 0): a column for each of figures, rows by key."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\\\|")), F.lit("-"))
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    order = Window.orderBy(key)  # a report's rows: models or queries of a benchmark
    body = figures.select((F.row_number().over(order) + 1).alias("line"), row([cell(c) for c in figures.columns]).alias("text"))
    head = figures.sparkSession.createDataFrame([(0, f"| {' | '.join(figures.columns)} |"), (1, f"|{' --- |' * len(figures.columns)}")], "line int, text string")
    return head.unionByName(body)


def write_report(figures: DataFrame, key: str, path: str) -> None:
    """The table as one text file below path."""
    report_lines(figures, key).repartitionByRange(1, "line").sortWithinPartitions("line").select("text").write.text(path)


def gate_failures(least: dict[str, float], most: dict[str, float]) -> Column:
    """All thresholds that a row of figures misses, as text, sorted by name."""
    low = [F.when(F.col(c) < t, F.lit(f"{c} below {t}")) for c, t in least.items()]
    high = [F.when(F.col(c) > t, F.lit(f"{c} above {t}")) for c, t in most.items()]
    return F.array_sort(F.array_compact(F.array(*low, *high)))


def preferred(small: str, large: str, fixed_misses: Column, gain: float = 0.05) -> Column:
    """`base` if the large model's recall is higher by `gain` or it fixes an important miss; else `small`."""
    return F.when((F.round(F.col(large) - F.col(small), 9) >= gain) | (fixed_misses > 0), "base").otherwise("small")


def corpus_report(files: DataFrame) -> DataFrame:
    """part, name, files and bytes: of a listing (format, read_status, last_error, size) as a whole, by status, by the formats of
    files that could be read, and by the reasons of those that failed.

    Failed are files that are unreadable, unsafe or malformed; their reason is last_error, or the status where that is null.
    All parts come from one pass; a null status counts as `unknown`.
    """
    status = F.coalesce("read_status", F.lit("unknown"))
    reason = F.when(status.isin("unreadable", "unsafe", "malformed"), F.coalesce("last_error", status))
    named = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("name"))
    parts = F.array(named("all", F.lit("files")), named("status", status), named("format", F.when(status == "ready", F.coalesce("format", F.lit("unknown")))), named("failure", reason))
    counted = files.groupBy("format", "read_status", "last_error").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return counted.select("files", "bytes", F.inline(F.filter(parts, lambda p: p["name"].isNotNull()))).groupBy("part", "name").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
