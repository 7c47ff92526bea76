"""How far each source's words stand from its language's other sources: an index built in memory blocks, merged by shard.

A task keeps the counts of its documents' terms in one block until that is full, then gives the block out as a run sorted by
term, cut into pages. Each hash shard merges the pages of all runs through a heap, which yields every term once with all its
counts. Pairs of sources then need only what their terms have in common: everything else follows from each source's own counts.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

#: What counts as a term: letters of A-Z in either case and everything beyond ASCII, here as bytes of UTF-8.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_SLICE = 1 << 20
SMOOTH, UNIT = 5, 1_000_000_000


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists for about a megabyte each, cut where no term is."""
    raw, at = text.encode().lower(), 0  # of bytes, lower() knows A-Z alone
    while at < len(raw):
        cut = _GAP.search(raw, at + _SLICE)
        end = cut.start() if cut else len(raw)
        yield TERM.findall(raw, at, end)
        at = end


_RUN = pa.schema([("shard", pa.int32()), ("first", pa.binary()), ("run", pa.int32()), ("terms", pa.list_(pa.binary())), ("groups", pa.list_(pa.int32())), ("uses", pa.list_(pa.int64())), ("documents", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string()))])


class Block:
    """Counts of terms by group (language, source) until they are given out as a run."""

    def __init__(self, shards: int, page: int = 4096):
        self.shards, self.page = shards, page
        self.held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.entries = 0

    def add(self, lang: str, source: str, text: str) -> None:
        uses, documents = self.held.setdefault((lang, source), (Counter(), Counter()))
        before = len(uses)
        seen: set[bytes] = set()
        for some in terms(text):
            uses.update(some)
            seen.update(some)
        documents.update(seen)
        self.entries += len(uses) - before

    def run(self, number: int) -> pa.RecordBatch:
        """The block's pages, by shard and term; the empty term marks each group, whether it has terms or not."""
        groups = sorted(self.held)
        terms, at, uses, documents = [b""] * len(groups), list(range(len(groups))), [0] * len(groups), [0] * len(groups)
        shard = [zlib.crc32(repr(group).encode()) % self.shards for group in groups]
        for k, group in enumerate(groups):
            counts, seen = self.held.pop(group)
            terms += counts
            at += [k] * len(counts)
            uses += counts.values()
            documents += map(seen.__getitem__, counts)
        shard = np.concatenate([np.array(shard, np.int32), np.fromiter(map(zlib.crc32, terms[len(groups) :]), np.int64, len(terms) - len(groups)) % self.shards])
        self.entries = 0
        flat = pa.table({"shard": pa.array(shard, pa.int32()), "term": pa.array(terms, pa.binary()), "group": pa.array(at, pa.int32()), "uses": pa.array(uses, pa.int64()), "documents": pa.array(documents, pa.int64())})
        flat = flat.take(pc.sort_indices(flat, [("shard", "ascending"), ("term", "ascending"), ("group", "ascending")])).combine_chunks()
        of = flat["shard"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
        starts = np.concatenate([np.arange(a, b, self.page) for a, b in zip(cuts, cuts[1:])] or [np.zeros(0, np.int64)])
        offsets = pa.array(np.append(starts, len(of)), pa.int32())
        column = lambda name: flat[name].chunk(0) if flat[name].num_chunks else flat[name].combine_chunks()
        own = [np.unique(part, return_inverse=True) for part in np.split(flat["group"].to_numpy(), starts[1:])] if len(starts) else []
        places = pa.array(np.concatenate([place for _, place in own] or [np.zeros(0, np.int64)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, values) for values in (column("term"), places, column("uses"), column("documents"))]
        first = flat["term"].take(pa.array(starts)).combine_chunks()
        names = [pa.array([[groups[k][side] for k in used.tolist()] for used, _ in own], pa.list_(pa.string())) for side in (0, 1)]
        arrays = [pa.array(of[starts], pa.int32()), first, pa.array([number] * len(starts), pa.int32()), *lists, *names]
        return pa.RecordBatch.from_arrays(arrays, schema=_RUN)


def merged(pages: Iterator[tuple], least: int = 0) -> Iterator[tuple[bytes, dict[tuple[str, str], list[int]]]]:
    """Each term in order with [uses, documents] by group, of pages sorted by their first term.

    A page is opened when the smallest term at hand reaches its first one; only pages that overlap are held at once. Terms in
    fewer than `least` documents are passed over; marks of groups are not.
    """
    heap: list[tuple] = []
    waiting, count, term, held, total = next(pages, None), 0, None, [], 0

    def summed() -> dict[tuple[str, str], list[int]]:
        sums: dict[tuple[str, str], list[int]] = {}
        for k, n, d, names in held:
            own = sums.setdefault(names[k], [0, 0])
            own[0] += n
            own[1] += d
        return sums

    while heap or waiting is not None:
        while waiting is not None and (not heap or waiting[0] <= heap[0][0]):
            _, names, own, groups, uses, documents = waiting
            entries = zip(own, repeat(count), groups, uses, documents, repeat(names))
            entry = next(entries)
            heapq.heappush(heap, (*entry, entries))
            waiting, count = next(pages, None), count + 1
        at, _, k, n, d, names, entries = heap[0]
        if at != term:
            if term is not None and (total >= least or not term):
                yield term, summed()
            term, held, total = at, [], 0
        held.append((k, n, d, names))
        total += d
        following = next(entries, None)
        if following is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (*following, entries))
    if term is not None and (total >= least or not term):
        yield term, summed()


def by_shard(pages: Iterator[tuple]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Consecutive pages of one shard together."""
    for shard, own in groupby(pages, key=lambda page: page[0]):
        yield shard, (page for _, page in own)


def frequencies(docs: DataFrame, columns: tuple[str, str, str], least: int, capacity: int, tasks: int) -> DataFrame:
    """(lang, source, term, uses): of each group its kept terms, of each language (source null) theirs, and of each group one
    row without a term. columns: those of language, source and text. A merging task has several shards, one after the other."""
    lang_col, source_col, text_col = columns
    shards = 4 * tasks
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(shards), 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
                block.add(lang, source, text.as_py())
                if block.entries >= capacity:
                    yield block.run(number)
                    number += 1
        yield block.run(number)

    schema = "shard int, first binary, run int, terms array<binary>, groups array<int>, uses array<long>, documents array<long>, langs array<string>, sources array<string>"
    spilled = rows.mapInArrow(runs, schema).repartition(tasks, "shard").sortWithinPartitions("shard", "first")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pages() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    yield row.shard, (row.first, list(zip(row.langs, row.sources)), row.terms, row.groups.tolist(), row.uses.tolist(), row.documents.tolist())

        out: list[tuple] = []
        for _, own in by_shard(pages()):
            for term, groups in merged(own, least):
                if term:
                    of_lang: dict[str, list[int]] = {}
                    for (lang, _), (n, d) in groups.items():
                        sums = of_lang.setdefault(lang, [0, 0])
                        sums[0] += n
                        sums[1] += d
                    kept = {lang for lang, (_, d) in of_lang.items() if d >= least}
                    name = term.decode()
                    out += [(lang, None, name, of_lang[lang][0]) for lang in kept]
                    out += [(lang, source, name, n) for (lang, source), (n, _) in groups.items() if lang in kept]
                else:
                    out += [(lang, source, None, 0) for lang, source in groups]
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=["lang", "source", "term", "uses"])
                    out = []
        yield pd.DataFrame(out, columns=["lang", "source", "term", "uses"])

    return spilled.mapInPandas(merge, "lang string, source string, term string, uses long")


def share(uses: str) -> F.Column:
    """1 + floor(UNIT * (uses + SMOOTH) / whole), exactly; uses and whole are columns of the rows."""
    return F.expr(f"1L + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({uses} + {SMOOTH} AS DECIMAL(20, 0))) div CAST(whole AS DECIMAL(20, 0))")


def corrections(held: DataFrame, flush: int = 1 << 20) -> DataFrame:
    """(lang, a, b, amount) for sources a < b of a language: what their common terms change, as partial sums.

    held: (lang, term, source, p, rest): a term's share in each source that has it, and the share of terms that a source lacks.
    A stream of terms in order: the sources of a term are together, pairs add up in arrays until there are `flush` of them. A
    task holds a batch and the sources of one term.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[tuple[str, str], int] = {}
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def given() -> pd.DataFrame:
            said = list(names)
            rows = [(said[key >> 32][0], *sorted((said[key >> 32][1], said[key & 0xFFFFFFFF][1])), amount) for key, amount in zip(keys.tolist(), sums.tolist())]
            return pd.DataFrame(rows, columns=["lang", "a", "b", "amount"])

        def changes(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(pair, amount) of the sources that are d places apart in their term, for every d."""
            ids = np.array([names.setdefault(name, len(names)) for name in zip(part["lang"], part["source"])], np.int64)
            p, rest, term = part["p"].to_numpy(), part["rest"].to_numpy(), part["__term"].to_numpy()
            for d in range(1, len(ids)):
                at = np.flatnonzero(term[d:] == term[:-d])
                if not len(at):
                    return
                p1, p2, r1, r2 = p[at], p[at + d], rest[at], rest[at + d]
                a, b = np.minimum(ids[at], ids[at + d]), np.maximum(ids[at], ids[at + d])
                yield (a << 32) | b, np.abs(p1 - p2) - np.abs(p1 - r2) - np.abs(r1 - p2) + np.abs(r1 - r2)

        left: pd.DataFrame | None = None
        for batch in chain(batches, [None]):
            part = left if batch is None else batch if left is None else pd.concat([left, batch], ignore_index=True)
            if part is None or not len(part):
                continue
            new = (part["lang"] != part["lang"].shift()) | (part["term"] != part["term"].shift())
            part["__term"] = new.cumsum()
            last = part["__term"].iloc[-1] if batch is not None else -1  # the last term may go on in the next batch
            left = part[part["__term"] == last]
            for more, amounts in changes(part[part["__term"] != last]):
                keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
                both = np.concatenate([sums, amounts])
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, place, both)
                if len(keys) >= flush:
                    yield given()
                    keys, sums = keys[:0], sums[:0]
        yield given()

    dealt = held.select("lang", "term", "source", "p", "rest").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInPandas(stream, "lang string, a string, b string, amount long")


def source_divergence(docs: DataFrame, least: int = 30, best: int = 50, capacity: int = 600_000, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how each source of a language differs from its others and from the whole.

    Null languages, sources and texts count as ''. Terms are matches of TERM with A-Z lower-cased; a language keeps those in at
    least `least` of its documents. With V kept terms, of which a group has N uses, a term used c times has the share
    p = 1 + floor(1e9 * (c + 5) / (N + 5 V)). Part `pair` has a row for each other source of the language: the sum of
    |p - its p| over all kept terms (0 if there are none), every rank. Part `term` has the terms that the source uses and whose
    share there exceeds the language's, by the difference, up to rank `best`. Ranks go by value, then by item.

    All documents and whole texts count; sums are integers and exact. Repeated rows count each; a table without rows gives
    none; other columns are ignored. A task holds a block of at most `capacity` terms of groups (and the terms of one document
    more), a shard's task the pages that overlap, a pair task `flush` pairs. Pairs of sources are as many as the result has.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(frequencies(docs, (lang_col, source_col, text_col), least, capacity, tasks), "frequencies")
    kept = found.where("term IS NOT NULL")
    of_lang = kept.where("source IS NULL")
    sizes = of_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("uses").alias("lang_uses"))
    uses = kept.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("uses").alias("uses"), F.count("*").alias("own_terms"))
    groups = found.where("term IS NULL").select("lang", "source").distinct()
    groups = groups.join(uses, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["uses", "own_terms", "v", "lang_uses"])
    groups = groups.withColumn("whole", F.col("uses") + SMOOTH * F.col("v")).withColumn("lang_whole", F.col("lang_uses") + SMOOTH * F.col("v"))
    rest = F.when(F.col("v") > 0, share("0L")).otherwise(0)
    groups = written(groups.withColumn("rest", rest), "groups").withColumnRenamed("uses", "group_uses")

    facts = groups.select("lang", "source", "whole", "lang_whole", "rest")
    held = kept.where("source IS NOT NULL").join(facts, ["lang", "source"]).withColumn("p", share("uses"))
    changed = corrections(held).groupBy("lang", "a", "b").agg(F.sum("amount").alias("amount"))

    # for sources g and h: the sum over g's own terms of |p - h's rest| - |g's rest - h's rest|, by running sums over g's shares
    own = held.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("rest").alias("item_rest"))
    pairs = groups.select("lang", "source", "rest", "own_terms", "v").join(others, "lang").where("source <> item")
    events = own.select("lang", "source", "p", "n", F.lit(None).cast("string").alias("item")).unionByName(pairs.select("lang", "source", F.col("item_rest").alias("p"), F.lit(0).cast("long").alias("n"), "item"))
    upward = Window.partitionBy("lang", "source").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("lang", "source")
    mass = F.col("n") * F.col("p")
    summed = events.withColumns({"n_low": F.sum("n").over(upward), "m_low": F.sum(mass).over(upward), "n_all": F.sum("n").over(whole), "m_all": F.sum(mass).over(whole)})
    # p of the row is the other's rest here
    apart = (F.col("m_all") - F.col("m_low")) - F.col("p") * (F.col("n_all") - F.col("n_low")) + F.col("p") * F.col("n_low") - F.col("m_low")
    one_way = summed.where("item IS NOT NULL").select("lang", "source", "item", apart.alias("apart"))
    based = pairs.join(one_way, ["lang", "source", "item"]).withColumn("amount", F.col("apart") - F.col("own_terms") * F.abs(F.col("rest") - F.col("item_rest")))
    based = based.select("lang", "source", "item", "amount", F.lit(0).cast("long").alias("flat")).unionByName(
        based.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "amount", (F.col("v") * F.abs(F.col("rest") - F.col("item_rest"))).alias("flat"))
    )
    both = changed.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "amount")
    every = based.unionByName(both.select("lang", "x.source", "x.item", "amount", F.lit(0).cast("long").alias("flat")))
    by_pair = every.groupBy("lang", "source", "item").agg(F.sum(F.col("amount") + F.col("flat")).alias("value"))

    of_whole = of_lang.select("lang", "term", F.col("uses").alias("all_uses"))
    over = held.join(of_whole, ["lang", "term"]).withColumn("whole", F.col("lang_whole")).withColumn("value", F.col("p") - share("all_uses"))
    by_term = over.where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [by_pair.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")), by_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).withColumn("part", F.lit("term"))]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
kept AS (SELECT lang, term, count(*) AS uses FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v, CAST(sum(uses) AS BIGINT) AS n FROM kept GROUP BY lang),
own AS (SELECT w.lang, w.source, w.term, count(*) AS uses FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
own_sizes AS (SELECT lang, source, CAST(sum(uses) AS BIGINT) AS n FROM own GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.uses, 0) AS uses,
    1 + (1000000000 * (coalesce(o.uses, 0) + 5)) // (coalesce(s.n, 0) + 5 * z.v) AS p,
    1 + (1000000000 * (k.uses + 5)) // (z.n + 5 * z.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes z ON g.lang = z.lang
  LEFT JOIN own_sizes s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN own o ON g.lang = o.lang AND g.source = o.source AND k.term = o.term
),
differing AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(d.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN differing d ON d.lang = g.lang AND d.source = g.source AND d.item = h.source
),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE uses > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 50
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))
