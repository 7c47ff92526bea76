"""The three ways a query finds chunks: vectors, BM25 (terms and phrases) and metadata. All take batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.text import match_kind, metadata_terms, quoted_phrases, stem, strength, terms, unquoted
from ..schema import bucket
from ..scratch import dealt, kept

SCORE_DIGITS = 6

#: Chunks whose metadata, and whose terms, one task compares; rows of a term, a query and a chunk that one task adds up.
CHUNKS_A_TASK = 20_000
TEXTS_A_TASK = 10_000
HITS_A_TASK = 2_000_000


def blocked(find: Callable[[DataFrame], DataFrame], queries: DataFrame, most: int) -> DataFrame:
    """What `find` finds for all queries, asked in blocks (by a hash of query_id) of at most `most`. Queries are computed once."""
    queries = kept(queries, "queries")
    parts = max(1, ceil(queries.count() / most))
    while True:
        of = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        counts = {r.block: r.n for r in queries.groupBy(of.alias("block")).agg(F.count("*").alias("n")).collect()} if parts > 1 else {0: 0}
        if max(counts.values(), default=0) <= most or len(counts) < parts // 4:  # rows of one id stay together
            break
        parts += ceil(parts / 4)
    if parts == 1:
        return find(queries)
    return reduce(DataFrame.unionByName, [find(queries.where(of == block)) for block in sorted(counts)] or [find(queries)])


def top(pool: DataFrame, k: int, *, score: str = "raw_score", item: str = "chunk_id") -> DataFrame:
    """The k best of each query, numbered; equal scores by item."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), item)
    return pool.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def committed(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of files that are indexed with the content that the chunks were made from."""
    ready = files.where((F.col("index_status") == "indexed") & (F.col("extraction_status") == "extracted"))
    ready = ready.select("file_id", F.col("content_hash").alias("file_content_hash"))
    return chunks.join(ready, ["file_id", "file_content_hash"], "left_semi")


def vector_pool(chunks: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, chunk_id, raw_score, rank: the nearest chunks (chunk_id, vector) of each query (query_id, query_vector) by cosine.

    A block of queries is one matrix, sent to all tasks; each keeps its best, so what is shuffled does not grow with the chunks
    of a task. Vectors of another length, zero or not finite find nothing. If queries have formats, only chunks of those count.
    """
    return blocked(lambda some: _vector_block(chunks, some, config), queries, config.max_batch)


def _vector_block(chunks: DataFrame, queries: DataFrame, config: SearchConfig) -> DataFrame:
    asked = [r.asDict() for r in queries.collect()]
    wanted = np.array([np.asarray(r["query_vector"], np.float64) for r in asked]).reshape(len(asked), -1)
    wanted = wanted / np.linalg.norm(wanted, axis=1, keepdims=True) if len(asked) else wanted
    return scanned(chunks, dict(queries.dtypes)["query_id"], asked, wanted, config)


def scanned(chunks: DataFrame, kind: str, asked: list[dict], wanted: np.ndarray, config: SearchConfig, looks: np.ndarray | None = None) -> DataFrame:
    """The nearest chunks of a block of queries: their rows (query_id of SQL type `kind`, formats if wanted) and unit vectors.

    looks: which query looks into which cell (the last column: chunks without one); without it, every query meets every chunk.
    """
    ids = np.array([r["query_id"] for r in asked])
    formats = [frozenset(r.get("formats") or ()) for r in asked]
    columns = ["chunk_id", "vector", *(["format"] if any(formats) else []), *(["cell"] if looks is not None else [])]
    k, far = config.vector_candidates, config.max_distance

    def near(batch: pd.DataFrame, some: np.ndarray) -> pd.DataFrame:
        """What of a batch the queries numbered `some` find."""
        vectors = np.stack(batch["vector"].to_list()).astype(np.float64)
        scores = wanted[some] @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
        if any(formats):
            kinds, kind_at = np.unique(batch["format"].astype(str), return_inverse=True)
            scores[~np.array([[not formats[q] or x in formats[q] for x in kinds] for q in some])[:, kind_at]] = -np.inf
        close, scores = 1 - scores < far, scores.round(SCORE_DIGITS)
        if len(batch) > k:  # no more than the k best and their equals are sorted
            close &= scores >= np.partition(np.where(close, scores, -np.inf), -k, axis=1)[:, -k, None]
        q, c = np.nonzero(close)
        return pd.DataFrame({"query_id": ids[some[q]], "chunk_id": batch["chunk_id"].to_numpy()[c], "raw_score": scores[q, c]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            batch = batch[[v is not None and len(v) == wanted.shape[1] and bool(np.isfinite(v).all() and np.any(v)) for v in batch["vector"]]]
            if not len(batch) or not len(ids):
                continue
            parts = [(batch, np.arange(len(ids)))] if looks is None else [(own, np.flatnonzero(looks[:, cell])) for cell, own in batch.groupby("cell")]
            found = [near(own, some) for own, some in parts if len(some)]
            best = pd.concat([x for x in (best, *found) if x is not None]) if found else best
            best = best if best is None else best.sort_values(["query_id", "raw_score", "chunk_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    schema = f"query_id {kind}, chunk_id {dict(chunks.dtypes)['chunk_id']}, raw_score double"
    return top(chunks.select(*columns).mapInPandas(scan, schema), k)


def postings(chunks: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """unit, chunk_id, positions, length: where each term of a chunk stands (from 0), and how many terms the chunk has.

    With units (unit), of those terms alone: the others are left out before anything is shuffled.
    """
    listed = chunks.select("chunk_id", terms(F.coalesce(F.col("search_text"), F.lit(""))).alias("terms"))
    held = listed.select("chunk_id", F.size("terms").alias("length"), F.posexplode("terms").alias("at", "unit"))
    held = held if units is None else held.join(units.select("unit").distinct(), "unit", "left_semi")
    return held.groupBy("unit", "chunk_id", "length").agg(F.array_sort(F.collect_list("at")).alias("positions"))


def lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id and the number of its terms, chunks without any included."""
    return chunks.select("chunk_id", F.size(terms(F.coalesce(F.col("search_text"), F.lit("")))).alias("length"))


#: Up to so many different terms of a search are a filter of the scan; more are a join.
TERMS_IN_FILTER = 4096


@dataclass(frozen=True)
class TextIndex:
    """Postings of a corpus and the one row of its size (n, mean): what BM25 reads instead of texts.

    foldered: postings have `bucket`, the folder in which an index keeps a term (see schema.bucket).
    """

    postings: DataFrame
    sizes: DataFrame
    foldered: bool = False

    @staticmethod
    def of(chunks: DataFrame, asked: DataFrame, column: str = "query") -> TextIndex:
        """Of chunks without a stored index, for the terms in a column of asked. The texts are read once.

        A chunk's length stands in a posting of the empty term, which no text has.
        """
        length_of = asked.sparkSession.range(1).select(F.lit("").alias("unit"))
        units = kept(asked.select(F.explode(terms(F.col(column))).alias("unit")).unionByName(length_of).distinct(), "units")
        listed = chunks.select("chunk_id", terms(F.coalesce(F.col("search_text"), F.lit(""))).alias("terms"))
        listed = listed.select("chunk_id", F.size("terms").alias("length"), F.concat(F.array(F.lit("")), "terms").alias("terms"))
        held = listed.select("chunk_id", "length", F.posexplode("terms").alias("at", "unit")).join(units, "unit", "left_semi")
        held = dealt(held, "chunk_id", chunks.select("chunk_id"), TEXTS_A_TASK)  # what is sorted is a part's, not a split's
        rows = kept(held.groupBy("unit", "chunk_id", "length").agg(F.array_sort(F.collect_list(F.col("at") - 1)).alias("positions")), "postings")
        return TextIndex.stored(rows.where("unit != ''"), rows.where("unit = ''").select("chunk_id", "length"))

    @staticmethod
    def stored(postings: DataFrame, lengths: DataFrame, foldered: bool = False) -> TextIndex:
        return TextIndex(postings, lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")), foldered)

    def of_units(self, units: DataFrame) -> DataFrame:
        """The postings of terms (unit; each once). Few terms are looked up: folders and row groups without them are not read."""
        few = [r.unit for r in units.limit(TERMS_IN_FILTER + 1).collect()]
        if len(few) > TERMS_IN_FILTER:
            return self.postings.join(units, "unit", "left_semi")
        held = self.postings.where(F.col("unit").isin(few))
        if not self.foldered:
            return held
        places = units.sparkSession.createDataFrame([(u,) for u in few], "unit string").select(bucket(F.col("unit")).alias("b")).distinct()
        return held.where(F.col("bucket").isin([r.b for r in places.collect()]))


def _index(corpus: DataFrame | TextIndex, asked: DataFrame, column: str = "query") -> TextIndex:
    return corpus if isinstance(corpus, TextIndex) else TextIndex.of(corpus, asked, column)


def _scored(hits: DataFrame, df: DataFrame, sizes: DataFrame, config: SearchConfig) -> DataFrame:
    """BM25 of hits (query_id, unit, chunk_id, tf, length), added up by query and chunk; df: unit, df."""
    n, mean = F.col("n"), F.col("mean")
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    k1, b = config.bm25_k1, config.bm25_b
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    joined = hits.join(df, "unit").crossJoin(F.broadcast(sizes))  # one row
    return joined.groupBy("query_id", "chunk_id").agg(F.round(F.sum(idf * gain), SCORE_DIGITS).alias("raw_score"))


def match_scores(corpus: DataFrame | TextIndex, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, chunk_id, raw_score of every chunk that holds a term of the query (query_id, query).

    Any number of queries: postings of their terms meet them by term. Spark broadcasts what is small, as both sides' sizes are
    known when the join is planned.
    """
    index = _index(corpus, queries)
    asked = kept(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("unit")), "asked")
    held = index.of_units(kept(asked.select("unit").distinct(), "units"))
    counts = kept(held.groupBy("unit").agg(F.count("*").alias("df")), "document-counts")
    n_hits = counts.join(asked, "unit").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first().n
    found = held.select("unit", "chunk_id", "length", F.size("positions").alias("tf"))
    found = found.repartition(max(1, ceil(n_hits / HITS_A_TASK)), "chunk_id")  # a chunk's scores are added up where its postings are
    return _scored(found.join(asked, "unit"), counts, index.sizes, config)


def phrase_scores(corpus: DataFrame | TextIndex, phrases: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, chunk_id, raw_score of chunks that hold a phrase (query_id, phrase) as consecutive terms.

    Chunks that hold a phrase's rarest term are its candidates; there, the places where each of its terms would have the phrase
    begin are intersected. A phrase counts as one unit. Only postings of the phrases' terms are read.
    """
    index = _index(corpus, phrases, "phrase")
    listed = kept(phrases.select("query_id", F.array_join(terms(F.col("phrase")), " ").alias("phrase")).where("phrase != ''").distinct(), "phrases")
    parts = listed.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "unit"))
    held = index.of_units(kept(parts.select("unit").distinct(), "units"))
    known = parts.join(held.groupBy("unit").agg(F.count("*").alias("df")), "unit", "left")  # a phrase with a term that no chunk has is nowhere
    rare = known.groupBy("phrase").agg(F.min(F.when(F.col("df").isNull(), F.struct(F.lit(-1).cast("long").alias("df"), "offset", "unit")).otherwise(F.struct("df", "offset", "unit"))).alias("r"))
    rare = kept(rare.where("r.df >= 0").select("phrase", F.col("r.unit").alias("unit"), F.col("r.offset").alias("offset")), "rarest")
    begins = lambda: F.transform("positions", lambda p: p - F.col("offset"))
    first = held.join(rare, "unit").select("phrase", "chunk_id", "length", begins().alias("begins"), "offset")
    others = kept(parts.join(rare.select("phrase", F.col("offset").alias("rare")), "phrase").where("offset != rare").drop("rare"), "others")
    wanted = first.select("phrase", "chunk_id").join(others, "phrase")
    more = held.select("unit", "chunk_id", "positions").join(wanted, ["unit", "chunk_id"]).select("phrase", "chunk_id", F.lit(None).cast("int").alias("length"), begins().alias("begins"), "offset")
    met = first.unionByName(more).groupBy("phrase", "chunk_id").agg(F.max("length").alias("length"), F.collect_list("begins").alias("all"))
    met = met.withColumn("parts", F.size(F.split("phrase", " "))).where(F.size("all") == F.col("parts"))
    tf = F.size(F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), F.get("all", F.lit(0)), lambda at, x: F.array_intersect(at, x)))
    found = kept(met.select(F.col("phrase").alias("unit"), "chunk_id", "length", tf.alias("tf")).where("tf > 0"), "phrases-found")
    hits = found.join(listed.withColumnRenamed("phrase", "unit"), "unit")
    return _scored(hits, found.groupBy("unit").agg(F.count("*").alias("df")), index.sizes, config)


def bm25_scores(corpus: DataFrame | TextIndex, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Terms, or a phrase, or any of phrases and the other terms, as the query's quotes ask; scores add up."""
    index = _index(corpus, queries)
    asked = queries.select("query_id", quoted_phrases(F.col("query")).alias("phrases"), unquoted(F.col("query")).alias("rest"), "query")
    loose = asked.select("query_id", F.when(F.size("phrases") == 0, F.col("query")).otherwise(F.col("rest")).alias("query")).where("query != ''")
    matched = match_scores(index, loose, config)
    exact = asked.select("query_id", F.explode("phrases").alias("phrase"))
    if exact.isEmpty():  # no quotes, no phrases to look for
        return matched
    both = matched.unionByName(phrase_scores(index, exact, config))
    return both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("raw_score"), SCORE_DIGITS).alias("raw_score"))


def bm25_pool(corpus: DataFrame | TextIndex, queries: DataFrame, config: SearchConfig = SearchConfig(), formats: DataFrame | None = None) -> DataFrame:
    """The best chunks of each query. formats (chunk_id, format): chunks of formats that a query does not ask for are left out before."""
    scores = bm25_scores(corpus, queries, config)
    if formats is not None and "formats" in queries.columns:
        wanted = queries.select("query_id", "formats").where(F.size("formats") > 0)
        scores = scores.join(formats, "chunk_id").join(wanted, "query_id", "left")
        scores = only_formats(scores, F.col("formats"), F.col("format")).select("query_id", "chunk_id", "raw_score")
    return top(scores, config.bm25_candidates)


def _fuzzy_keys(text: str, lengths: str, shifts: int, most: int) -> Column:
    """`length:part:letters` of the parts that a term of each length is cut into, each taken at up to `shifts` places about its own.

    A term that is at most d edits from a word is cut into d + 1 parts; one of them stands in the word unchanged, at most d
    places off. text: a column's name; lengths: SQL for an array. One expression with lambdas: written out, it would be hundreds.
    """
    edits = f"IF(n <= 4, {min(1, most)}, {min(2, most)})"
    start, end = f"((n * part) DIV ({edits} + 1))", f"((n * (part + 1)) DIV ({edits} + 1))"
    inside = f"n >= 2 AND part <= {edits} AND abs(shift) <= {edits} AND {start} + shift >= 0 AND {end} + shift <= length({text})"
    key = f"CASE WHEN {inside} THEN concat_ws(':', n, part, substring({text}, CAST({start} + shift + 1 AS INT), CAST({end} - {start} AS INT))) END"
    nested = f"flatten(transform({lengths}, n -> flatten(transform(sequence(0, {min(2, most)}), part -> transform(sequence({-shifts}, {shifts}), shift -> {key})))))"
    return F.expr(f"array_distinct(filter({nested}, x -> x IS NOT NULL))")


def _grams(text: Column) -> Column:
    """All runs of two and of three letters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))
    return F.array_distinct(F.concat(F.transform(at, lambda k: F.substring(text, k, F.lit(2))), F.transform(at, lambda k: F.substring(text, k, F.lit(3)))))


def matching_values(values: DataFrame, asked: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """field, value, kind and the columns of asked (term among them) of every value that matches a term.

    Values meet terms by their first three letters (what holds a term holds those) and, for fuzzy matches, by parts of words;
    only pairs that meet are compared. Edits in characters are never more than those in bytes, so one kind of keys serves both.
    """
    most = config.fuzzy_max_distance
    v, t = F.lower("value"), F.lower("term")
    grams = values.select("field", "value", F.explode(_grams(v)).alias("key"))
    met = grams.join(asked.withColumn("key", F.substring(t, 1, 3)), "key").drop("key").where(F.contains(v, t))  # a pair meets once
    if most:
        words = values.select("field", "value", F.explode(F.array_distinct(F.filter(F.split(v, r"[^\p{L}\p{N}_@.\-]+"), lambda p: p != ""))).alias("word"))
        reach = min(2, most)
        keyed = words.select("word").distinct().withColumn("key", F.explode(_fuzzy_keys("word", f"transform(sequence({-reach}, {reach}), k -> length(word) + k)", reach, most)))
        sought = asked.withColumn("__low", t).withColumn("key", F.explode(_fuzzy_keys("__low", "array(length(__low))", 0, most))).drop("__low")
        near = keyed.join(sought, "key").drop("key").distinct().where(F.levenshtein(F.col("word"), t) <= reach)
        met = met.unionByName(words.join(near, "word").drop("word")).distinct()
    return met.withColumn("kind", match_kind(F.col("value"), F.col("term"), most, config.fuzzy_in_bytes)).where("kind is not null")


def metadata_matches(chunks: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The best match of each query and chunk: query_id, chunk_id, file_id, relative_path, field, kind, strength, term.

    Fields are tried in the order filename, its stem, path, headings, symbols; the strongest match wins, then the longer term,
    then the earlier one. Equal metadata is compared once, whatever number of chunks share it.
    """
    described = _described(chunks)
    kinds = _value_matches(described, queries, config)
    best = F.max_by(F.struct("field", "kind", "strength", "term"), F.struct("strength", F.length("term"), -F.col("term_at"), -F.col("field_at")))
    found = described.join(kinds, ["field", "value"]).groupBy("query_id", "chunk_id", "file_id", "relative_path").agg(best.alias("m"))
    return found.select("query_id", "chunk_id", "file_id", "relative_path", "m.*")


def _described(chunks: DataFrame, *more: str) -> DataFrame:
    """A row for each different entry of a chunk's metadata: field, value and its place among the chunk's entries."""
    entry = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    listed = lambda name, column: F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: entry(name, x))
    fixed = F.array(entry("filename", F.col("filename")), entry("filename", stem(F.col("filename"))), entry("path", F.col("relative_path")))
    fields = F.array_distinct(F.concat(fixed, listed("heading", "heading_trail"), listed("symbol", "symbols")))
    columns = chunks.select("chunk_id", "file_id", "relative_path", *more, "filename", "heading_trail", "symbols")
    each = dealt(columns, "chunk_id", chunks.select("chunk_id"), CHUNKS_A_TASK)
    rows = each.select("chunk_id", "file_id", "relative_path", *more, F.posexplode(fields).alias("field_at", "x"))
    return rows.select("chunk_id", "file_id", "relative_path", *more, "field_at", "x.*").where("value is not null")


def _value_matches(described: DataFrame, queries: DataFrame, config: SearchConfig) -> DataFrame:
    """query_id, term, its place in the query, field, value, kind and strength of every match of a query and a value."""
    asked = kept(queries.select("query_id", F.posexplode(metadata_terms(F.col("query"))).alias("term_at", "term")), "asked-terms")
    # equal terms of different queries are compared once
    kinds = matching_values(described.select("field", "value").distinct(), asked.select("term").distinct(), config)
    return kept(kinds.withColumn("strength", strength(F.col("field"), F.col("kind"))).join(asked, "term"), "value-matches")


def metadata_pool(chunks: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, chunk_id, raw_score, rank: the strongest matches, at most a few of a file.

    If queries have formats, matches of others are left out before any are counted. Queries meet a value's first chunks alone:
    as many of a file as a pool takes of one, and of these as many as the pool has. What comes later in the order of a value
    has that many before it in every query that matches the value, so nothing is lost, however many chunks share a value.
    """
    by_format = "formats" in queries.columns
    order = ["relative_path", "chunk_id"]
    own = ["field", "value", *(["format"] if by_format else [])]
    entries = _described(chunks, *(["format"] if by_format else [])).drop("field_at").distinct()
    matches = _value_matches(entries, queries, config).select("query_id", "field", "value", "strength").distinct()
    matched = entries.join(matches.select("field", "value").distinct(), ["field", "value"], "left_semi")
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    firsts = matched.withColumn("at", place(*own, "file_id")).where(F.col("at") <= config.metadata_chunks_per_file)
    firsts = firsts.withColumn("at", place(*own)).where(F.col("at") <= config.metadata_candidates).drop("at")
    found = firsts.join(matches, ["field", "value"])
    if by_format:
        wanted = queries.select("query_id", "formats").where(F.size("formats") > 0)
        found = only_formats(found.join(wanted, "query_id", "left"), F.col("formats"), F.col("format"))
    best = found.groupBy("query_id", "file_id", "relative_path", "chunk_id").agg(F.max("strength").alias("strength"))
    strongest = [F.desc("strength"), *order]
    capped = best.withColumn("in_file", F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy(*strongest))).where(F.col("in_file") <= config.metadata_chunks_per_file)
    ranked = capped.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*strongest))).where(F.col("rank") <= config.metadata_candidates)
    return ranked.select("query_id", "chunk_id", F.col("strength").alias("raw_score"), "rank")


def only_formats(pool: DataFrame, formats: Column | None, of: Column) -> DataFrame:
    """The pool within the formats asked for (an array; empty or null: all)."""
    return pool if formats is None else pool.where(formats.isNull() | (F.size(formats) <= 0) | F.array_contains(formats, of))
