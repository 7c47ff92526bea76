"""Queries of extraction, maintenance, identities and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chunks import chunked
from ..functions.paths import normal_path
from ..operators import evaluation, fragments, grep, lines, maintenance, offsets
from ..scratch import dealt
from ..streaming import sessions
from .retrieval import table

#: Order lines that one task sorts.
LINES_A_TASK = 1_000_000


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")


def line_table(spark, sf_dir):
    rows = lines.line_table(files(spark, sf_dir))
    return rows.select("file_id", F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("start_offset"), F.col("end").cast("long").alias("end_offset"), F.md5("text").alias("text_md5"))


def _mixed_breaks(spark, sf_dir):
    """Every document with line ends of three kinds after its sentences, commas and semicolons."""
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit(",\r"))
    return files(spark, sf_dir).withColumn("text", text)


def original_line_places(spark, sf_dir):
    """Where each line begins in the normalized text and in the text as it was, in UTF-16 code units."""
    rows = offsets.line_places(_mixed_breaks(spark, sf_dir))
    return rows.select("file_id", F.col("line").cast("long").alias("line"), "start", "end", "origin", F.md5("text").alias("text_md5"))


def original_ranges(spark, sf_dir):
    """The lines and original places of each document's quarters."""
    places = offsets.line_places(_mixed_breaks(spark, sf_dir))
    size = places.groupBy("file_id").agg(F.max("end").alias("size"))
    parts = size.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"), "size")
    asked = parts.select("file_id", F.col("part").cast("long").alias("part"), F.floor(F.col("size") * F.col("part") / 4).alias("start"), F.floor(F.col("size") * (F.col("part") + 1) / 4).alias("end"))
    found = offsets.original_ranges(asked, places)
    return found.select("file_id", "part", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "original_start", "original_end")


def _unit_columns(units):
    return units.select("file_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("search_text").alias("text_md5"))


def fallback_line_units(spark, sf_dir):
    return _unit_columns(lines.fallback_units(lines.line_table(files(spark, sf_dir)), 5))


def csv_records(spark, sf_dir):
    return _unit_columns(lines.csv_units(lines.line_table(files(spark, sf_dir)), 25))


def markdown_units(spark, sf_dir):
    units = lines.markdown_units(lines.line_table(files(spark, sf_dir)))
    return units.select("file_id", "kind", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.size("heading_trail").cast("long").alias("depth"), F.length("search_text").cast("long").alias("n_chars"))


def chunk_documents(spark, sf_dir):
    """Every document's lines packed into chunks as an index holds them."""
    units = lines.fallback_units(lines.line_table(files(spark, sf_dir)))
    made = chunked(units.withColumns({"relative_path": F.concat(F.col("file_id").cast("string"), F.lit(".txt")), "format": F.lit("text")}))
    return made.select(F.col("file_id").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("token_count").cast("long").alias("tokens"), F.md5("search_text").alias("text_md5"), "last_error")


def html_title_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", lines.html_title(F.col("html")).alias("title"), F.md5(lines.html_title(F.col("html"))).alias("title_md5"))


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("text"))


def html_units(spark, sf_dir):
    places = [F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")]
    return lines.html_units(_pages(spark, sf_dir)).select("file_id", F.col("unit").cast("long").alias("unit"), "kind", "search_text", "heading_trail", *places)


def xml_records(spark, sf_dir):
    return lines.xml_units(_pages(spark, sf_dir)).select("file_id", F.col("unit").cast("long").alias("unit"), "search_text", "symbol", F.col("start_line").cast("long").alias("start_line"), "start_offset")


def code_declarations(spark, sf_dir):
    """HTML sources read as stylesheets: their rules and what stands before them."""
    units = lines.code_units(lines.line_table(_pages(spark, sf_dir)), "stylesheet")
    return units.select("file_id", "kind", "symbol", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def highlight_ranges(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = lines.highlight_ranges(texts, ["the", "heat", "de"])
    return found.select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start_offset"), F.col("end").cast("long").alias("end_offset"))


def grep_lines(spark, sf_dir):
    """Lines that hold a pattern and how often, as a search in files reports them."""
    pattern = r"(?i)\b(released|license|token)\b"
    if (why := T.anchor_safe(pattern)) is not None:
        raise ValueError(why)
    rows = lines.line_table(files(spark, sf_dir)).withColumn("matches", F.regexp_count("text", F.lit(pattern)).cast("long")).where("matches > 0")
    return rows.select("file_id", F.col("line").cast("long").alias("line"), "matches", (F.length(F.regexp_extract("text", r"(?is)^(.*?)\b(?:released|license|token)\b", 1)) + 1).cast("long").alias("column_no"))


def grep_matches(spark, sf_dir):
    """Every place of a word's beginning, overlapping places included."""
    found = grep.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), "ana")
    rows = found.select("doc_id", F.col("found.limited").alias("limited"), F.explode("found.matches").alias("m"))
    return rows.select("doc_id", F.col("m.start").cast("long").alias("start_offset"), F.col("m.line").cast("long").alias("line"), F.col("m.column").cast("long").alias("column_no"), "limited")


def json_records(spark, sf_dir):
    """Leaves of each event's properties, read as JSON files."""
    files_ = table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.col("props").alias("text"))
    return lines.json_units(files_).select(F.col("file_id").alias("event_id"), "symbol", "search_text")


def token_count_unicode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.unicode_token_count(F.col("text")).cast("long").alias("tokens"))


def token_bucket_padding(spark, sf_dir):
    """Useful and padded tokens of texts dealt to input shapes of an eighth to the whole of 8192 tokens, and what is beyond that."""
    whole = T.unicode_token_count(F.col("text")).cast("long")
    tokens = F.least(whole, F.lit(8192)).cast("long")
    bucket = F.expr("case when tokens <= 1024 then 1024 when tokens <= 2048 then 2048 when tokens <= 4096 then 4096 when tokens <= 6144 then 6144 else 8192 end").cast("long")
    counted = table(spark, sf_dir, "documents").select(tokens.alias("tokens"), (whole - tokens).alias("beyond")).withColumn("bucket", bucket)
    return counted.groupBy("bucket").agg(F.count("*").alias("texts"), F.sum("tokens").alias("useful"), F.sum("bucket").alias("padded"), F.sum("beyond").alias("beyond"), F.round(F.sum("tokens") / F.sum("bucket"), 6).alias("fill"))


def file_identity_hash(spark, sf_dir):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", T.file_id(T.root_identity(F.lit("/corpus")), path).alias("file_id"), F.sha2("text", 256).alias("content_hash"))


def fake_embedding(spark, sf_dir):
    """A unit vector drawn from each text's digest: its length before scaling, and its ends."""
    hexed = F.sha2(F.col("text"), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda at, x: at + x * x))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", F.round(length, 6).alias("length"), F.round(F.get("raw", F.lit(0)) / length, 6).alias("first"), F.round(F.get("raw", F.lit(31)) / length, 6).alias("last"))


def _url_path(url):
    return F.regexp_extract(url, r"^https?://([^?#]*)", 1)


def format_dispatch(spark, sf_dir):
    path = _url_path(F.col("url"))
    ext = T.extension(T.basename(path))
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("extension"), T.format_of(ext, "unknown").alias("format"), T.mime_of(ext, "application/octet-stream").alias("mime"))


def ignore_glob_filter(spark, sf_dir):
    from ..sources.ignore import ignored

    rows = table(spark, sf_dir, "pages").withColumn("path", _url_path(F.col("url")))
    return rows.where(~ignored(F.col("path"), ["*.html", "www.*/", "**/es/**", "# note", "blog.?h*/"])).select("page_id", "path")


def _manifests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 1, "ready").otherwise("unreadable").alias("read_status"), F.sha2(F.lower("text"), 256).alias("content_hash"), F.col("toxic").cast("string").alias("last_error"), F.col("n_chars").alias("size")
    )
    now = table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select(
        F.col("doc_id").alias("file_id"), F.when(F.length("text") > 0, "ready").otherwise("unsupported").alias("read_status"), F.sha2(F.when(F.col("label") < 5, F.lower("text")).otherwise(F.col("text")), 256).alias("content_hash"), F.floor(F.col("label") / 3).cast("string").alias("last_error"), F.col("n_chars").alias("size")
    )
    return before, now


def scan_diff_classify(spark, sf_dir):
    before, now = _manifests(spark, sf_dir)
    return maintenance.classify_changes(before, now, ("last_error", "size"))


def scan_progress(spark, sf_dir):
    return scan_diff_classify(spark, sf_dir).groupBy("change").agg(F.count("*").alias("files"))


def commit_visibility(spark, sf_dir):
    """Documents whose label row names their present content (its length, here) and is of good quality."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.md5("text").alias("file_content_hash"))
    marks = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 1, "indexed").otherwise("failed").alias("index_status"), F.lit("extracted").alias("extraction_status"), F.md5(F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text"))).alias("content_hash")
    )
    from ..operators.retrieval import committed

    return committed(docs, marks).select("chunk_id")


def vector_reuse_multiset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("input_hash"))
    prior = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("reused_from", F.col("doc_id"))
    return maintenance.reuse_vectors(docs, prior, ["lang", "input_hash"], "doc_id", "doc_id", ["reused_from"]).select("doc_id", "reused_from")


def replace_by_key(spark, sf_dir):
    """Lines of finished orders replaced by one line an order; then lines and quantity of every order."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    window = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = dealt(items.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", items, LINES_A_TASK)  # sorted once for both joins
    new = kept.join(window, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.lit(1).alias("l_linenumber"), F.max("l_quantity").alias("l_quantity"))
    after = maintenance.replaced(kept, "l_orderkey", window, new)
    return after.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))


def delete_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    after = maintenance.deleted(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey", orders.where("o_orderstatus = 'P'"))
    return after.select("o_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))


def metadata_only_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = orders.where("o_orderstatus = 'O'").withColumn("o_orderpriority", F.lit("1-URGENT"))
    return maintenance.upserted(orders, "o_orderkey", new)


def change_feed_apply(spark, sf_dir):
    """The last event of each user wins; an error event deletes the user."""
    feed = table(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("upsert"))
    return maintenance.latest(feed, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def dedupe_max_score(spark, sf_dir):
    best = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(best)).where("n = 1").select("user_id", "event_id", "value")


def debounce_sessions(spark, sf_dir):
    return sessions.bursts(table(spark, sf_dir, "events"), "100 seconds").select("n_events", sessions.micros(F.col("first_ts")).alias("first_us"), sessions.micros(F.col("last_ts")).alias("last_us"))


def reconcile_wake(spark, sf_dir):
    """Silences at least twice the reconcile interval long, of each kind of event."""
    return sessions.silences(table(spark, sf_dir, "events"), "event_type", 600).select("event_type", "event_id", F.col("gap_us").alias("gap_us"))


def event_replay(spark, sf_dir):
    """What a client that saw event 5 last is sent of the 128 events kept."""
    return sessions.replay(table(spark, sf_dir, "events"), 5, 128).select("event_id", "event_type")


def latency_distribution(spark, sf_dir):
    return evaluation.distribution(table(spark, sf_dir, "events"), ["event_type"], "value")


def warm_query_medians(spark, sf_dir):
    """Each kind of event as a model, each user as a query, and its events in order as runs of it: the first is cold."""
    order = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    samples = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("query_id"), F.row_number().over(order).alias("run"), F.col("value").alias("ms"))
    return evaluation.warm_medians(samples, ["event_type"])


def stage_throughput(spark, sf_dir):
    """Events a second of each kind, and the seconds its stage took."""
    seconds = (sessions.micros(F.max("ts")) - sessions.micros(F.min("ts"))) / 1_000_000
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.round(seconds, 3).alias("seconds"), F.round(F.count("*") / seconds, 9).alias("per_second"))


def count_by_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"))


def corpus_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.agg(F.count_if(F.col("quality") == 1).alias("supported"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("quality").isNull()).alias("skipped"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.struct("n_chars", "doc_id"))["doc_id"].alias("largest"), F.min(F.struct("n_chars", "doc_id"))["doc_id"].alias("smallest"))


def corpus_report(spark, sf_dir):
    """Documents by status, language and reason of failure: a poor one is malformed, a toxic one unsafe."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "unsafe").when(F.col("quality") == 0, "malformed").when(F.col("quality") == 1, "ready").otherwise("unsupported")
    error = F.when(F.col("quality") == 0, F.concat_ws(" ", F.lit("poor"), F.col("source")))
    rows = docs.select(F.col("lang").alias("format"), status.alias("read_status"), error.alias("last_error"), F.octet_length("text").cast("long").alias("size"))
    return evaluation.corpus_report(rows)


def nearest_matches(spark, sf_dir):
    """Of each document with matches, the one nearest to its middle line."""
    docs = files(spark, sf_dir).withColumn("middle", F.regexp_count("text", F.lit("\n")) / 2 + 1)
    found = grep.matches(docs, F.col("text"), "the", most=1 << 31).select("file_id", F.floor("middle").alias("middle"), F.col("found.matches").alias("matches"))
    place = grep.nearest_match(F.col("matches"), F.col("middle"))
    return found.where(F.size("matches") > 0).select("file_id", "middle", place.cast("long").alias("place"), F.get("matches", place)["line"].cast("long").alias("line"))


def section_hit(spark, sf_dir):
    """Whether an answer of each conversation holds the first two words that its user wrote."""
    turns = table(spark, sf_dir, "conversations")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    talk = turns.groupBy("conv_id").agg(of("assistant").alias("answers"), F.slice(T.terms(F.get(of("user"), F.lit(0))), 1, 2).alias("sections"))
    return talk.select("conv_id", evaluation.section_hit(F.col("answers"), F.coalesce(F.col("sections"), F.array().cast("array<string>"))).alias("hit"))


def set_operations(spark, sf_dir):
    """Documents with labels, with vectors, with either, with both, and of either alone."""
    label, vector = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    named = lambda df, name: df.agg(F.lit(name).alias("which"), F.count("*").alias("n"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("id_sum"))
    return named(label.union(vector).distinct(), "either").unionByName(named(label.intersect(vector), "both")).unionByName(named(label.subtract(vector), "label alone")).unionByName(named(vector.subtract(label), "vector alone"))


def normalized_paths(spark, sf_dir):
    """Paths of pages with parts that lead up, empty and dot parts, backslashes and accents written apart, in one spelling."""
    path = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    odd = F.concat(F.replace(F.replace(path, F.lit("."), F.lit("/../")), F.lit("e"), F.lit("e\u0301")), F.lit("\\x//./"), F.lit("y/"))
    return table(spark, sf_dir, "pages").select("page_id", normal_path(odd).alias("path"))


def _absolute(spark, sf_dir):
    """Pages whose links from the root name their host."""
    host = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    return table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit('href="/'), F.concat(F.lit('href="'), host, F.lit("/"))))


def external_links(spark, sf_dir):
    """The different addresses of the web that each page names, in order, with the text of the first link to each."""
    found = _absolute(spark, sf_dir).select("page_id", F.posexplode(fragments.linked(F.col("html"))).alias("place", "link"))
    return found.select("page_id", F.col("place").cast("long").alias("place"), "link.href", "link.label")


def safe_fragments(spark, sf_dir):
    """Each page's body made safe to show."""
    made = _absolute(spark, sf_dir).select("page_id", fragments.previewed(F.col("html")).alias("p"))
    return made.select("page_id", F.col("p.safe").alias("safe"), F.size("p.links").cast("long").alias("links"))


def json_leaves(spark, sf_dir):
    """Leaves of each event's properties as `path: value`."""
    leaves = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(leaves).alias("path", "value")).select("event_id", "path", F.concat("path", F.lit(": "), "value").alias("search_text"))


def enriched_text(spark, sf_dir):
    """Digest of each document's text with the lines that say where it stands."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = T.enriched(path, F.lit("text"), F.array("lang"), F.array().cast("array<string>"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("text_md5"))


_L = """
parts as (select doc_id as file_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as ls from documents),
line0 as (select file_id, unnest(ls) as text, generate_subscripts(ls, 1) as line from parts),
line as (select *, sum(length(text) + 1) over (partition by file_id order by line) - 1 as e from line0),
"""
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_MANIFESTS = """
prev as (select doc_id as file_id, case when quality = 1 then 'ready' else 'unreadable' end as st, sha256(lower(text)) as h, toxic::varchar as er, n_chars as sz from labels join documents using (doc_id)),
cur as (select doc_id as file_id, case when length(text) > 0 then 'ready' else 'unsupported' end as st, sha256(case when label < 5 then lower(text) else text end) as h, floor(label / 3)::bigint::varchar as er, n_chars as sz from embeddings join documents on vec_id = doc_id),
diff as (select coalesce(p.file_id, c.file_id) as file_id, case when c.file_id is null then 'deleted' when p.file_id is null then (case when c.st = 'ready' then 'added' else 'failed' end)
  when p.st <> c.st then (case when c.st = 'ready' then 'content-changed' else 'failed' end) when c.st <> 'ready' then (case when p.h = c.h and p.er = c.er and p.sz = c.sz then 'unchanged' else 'failed' end)
  when p.h <> c.h then 'content-changed' when p.er <> c.er or p.sz <> c.sz then 'metadata-only' else 'unchanged' end as change
  from prev p full outer join cur c on p.file_id = c.file_id)
"""
_PATH = "regexp_extract(url, '^https?://([^?#]*)', 1)"
_EXT = f"lower(regexp_extract(regexp_extract({_PATH}, '([^/]*)$', 1), '[^/](\\.[^./]*)$', 1))"


def _occurrences(term: str) -> str:
    n = len(term)
    return f"select doc_id, sum(length(piece)) over (partition by doc_id order by part) + (part - 1) * {n} as s, sum(length(piece)) over (partition by doc_id order by part) + part * {n} as e, part, n_parts from (select doc_id, unnest(string_split(lower(text), '{term}')) as piece, generate_subscripts(string_split(lower(text), '{term}'), 1) as part, len(string_split(lower(text), '{term}')) as n_parts from documents)"


_FORMATS = " ".join(f"when '{e}' then '{f}'" for e, (f, _) in T.EXTENSIONS.items())
_MIMES = " ".join(f"when '{e}' then '{m}'" for e, (_, m) in T.EXTENSIONS.items())

QUERIES = {
    f.__name__: f
    for f in (
        line_table, original_line_places, original_ranges, fallback_line_units, chunk_documents, csv_records, markdown_units, html_title_text, html_units, xml_records, code_declarations, highlight_ranges, grep_lines, grep_matches, json_records, token_count_unicode, token_bucket_padding, file_identity_hash, fake_embedding,
        format_dispatch, ignore_glob_filter, scan_diff_classify, scan_progress, commit_visibility, vector_reuse_multiset, replace_by_key, delete_by_key, metadata_only_update, change_feed_apply, dedupe_max_score, debounce_sessions,
        reconcile_wake, event_replay, latency_distribution, warm_query_medians, stage_throughput, count_by_format, corpus_rollup, section_hit, set_operations, json_leaves, enriched_text,
        normalized_paths, external_links, safe_fragments, corpus_report, nearest_matches,
    )
}

_PLACES = r"""
mixed as (select doc_id as file_id, replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13)) as text from documents),
split0 as (select file_id, string_split_regex(text, '\r\n|\r|\n') as ls, regexp_extract_all(text, '\r\n|\r|\n') as bs from mixed),
split1 as (select file_id, ls[k] as text, coalesce(length(bs[k]), 0) as b, k as line from (select file_id, ls, bs, unnest(range(1, len(ls) + 1)) as k from split0)),
sized1 as (select *, length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) as n from split1),
placed as (select file_id, line, text, n, coalesce(sum(n + 1) over before, 0)::bigint as s, coalesce(sum(n + b) over before, 0)::bigint as origin from sized1
  window before as (partition by file_id order by line rows between unbounded preceding and 1 preceding)),
"""
SQL = {
    "original_line_places": f"with {_PLACES.strip().rstrip(',')} select file_id, line, s as start, s + n as \"end\", origin, md5(text) as text_md5 from placed",
    "original_ranges": f"""with {_PLACES} sizes as (select file_id, max(s + n) as size from placed group by 1),
      asked as (select file_id, part, (size * part // 4) as a, (size * (part + 1) // 4) as b from sizes, (select unnest(range(4)) as part)),
      lows as (select file_id, part, max(line) as start_line from asked join placed using (file_id) where s <= a group by 1, 2),
      highs as (select file_id, part, max(line) as end_at from asked join placed using (file_id) where s <= b group by 1, 2),
      ends as (select file_id, part, coalesce(max(line) filter (s < b), 1) as end_line from asked join placed using (file_id) group by 1, 2)
      select file_id, part, start_line, end_line, p.origin + a - p.s as original_start, q.origin + b - q.s as original_end
      from asked join lows using (file_id, part) join highs using (file_id, part) join ends using (file_id, part)
      join placed p on p.file_id = asked.file_id and p.line = start_line join placed q on q.file_id = asked.file_id and q.line = end_at""",
    "line_table": f"with {_L.strip().rstrip(',')} select file_id, line, (e - length(text))::bigint as start_offset, e::bigint as end_offset, md5(text) as text_md5 from line",
    "fallback_line_units": f"""with {_L} gaps as (select *, {_TRIM.format('text')} = '' as blank, sum(({_TRIM.format('text')} = '')::int) over (partition by file_id order by line) as gap from line),
      placed as (select *, floor((row_number() over (partition by file_id, gap order by line) - 1) / 5) as run from gaps where not blank)
      select file_id, min(line) as start_line, max(line) as end_line, md5({_TRIM.format("string_agg(text, chr(10) order by line)")}) as text_md5 from placed group by file_id, gap, run""",
    "csv_records": f"""with {_L} headed as (select *, first_value(text) over (partition by file_id order by line) as header, floor((line - 1) / 25) as record from line),
      made as (select file_id, record, {_TRIM.format("string_agg(text, chr(10) order by line)")} as t, any_value(header) as header, min(line) as start_line, max(line) as end_line from headed group by 1, 2),
      searched as (select *, case when record = 0 then t else header || chr(10) || t end as s from made)
      select file_id, start_line, end_line, md5(s) as text_md5 from searched where s <> ''""",
    "html_title_text": """with t as (select page_id, regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1) as x from pages),
      v as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)<(br|hr)\\s*/?\\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g') as x from t),
      p as (select page_id, string_split_regex(x, '(?i)&(?:#x[0-9a-f]+|#[0-9]+|lt|gt|quot|apos|nbsp|amp);') as gaps, regexp_extract_all(x, '(?i)&(?:#x[0-9a-f]+|#[0-9]+|lt|gt|quot|apos|nbsp|amp);') as found from v),
      e as (select page_id, gaps, list_transform(found, lambda f: case lower(f) when '&lt;' then '<' when '&gt;' then '>' when '&quot;' then '"' when '&apos;' then chr(39) when '&nbsp;' then ' ' when '&amp;' then '&'
        else coalesce(chr(case when lower(f) like '&#x%' then try_cast('0x' || regexp_extract(f, '(?i)^&#x0*([0-9a-f]{1,5});$', 1) as integer) else try_cast(regexp_extract(f, '^&#0*([0-9]{1,6});$', 1) as integer) end), f) end) as signs from p),
      d as (select page_id, regexp_replace(array_to_string(list_transform(range(1, len(gaps) + 1), lambda k: gaps[k] || coalesce(signs[k], '')), ''), '^\\s+|\\s+$', '', 'g') as x from e)
      select page_id, x as title, md5(x) as title_md5 from d""",
    "highlight_ranges": f"""with occ as ({' union all '.join(f"select doc_id, s, e from ({_occurrences(t)}) where part < n_parts" for t in ('the', 'heat', 'de'))}),
      reach as (select *, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) as r from occ),
      island as (select *, sum((r is null or s > r)::int) over (partition by doc_id order by s, e rows unbounded preceding) as i from reach)
      select doc_id, min(s)::bigint as start_offset, max(e)::bigint as end_offset from island group by doc_id, i""",
    "grep_lines": f"""with {_L} found as (select *, len(regexp_extract_all(text, '(?i)\\b(released|license|token)\\b')) as matches from line)
      select file_id, line, matches, length(regexp_extract(text, '(?is)^(.*?)\\b(?:released|license|token)\\b', 1)) + 1 as column_no from found where matches > 0""",
    "json_records": "with k as (select event_id, unnest(json_keys(props)) as symbol, props from events) select event_id, symbol, symbol || ': ' || json_extract_string(props, '$.' || symbol) as search_text from k",
    "token_count_unicode": "select doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s]')) + 2 as tokens from documents",
    "token_bucket_padding": """with w as (select len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s]')) + 2 as whole from documents), c as (select least(whole, 8192) as tokens, whole from w),
      b as (select tokens, whole - tokens as beyond, (case when tokens <= 1024 then 1024 when tokens <= 2048 then 2048 when tokens <= 4096 then 4096 when tokens <= 6144 then 6144 else 8192 end)::bigint as bucket from c)
      select bucket, count(*) as texts, sum(tokens)::bigint as useful, sum(bucket)::bigint as padded, sum(beyond)::bigint as beyond, round(sum(tokens) / sum(bucket), 6) as fill from b group by 1""",
    "file_identity_hash": "select doc_id, sha256('file-v1' || chr(0) || sha256('canonical-root-v1' || chr(0) || '/corpus') || chr(0) || source || '/' || doc_id || '.txt') as file_id, sha256(text) as content_hash from documents",
    "fake_embedding": """with r as (select doc_id, list_transform(range(32), lambda i: ('0x' || substr(sha256(text), (2 * i + 1)::int, 2))::int / 127.5::double - 1) as raw from documents),
      n as (select doc_id, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) as length from r)
      select doc_id, round(length, 6) as length, round(raw[1] / length, 6) as first, round(raw[32] / length, 6) as last from n""",
    "format_dispatch": f"select page_id, {_EXT} as extension, case {_EXT} {_FORMATS} else 'unknown' end as format, case {_EXT} {_MIMES} else 'application/octet-stream' end as mime from pages",
    "ignore_glob_filter": f"""with p as (select page_id, {_PATH} as path from pages)
      select page_id, path from p where not regexp_matches(path, '^(?:.*/)?[^/]*\\.html(?:/.*)?$') and not regexp_matches(path, '^(?:.*/)?www\\.[^/]*/.*$')
        and not regexp_matches(path, '^(?:.*/)?es/.*(?:/.*)?$') and not regexp_matches(path, '^(?:.*/)?blog\\.[^/]h[^/]*/.*$')""",
    "scan_diff_classify": f"with {_MANIFESTS} select * from diff",
    "scan_progress": f"with {_MANIFESTS} select change, count(*) as files from diff group by 1",
    "commit_visibility": "select doc_id as chunk_id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1 and md5(case when toxic = 1 then upper(d.text) else d.text end) = md5(d.text))",
    "vector_reuse_multiset": """with new as (select doc_id, lang, sha256(text) as h, row_number() over (partition by lang, sha256(text) order by doc_id) as n from documents),
      prior as (select doc_id, lang, sha256(text) as h, row_number() over (partition by lang, sha256(text) order by doc_id) as n from documents where doc_id in (select doc_id from labels))
      select new.doc_id, prior.doc_id as reused_from from new left join prior on new.lang = prior.lang and new.h = prior.h and new.n = prior.n""",
    "replace_by_key": """with f as (select o_orderkey from orders where o_orderstatus = 'F'), a as (select l_orderkey, l_quantity from lineitem where l_orderkey not in (select o_orderkey from f)
      union all select l_orderkey, max(l_quantity) from lineitem where l_orderkey in (select o_orderkey from f) group by 1) select l_orderkey, count(*) as n_lines, sum(l_quantity) as quantity from a group by 1""",
    "delete_by_key": "select l_orderkey as o_orderkey, l_linenumber::int as l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')",
    "metadata_only_update": "select o_orderkey, o_orderstatus, case when o_orderstatus = 'O' then '1-URGENT' else o_orderpriority end as o_orderpriority from orders",
    "change_feed_apply": "with l as (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select user_id, event_id, event_type, value from l where event_type <> 'error'",
    "dedupe_max_score": "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by value desc, event_id) = 1",
    "debounce_sessions": """with g as (select ts, epoch_us(ts) - epoch_us(lag(ts) over (order by ts)) as gap from events), s as (select ts, sum((gap is null or gap >= 100000000)::int) over (order by ts rows unbounded preceding) as id from g)
      select count(*) as n_events, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from s group by id""",
    "reconcile_wake": "with g as (select event_type, event_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by event_type order by ts, event_id)) as gap_us from events) select event_type, event_id, gap_us from g where gap_us >= 1200000000",
    "event_replay": "with l as (select * from events order by event_id desc limit 128), o as (select min(event_id) as oldest from l) select event_id, event_type from l, o where event_id > 5 or 5 < oldest - 1",
    "latency_distribution": "select event_type, count(*) as count, min(value) as min, round(avg(value), 6) as mean, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, max(value) as max from events where isfinite(value) group by 1",
    "warm_query_medians": """with s as (select event_type, user_id, value, row_number() over (partition by event_type, user_id order by ts, event_id) as run from events),
      warm as (select * from s where run > 1),
      placed as (select event_type, user_id, value, row_number() over (partition by event_type, user_id order by value) - 1 as pos, count(*) over (partition by event_type, user_id) as n from warm),
      medians as (select event_type, value as median from placed where pos = n // 2),
      again as (select event_type, median, row_number() over (partition by event_type order by median) - 1 as pos, count(*) over (partition by event_type) as n from medians)
      select event_type, n as queries, median as p50, p95 from again join (select event_type, quantile_disc(value, 0.95) as p95 from warm group by 1) using (event_type) where pos = n // 2""",
    "stage_throughput": "with s as (select event_type, count(*) as events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double as seconds from events group by 1) select event_type, events, round(seconds, 3) as seconds, round(events / seconds, 9) as per_second from s",
    "count_by_format": "select lang, count(*) as files from documents group by 1",
    "corpus_rollup": "select count(*) filter (quality = 1) as supported, count(*) filter (quality = 0) as failed, count(*) filter (quality is null) as skipped, sum(strlen(text))::bigint as bytes, arg_max(doc_id, (n_chars, doc_id)) as largest, arg_min(doc_id, (n_chars, doc_id)) as smallest from documents left join labels using (doc_id)",
    "corpus_report": """with f as (select lang, source, strlen(text) as size, case when toxic = 1 then 'unsafe' when quality = 0 then 'malformed' when quality = 1 then 'ready' else 'unsupported' end as status, quality from documents left join labels using (doc_id)),
      p as (select 'all' as part, 'files' as name, size from f union all select 'status', status, size from f union all select 'format', coalesce(lang, 'unknown'), size from f where status = 'ready'
        union all select 'failure', case when quality = 0 then 'poor' || coalesce(' ' || source, '') else status end, size from f where status in ('unsafe', 'malformed'))
      select part, name, count(*) as files, sum(size)::bigint as bytes from p group by 1, 2""",
    "nearest_matches": """with l as (select doc_id as file_id, string_split(lower(text), chr(10)) as ls from documents), m as (select file_id, (len(ls) - 1) // 2 + 1 as middle, unnest(ls) as text, generate_subscripts(ls, 1) as line from l),
      n as (select file_id, middle, line, len(string_split(text, 'the')) - 1 as found from m), s as (select *, sum(found) over (partition by file_id order by line) as upto from n where found > 0),
      a as (select file_id, middle, sum(found) as total, coalesce(sum(found) filter (line < middle), 0) as before, min(line) filter (line >= middle) as next, max(line) as last from s group by 1, 2)
      select file_id, middle, least(before, total - 1)::bigint as place, coalesce(next, last) as line from a""",
    "section_hit": """with t as (select conv_id, list(text order by turn) filter (role = 'assistant') as answers, regexp_extract_all(lower(first(text order by turn) filter (role = 'user')), '[\\p{L}\\p{N}]+')[1:2] as sections from conversations group by 1)
      select conv_id, case when len(sections) > 0 then coalesce(len(list_filter(answers, lambda a: len(list_filter(sections, lambda s: contains(lower(a), s))) > 0)), 0) > 0 end as hit from t""",
    "set_operations": """with l as (select doc_id from labels), v as (select vec_id as doc_id from embeddings)
      select 'either' as which, count(*) as n, coalesce(sum(doc_id), 0)::bigint as id_sum from (select * from l union select * from v) union all select 'both', count(*), coalesce(sum(doc_id), 0)::bigint from (select * from l intersect select * from v)
      union all select 'label alone', count(*), coalesce(sum(doc_id), 0)::bigint from (select * from l except select * from v) union all select 'vector alone', count(*), coalesce(sum(doc_id), 0)::bigint from (select * from v except select * from l)""",
    "normalized_paths": f"""with odd as (select page_id, nfc_normalize(replace(replace(replace({_PATH}, '.', '/../'), 'e', 'e' || chr(769)) || chr(92) || 'x//./y/', chr(92), '/')) as path from pages),
      parts as (select page_id, list_filter(string_split(path, '/'), lambda x: x not in ('', '.')) as ps from odd),
      part as (select page_id, unnest(ps) as part, generate_subscripts(ps, 1) as place from parts),
      level as (select *, sum(case when part = '..' then -1 else 1 end) over (partition by page_id order by place) as depth from part),
      after as (select *, min(depth) over (partition by page_id order by place rows between current row and unbounded following) as least from level)
      select page_id, case when min(depth) >= 0 then string_agg(part, '/' order by place) filter (part <> '..' and least >= depth) end as path from after group by 1""",
    "external_links": r"""with a as (select page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) as paths, regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) as labels, regexp_extract(url, '^(https?://[^/?#]*)', 1) as host from pages),
      l as (select page_id, lower(host) || '/' || array_to_string(list_transform(string_split(paths[k], ''), lambda c: case when c between '!' and '~' and c not in ('"', '#', '<', '>', '?', '^', '`', '{', '}') then c else url_encode(c) end), '') as href, labels[k] as label, k
        from (select *, unnest(range(1, len(paths) + 1)) as k from a)),
      f as (select page_id, href, min(k) as k, arg_min(label, k) as label from l group by 1, 2)
      select page_id, row_number() over (partition by page_id order by k) - 1 as place, href, label from f""",
    "json_leaves": "with k as (select event_id, unnest(json_keys(props)) as path, props from events) select event_id, path, path || ': ' || json_extract_string(props, '$.' || path) as search_text from k",
    "enriched_text": "select doc_id, md5('Path: ' || source || '/' || doc_id || '.txt' || chr(10) || 'File: ' || doc_id || '.txt' || chr(10) || 'Format: text' || chr(10) || 'Heading: ' || lang || chr(10) || chr(10) || text) as text_md5 from documents",
}
