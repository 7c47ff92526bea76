"""Incremental indexing: what changed is extracted, packed and embedded; what is known is used again."""

from __future__ import annotations

import json
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .config import IndexConfig
from .functions.chunks import chunked
from .functions.embedding import Profile, Provider, embedded_or_why
from .operators import cells, lines
from .operators.retrieval import lengths, postings
from .operators.maintenance import compatibility, deleted, index_decision, reusable, reuse_vectors
from .scratch import kept
from .session import safe_unions
from .sources.store import Snapshot, SnapshotStore

#: Versions that describe an index; a change of these alone leaves its tables as they are.
DESCRIPTOR, APPLICATION = 2, "0.3"


def extracted(files: DataFrame) -> DataFrame:
    """Units of files (file_id, format, text), each format's rules applied to the formats that occur."""
    table = lines.line_table(files.select("file_id", "format", "text"))
    of = lambda *names: table.where(F.col("format").isin(*names)).drop("format")
    present = {r.format for r in files.select("format").distinct().collect()}  # formats are a fixed list
    rules = [(("markdown",), lines.markdown_units), (("csv",), lines.csv_units), (("text", "unknown"), lambda x: lines.fallback_units(x, 50))]
    rules += [(names, partial(lines.code_units, fmt=names[0])) for names in (("python",), ("javascript", "typescript"), ("shell",), ("sql",), ("stylesheet",))]
    records = [((name,), partial(lines.keyed_line_units, fmt=name)) for name in ("yaml", "toml")]
    records += [(("html",), lines.html_units), (("xml",), lines.xml_units), (("json",), lines.json_units)]
    parts = [build(of(*names)) for names, build in rules if present & set(names)]
    # what a format's own rules find nothing in is cut into records of 30 lines
    for name, build in [(n, b) for names, b in records for n in names]:
        if name not in present:
            continue
        if name in ("yaml", "toml"):
            found = kept(build(of(name)), "units")
        else:
            made = build(files.where(F.col("format") == name).select("file_id", "text"))
            extra = {"symbol": F.lit(None).cast("string")} if name == "html" else {"heading_trail": F.array().cast("array<string>")}
            found = kept(made.withColumns({"display_text": F.col("search_text")} | extra).select(*lines.UNIT), "units")
        parts.append(found)
        if name != "html":
            parts.append(lines.fallback_units(of(name).join(found.select("file_id").distinct(), "file_id", "left_anti"), 30, "record"))
    if not parts:
        return lines.fallback_units(table.drop("format"), 50)
    return reduce(DataFrame.unionByName, parts)


class Indexer:
    """Keeps a store's files, chunks, postings and vectors in step with a listing of files."""

    def __init__(self, store: SnapshotStore, provider: Provider, config: IndexConfig = IndexConfig(), profile: Profile | None = None):
        self.store, self.provider, self.config = store, provider, config
        self.profile = profile or Profile(max_tokens=config.max_tokens)
        if config.max_tokens > self.profile.max_tokens:
            raise ValueError("chunks may not be larger than the model's limit")
        safe_unions(store.spark)

    def settings(self) -> dict[str, object]:
        """What an index depends on; kept with every commit."""
        c = self.config
        sizes = {k: getattr(c, k) for k in ("chunk_size_tokens", "chunk_overlap_tokens", "max_tokens")}
        versions = {k: getattr(c, k) for k in ("extractor_version", "chunker_version", "schema_version", "embedding_input_version")}
        described = {"descriptor_version": DESCRIPTOR, "application_version": APPLICATION}
        return {"provider": self.provider.name, "dimension": self.provider.dimension, **self.profile.identity(), **sizes, **versions, **described}

    def identity(self) -> str:
        """What a stored vector was made under, kept with it: a vector of another identity is not used again."""
        made, c = self.profile.identity(), self.config
        names = ("revision", "version", "pooling", "document_prefix", "suffix", "tokenizer", "normalization", "device", "quantization")
        versions = {k: getattr(c, k) for k in ("embedding_input_version", "extractor_version", "chunker_version", "schema_version")}
        return json.dumps({"model": self.provider.name, "dimension": self.provider.dimension, **{k: made[k] for k in names}, **versions})

    def compatibility(self, base: Snapshot | None = None) -> tuple[str, list[str]]:
        """How the store's last commit stands to the present settings (see operators.maintenance.compatibility)."""
        return compatibility((base or self.store.snapshot()).settings, self.settings())

    def differing(self, base: Snapshot | None = None) -> list[str]:
        """Names of the settings for which all must be indexed again; none before the first commit."""
        status, reasons = self.compatibility(base)
        return reasons if status == "rebuild" else []

    def known(self) -> DataFrame:
        """Files indexed under the present settings, whose contents need no second reading while size and time are the same."""
        base = self.store.snapshot()
        return base.read("files").where(F.lit(not self.differing(base)) & self._current() & F.col("content_hash").isNotNull())

    def _current(self) -> Column:
        c = self.config
        return (F.col("index_status") == "indexed") & (F.col("extractor_version") == c.extractor_version) & (F.col("chunker_version") == c.chunker_version) & (F.col("schema_version") == c.schema_version)

    def decisions(self, listing: DataFrame, base: Snapshot | None = None, among: DataFrame | None = None) -> DataFrame:
        """listing with `decision` (see index_decision); files that are gone come as `deleted`, of those named by `among` if given."""
        base = base or self.store.snapshot()
        stored = base.read("files").select(
            F.col("file_id").alias("s_id"), F.col("content_hash").alias("s_hash"), F.col("fingerprint_hash").alias("s_print"), (self._current() & F.lit(not self.differing(base))).alias("s_fine")
        )
        stored = stored if among is None else stored.join(among.select(F.col("file_id").alias("s_id")), "s_id", "left_semi")
        both = listing.join(stored, listing.file_id == stored.s_id, "full_outer")
        same = F.col("content_hash") == F.col("s_hash")
        kind = index_decision(F.col("s_id").isNotNull(), F.coalesce(F.col("s_fine") & same, F.lit(False)), F.coalesce(F.col("fingerprint_hash") == F.col("s_print"), F.lit(False)), F.col("read_status") == "ready", F.col("read_status"))
        decided = both.withColumn("decision", F.when(F.col("file_id").isNull(), "deleted").otherwise(kind)).withColumn("file_id", F.coalesce("file_id", "s_id"))
        return decided.drop("s_id", "s_hash", "s_print", "s_fine")

    def _chunks(self, files: DataFrame, base: Snapshot) -> DataFrame:
        """Chunks of files with their vectors; those whose input was embedded before keep its vector, each prior one once."""
        units = extracted(files).join(files.select("file_id", "relative_path", "format"), "file_id")
        made = chunked(units, self.config)
        text = F.concat(F.lit(f"embedding-input-v{self.config.embedding_input_version}\0"), "search_text")
        made = made.withColumn("embedding_input_hash", F.sha2(text, 256)).join(files.select("file_id", "filename", F.col("content_hash").alias("file_content_hash")), "file_id")
        prior = base.read("chunks").where(reusable(F.col("embedding_model"), F.col("vector"), self.identity(), self.provider.dimension))
        prior = prior.join(files.select("file_id"), "file_id", "left_semi")
        known = reuse_vectors(made, prior.select("file_id", "embedding_input_hash", "chunk_id", "vector").withColumnRenamed("chunk_id", "prior_id"), ["file_id", "embedding_input_hash"], "ordinal", "prior_id", ["vector"])
        fresh = known.where("vector is null and search_text is not null").withColumn("made", embedded_or_why(F.col("search_text"), self.provider, self.profile))
        fresh = fresh.withColumns({"vector": F.col("made.vector"), "last_error": F.coalesce("last_error", "made.why")}).drop("made")
        return known.where("vector is not null or search_text is null").unionByName(fresh).withColumn("embedding_model", F.lit(self.identity()))

    def run(self, listing: DataFrame) -> dict[str, int]:
        """Bring the store up to date; numbers of files by decision. Nothing is written if nothing changed.

        One snapshot is compared, and only rows of changed files are written. Another commit in between is a CommitConflict:
        nothing of this run is seen, and a new run finds what is left to do. Chunks stay together with the state of their file,
        so a search sees no chunk of a file that is not indexed.
        """
        base = self.store.snapshot()
        return self._bring(kept(self.decisions(listing, base), "decided"), base)  # what is read of changed files is read once

    def apply(self, feed: DataFrame) -> dict[str, int]:
        """Apply versions of files as they come (see sources.files.versions), several of a file and late ones among them.

        Of each file the version of the highest generation counts, and only if it is above that of the version applied last: what
        belongs to an older generation changes nothing. Generations are committed with what they brought, so a feed that is
        played again after a failure does nothing twice. Files that the feed does not name stay as they are.
        """
        base = self.store.snapshot()
        newest = Window.partitionBy("file_id").orderBy(F.desc("generation"), F.desc("fingerprint_hash"))
        last = feed.withColumn("__at", F.row_number().over(newest)).where("__at = 1").drop("__at")
        seen = base.read("generations").select("file_id", F.col("generation").alias("seen"))
        fresh = kept(last.join(seen, "file_id", "left").where("seen is null or generation > seen").drop("seen"), "fresh")
        gone = fresh.where("op = 'delete'").select("file_id")
        there = fresh.where("op != 'delete'").drop("op", "generation")
        decided = self.decisions(there, base, there.select("file_id").unionByName(gone))
        return self._bring(kept(decided, "decided"), base, {"generations": (fresh.select("file_id"), fresh.select("file_id", "generation"))}, fresh)

    def _bring(self, decided: DataFrame, base: Snapshot, more: dict[str, tuple] | None = None, named: DataFrame | None = None) -> dict[str, int]:
        """Commit what was decided, and changes of other tables with it, which alone are a commit if rows are named by them."""
        counts = {r.decision: r.n for r in decided.groupBy("decision").agg(F.count("*").alias("n")).collect()}
        if not set(counts) - {"unchanged"}:
            if more and not named.isEmpty():
                self.store.change(more, self.settings(), base)
            return counts
        c, files = self.config, base.read("files")
        made = kept(self._chunks(decided.where("decision = 'content'"), base), "made")  # vectors are inferred once
        bad = made.where("last_error is not null or vector is null").groupBy("file_id").agg(F.coalesce(F.max("last_error"), F.lit("EMBEDDING_FAILED")).alias("why"))
        good = deleted(made, "file_id", bad)
        sizes = good.groupBy("file_id").agg(F.count("*").cast("int").alias("chunk_count"))
        touched = decided.where("decision in ('content', 'metadata', 'failed', 'skipped')").join(bad, "file_id", "left").join(sizes, "file_id", "left")
        failed = F.col("decision").isin("failed", "skipped") | F.col("why").isNotNull()
        rows = touched.withColumns({
            "extraction_status": F.when(failed, "failed").otherwise("extracted"), "index_status": F.when(failed, "failed").otherwise("indexed"),
            "last_error": F.coalesce("why", "last_error", F.lit("")), "chunk_count": F.coalesce("chunk_count", F.lit(0)),
            "extractor_version": F.lit(c.extractor_version), "chunker_version": F.lit(c.chunker_version), "schema_version": F.lit(c.schema_version),
        })
        known = files.select("file_id", F.col("chunk_count").alias("known_count"))
        rows = rows.join(known, "file_id", "left").withColumn("chunk_count", F.when(F.col("decision") == "metadata", F.col("known_count")).otherwise(F.col("chunk_count")))
        changes: dict[str, tuple] = {"files": (decided.where("decision != 'unchanged'"), rows.select(*files.columns))}
        if set(counts) - {"unchanged", "metadata"}:
            window = decided.where("decision not in ('unchanged', 'metadata')")
            of = good.select("chunk_id", "file_id").distinct()
            changes["chunks"] = window, good
            changes["postings"] = window, postings(good).join(of, "chunk_id")
            changes["lengths"] = window, lengths(good).join(of, "chunk_id")
            changes["cells"] = window, cells.dealt(good, self._quantiser(base))
        self.store.change(changes | (more or {}), self.settings(), base)
        return counts

    def _quantiser(self, base: Snapshot) -> cells.Quantiser | None:
        """The stored quantiser, if it is of this provider's vectors."""
        found = cells.Quantiser.stored(base.read("quantiser"))
        return found if found is not None and found.centres.shape[1] == self.provider.dimension else None

    def refresh(self) -> str | None:
        """Make searches fast again after many runs: deal vectors out to cells anew where there are twice as many as before, and
        rewrite every table as one sorted segment. The name of the new snapshot; None if there was nothing to do.

        Below `cells_from` vectors there are no cells, and searches compare all of them. Runs and searches may go on meanwhile; a
        run that commits first makes this one a CommitConflict.
        """
        base = self.store.snapshot()
        held = base.read("cells")
        count, stored = held.count(), self._quantiser(base)
        if count < self.config.cells_from or stored is not None and stored.trained_on * 2 > count > stored.trained_on / 2:
            return self.store.compact()
        made = cells.trained(held, count, self.provider.dimension)
        if made is None:
            return self.store.compact()
        frames = {t: base.read(t) for t in self.store.tables if t not in ("cells", "quantiser") and base.segments(t)}
        again = kept(cells.dealt(held, made), "dealt")
        share = cells.probes_for(again, made, self.config.cells_recall) / len(made.centres)
        frames |= {"cells": again, "quantiser": made.table(self.store.spark)}
        return self.store.commit(frames, {**base.settings, "cell_probes": share}, base)
