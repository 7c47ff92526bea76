"""Hybrid search over an index: three pools, fused and gathered by file."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import SearchConfig, normalize_request
from .functions.embedding import Profile, Provider, checked
from .operators import cells, fusion, retrieval
from .operators.cells import Quantiser
from .scratch import kept
from .session import safe_unions
from .sources.store import Snapshot, SnapshotStore


class HybridSearch:
    """Searches the present snapshot of a store. Chunks of files that are not committed are never seen.

    A search takes one snapshot and reads all its tables from that, whatever is committed meanwhile.
    """

    def __init__(self, store: SnapshotStore, provider: Provider, config: SearchConfig = SearchConfig(), profile: Profile = Profile()):
        self.store, self.provider, self.config, self.profile = store, provider, config, profile
        safe_unions(store.spark)

    @staticmethod
    def catalog(held: Snapshot) -> DataFrame:
        """Committed chunks of a snapshot."""
        return retrieval.committed(held.read("chunks"), held.read("files"))

    @staticmethod
    def index(held: Snapshot) -> retrieval.TextIndex:
        """The stored postings and lengths. A commit holds those of a file only while it is indexed."""
        return retrieval.TextIndex.stored(held.scan("postings"), held.read("lengths"), foldered=True)

    def search(self, query: str, files: int | None = None, formats: tuple[str, ...] = ()) -> DataFrame:
        request = normalize_request(query, files, formats, self.config)
        spark = self.store.spark
        rows = [("q", request.query, list(request.formats))]
        return self.search_batch(spark.createDataFrame(rows, "query_id string, query string, formats array<string>"), request.files)

    def search_batch(self, queries: DataFrame, files: int | None = None, held: Snapshot | None = None) -> DataFrame:
        """query_id, rank, file_id, relative_path, score, sources, n_chunks, excerpts of the best files of each query.

        queries: query_id, query and, if wanted, formats: all pools leave out other formats before they take their best. Any
        number of queries, computed and embedded once. held: the snapshot to search, else the present one.
        """
        held, config = held or self.store.snapshot(), self.config
        chunks = self.catalog(held)
        queries = queries if "formats" in queries.columns else queries.withColumn("formats", F.array().cast("array<string>"))
        kind = dict(queries.dtypes)["query_id"]
        provider, profile, schema = self.provider, self.profile, f"query_id {kind}, query string, formats array<string>, query_vector array<double>"

        def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = checked(provider, [profile.composed(q, query=True) for q in batch["query"]]) if len(batch) else []
                yield batch[["query_id", "query", "formats"]].assign(query_vector=[v.tolist() for v in found])

        asked = kept(queries.select("query_id", "query", "formats").mapInPandas(embed, schema), "queries")
        text = asked.select("query_id", "query", "formats")
        quantiser = Quantiser.stored(held.read("quantiser"))
        share = held.settings.get("cell_probes", config.cell_probes)
        probes = None if quantiser is None else max(1, ceil(share * len(quantiser.centres)))
        pools = {
            "vector": cells.pool(held.scan("cells"), quantiser, asked.drop("query"), config, probes),
            "bm25": retrieval.bm25_pool(self.index(held), text, config, chunks.select("chunk_id", "format")),
            "metadata": retrieval.metadata_pool(chunks, text, config),
        }
        named = [pool.select("query_id", F.lit(name).alias("source"), "chunk_id", "raw_score") for name, pool in pools.items()]
        fused = kept(fusion.fuse(named[0].unionByName(named[1]).unionByName(named[2]), config), "fused")
        about = chunks.select("chunk_id", "file_id", "relative_path", fusion.context(F.col("heading_trail"), F.col("symbols")).alias("context"))
        candidates = kept(about.join(fused, "chunk_id"), "candidates")
        best = fusion.aggregate_files(candidates, files, config)
        shown = fusion.diverse_excerpts(candidates, config).join(best.select("query_id", "file_id"), ["query_id", "file_id"], "left_semi")
        shown = chunks.select("chunk_id", "display_text", "start_line", "end_line", "heading_trail", "symbols").join(shown, "chunk_id")
        excerpt = F.struct("excerpt", "chunk_id", "start_line", "end_line", "display_text", "heading_trail", "symbols")
        shown = shown.groupBy("query_id", "file_id").agg(F.array_sort(F.collect_list(excerpt)).alias("excerpts"))
        return best.join(shown, ["query_id", "file_id"]).orderBy("query_id", "rank")
