"""Settings of search and indexing, and requests held against them."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Weights by which fields and kinds of metadata matches count.
FIELD_WEIGHTS = {"filename": 1.0, "path": 0.95, "symbol": 0.9, "heading": 0.7}
KIND_WEIGHTS = {"exact": 1.0, "prefix": 0.8, "substring": 0.65, "fuzzy": 0.35}


class SearchError(ValueError):
    """A request or setting that cannot be served; `code` says which kind."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class SearchConfig:
    default_files: int = 10
    max_files: int = 50
    max_query_units: int = 4096  # UTF-16 code units
    max_formats: int = 20
    vector_candidates: int = 100
    bm25_candidates: int = 100
    metadata_candidates: int = 100
    metadata_chunks_per_file: int = 3
    rrf_k: float = 60.0
    vector_weight: float = 1.0
    bm25_weight: float = 1.0
    metadata_weight: float = 2.0
    excerpts_per_file: int = 3
    supplemental_cap: float = 0.15
    supplemental_decay: float = 0.25
    fuzzy_max_distance: int = 2
    fuzzy_in_bytes: bool = False  # edits of fuzzy matches in bytes of UTF-8, not in characters
    max_distance: float = 0.9
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    max_batch: int = 1000  # queries of a block, whose vectors are one matrix; more are asked block by block
    cell_probes: float = 0.125  # the part of all cells that a vector query looks into

    def __post_init__(self):
        counts = ("default_files", "max_files", "max_query_units", "max_formats", "vector_candidates", "bm25_candidates", "metadata_candidates", "metadata_chunks_per_file", "excerpts_per_file", "max_batch")
        for name in counts:
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise SearchError("SEARCH_CONFIG_INVALID", f"{name} must be a positive whole number")
        if self.default_files > self.max_files:
            raise SearchError("SEARCH_CONFIG_INVALID", "default_files exceeds max_files")
        for name in ("rrf_k", "vector_weight", "bm25_weight", "metadata_weight"):
            if not getattr(self, name) > 0:
                raise SearchError("SEARCH_CONFIG_INVALID", f"{name} must be positive")
        for name in ("supplemental_cap", "supplemental_decay"):
            if not 0 <= getattr(self, name) <= 1:
                raise SearchError("SEARCH_CONFIG_INVALID", f"{name} must lie between 0 and 1")
        if not 0 < self.cell_probes <= 1:
            raise SearchError("SEARCH_CONFIG_INVALID", "cell_probes must lie above 0, up to 1")
        if not 0 <= self.max_distance <= 2 or self.fuzzy_max_distance < 0:
            raise SearchError("SEARCH_CONFIG_INVALID", "distances are out of range")


@dataclass(frozen=True)
class IndexConfig:
    chunk_size_tokens: int = 400
    chunk_overlap_tokens: int = 50
    max_tokens: int = 512
    chunker_version: int = 2
    extractor_version: int = 1
    schema_version: int = 2
    embedding_input_version: int = 1
    cells_from: int = 20_000  # vectors; below, a search compares all of them
    cells_recall: float = 0.95

    def __post_init__(self):
        if self.chunk_size_tokens < 1 or self.max_tokens < 1:
            raise ValueError("token limits must be positive")
        if self.chunk_size_tokens > self.max_tokens:
            raise ValueError("chunks may not be larger than the model's limit")
        if not 0 <= self.chunk_overlap_tokens < self.chunk_size_tokens:
            raise ValueError("the overlap must be smaller than a chunk")


@dataclass(frozen=True)
class SearchRequest:
    query: str
    files: int
    formats: tuple[str, ...]


def utf16_units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def normalize_request(query: str, files: int | None = None, formats: tuple[str, ...] | list[str] = (), config: SearchConfig = SearchConfig()) -> SearchRequest:
    """The request as search takes it; SearchError if it cannot be."""
    text = query.strip("﻿  \t\n\r\v\f")
    if not text:
        raise SearchError("SEARCH_REQUEST_INVALID", "the query is empty")
    if utf16_units(text) > config.max_query_units:
        raise SearchError("SEARCH_REQUEST_INVALID", f"the query is longer than {config.max_query_units}")
    wanted = config.default_files if files is None else files
    if isinstance(wanted, bool) or not isinstance(wanted, int) or not 1 <= wanted <= config.max_files:
        raise SearchError("SEARCH_REQUEST_INVALID", f"ask for 1 to {config.max_files} files")
    kept: dict[str, None] = {}
    for raw in formats:
        name = raw.strip().lower()
        if not re.fullmatch(r"[a-z0-9][a-z0-9+._-]{0,63}", name):
            raise SearchError("SEARCH_REQUEST_INVALID", f"no format: {raw!r}")
        kept[name] = None
    if len(kept) > config.max_formats:
        raise SearchError("SEARCH_REQUEST_INVALID", f"at most {config.max_formats} formats")
    return SearchRequest(text, wanted, tuple(kept))
