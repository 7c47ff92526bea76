"""Texts as vectors: providers that need no model files, and pooling of a model's token vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunks import count_tokens

#: Word stems of like meaning, a dimension each; any word that begins with one counts. Others can be given to the provider.
CONCEPTS = (
    ("retr", "attempt", "again", "resend"),
    ("wait", "pause", "delay", "backoff", "jitter"),
    ("fail", "fault", "error", "broken", "transient"),
    ("pay", "charg", "bill", "invoice"),
    ("once", "twice", "duplicat", "idempoten"),
    ("tls", "certificat", "handshake"),
    ("limit", "deadline", "timeout", "expire"),
)


@dataclass(frozen=True)
class Profile:
    """Which model it is, how it wants its inputs, and how many tokens of them go to it at once."""

    max_tokens: int = 512
    batch_rows: int = 256
    batch_tokens: int = 65_536  # rows of a batch times its longest
    document_prefix: str = ""
    query_prefix: str = ""
    suffix: str = ""
    native_dimension: int | None = None  # before vectors are cut; None: as the provider's
    revision: str = "1"
    version: int = 1
    pooling: str = "mean-v1"
    tokenizer: str = "unicode-v1"
    provenance: str = "built-in"
    license: str = ""
    device: str = "cpu"
    quantization: str = "none"
    normalization: str = "l2"

    def __post_init__(self):
        if min(self.max_tokens, self.batch_rows, self.batch_tokens) < 1:
            raise ValueError("a profile's numbers must be positive")

    def identity(self) -> dict[str, object]:
        """What an index depends on: all but the sizes of batches and the longest input."""
        names = ("native_dimension", "revision", "version", "pooling", "document_prefix", "query_prefix", "suffix", "tokenizer", "provenance", "license", "device", "quantization", "normalization")
        return {name: getattr(self, name) for name in names}

    def composed(self, text: str, query: bool = False) -> str:
        return (self.query_prefix if query else self.document_prefix) + text + self.suffix

    def batches(self, counts: Sequence[int]) -> Iterator[range]:
        """Consecutive texts of these token counts, as many as both bounds allow; a text too large for them goes alone."""
        first, longest = 0, 0
        for place, count in enumerate(counts):
            longest = max(longest, count)
            if place > first and (place - first == self.batch_rows or longest * (place - first + 1) > self.batch_tokens):
                yield range(first, place)
                first, longest = place, count
        if first < len(counts):
            yield range(first, len(counts))


class Provider(Protocol):
    name: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class DigestProvider:
    """Vectors drawn from a text's SHA-256: equal texts are equal, others unrelated."""

    def __init__(self, dimension: int = 32):
        self.name, self.dimension = f"sha256-{dimension}", dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        raw = [np.resize(np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8), self.dimension) / 127.5 - 1 for t in texts]
        return unit_rows(np.array(raw).reshape(len(texts), self.dimension))


class ConceptProvider:
    """32 dimensions: shares of a text's words that begin with a stem of each list, and of its words by hash."""

    name, dimension = "concepts-32", 32

    def __init__(self, concepts: tuple[tuple[str, ...], ...] = CONCEPTS, emphasis: float = 8.0):
        self.concepts, self.emphasis = concepts, emphasis

    def embed(self, texts: list[str]) -> np.ndarray:
        return unit_rows(np.stack([self._one(re.findall(r"\w+", text.lower())) for text in texts]) if texts else np.zeros((0, self.dimension)))

    def _one(self, words: list[str]) -> np.ndarray:
        known = np.array([sum(word.startswith(stems) for word in words) for stems in self.concepts], float)
        spread = self.dimension - len(known)
        places = [int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % spread for w in words]
        single = np.bincount(places, minlength=spread).astype(float) if words else np.zeros(spread)
        both = np.concatenate([self.emphasis * np.sqrt(known), np.sqrt(single)])
        return both if both.any() else np.eye(self.dimension)[-1]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    if not np.isfinite(rows).all() or (norms <= 1e-12).any():
        raise ValueError("a vector is zero or not finite")
    return rows / norms


def pooled(tokens: np.ndarray, mask: np.ndarray, how: str = "mean", size: int | None = None) -> np.ndarray:
    """Unit vectors of texts from token vectors (texts x tokens x dimensions): their mean, first or last active token, cut to size."""
    active = mask.astype(bool)
    if not active.any(axis=1).all():
        raise ValueError("a text has no active token")
    row = np.arange(len(tokens))
    if how == "mean":
        rows = (tokens * active[:, :, None]).sum(axis=1) / active.sum(axis=1, keepdims=True)
    elif how == "cls":
        rows = tokens[row, active.argmax(axis=1)]
    elif how == "last":
        rows = tokens[row, active.shape[1] - 1 - active[:, ::-1].argmax(axis=1)]
    else:
        raise ValueError(f"unknown pooling: {how}")
    return unit_rows(rows[:, : size or rows.shape[1]])


TOO_LONG, FAILED = "EMBEDDING_INPUT_TOO_LONG", "EMBEDDING_FAILED"


def embedded_or_why(text: Column, provider: Provider, profile: Profile = Profile()) -> Column:
    """struct<vector: array<float>, why: string> of each text; a text that gets no vector has a reason, and its neighbours do not.

    A text of more tokens than the profile's model takes is not cut and does not reach the provider. A batch that the provider
    refuses is halved until the texts that it refuses are alone.
    """

    @F.pandas_udf("struct<vector: array<float>, why: string>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def vectors(texts: list[str]) -> list[tuple]:
            try:
                return [(v.astype(np.float32), None) for v in checked(provider, texts)]
            except Exception as error:
                if len(texts) == 1:
                    return [(None, f"{FAILED}: {type(error).__name__}")]
                half = len(texts) // 2
                return vectors(texts[:half]) + vectors(texts[half:])

        for column in parts:
            texts = [profile.composed(t or "") for t in column]
            counts = [count_tokens(t) for t in texts]
            fine = [k for k, n in enumerate(counts) if n <= profile.max_tokens]
            made: list[tuple] = [(None, TOO_LONG)] * len(texts)
            for some in profile.batches([counts[k] for k in fine]):
                places = fine[some.start : some.stop]
                for k, found in zip(places, vectors([texts[k] for k in places])):
                    made[k] = found
            yield pd.DataFrame({"vector": pd.Series([v for v, _ in made], dtype=object), "why": pd.Series([w for _, w in made], dtype=object)})

    return embed(text)


def embedded(text: Column, provider: Provider, profile: Profile = Profile()) -> Column:
    """array<float> of each text; null for one that gets no vector (see embedded_or_why)."""
    return embedded_or_why(text, provider, profile)["vector"]


def checked(provider: Provider, texts: list[str]) -> np.ndarray:
    rows = np.asarray(provider.embed(texts), np.float64)
    if rows.shape != (len(texts), provider.dimension) or (np.abs(np.linalg.norm(rows, axis=1) - 1) > 1e-3).any():
        raise ValueError("the provider's vectors have a wrong shape or length")
    return rows
