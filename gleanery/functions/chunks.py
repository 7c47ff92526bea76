"""Units packed into chunks of a bounded number of tokens."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig
from .text import enriched, unicode_token_count

_WORD_OR_SIGN = re.compile(r"\w+|[^\w\s]")
PIECE = "array<struct<display_text:string,search_text:string,start_line:int,end_line:int,start_offset:long,end_offset:long,heading_trail:array<string>,symbols:array<string>>>"


def count_tokens(text: str) -> int:
    """Words and other visible characters, plus two."""
    return len(_WORD_OR_SIGN.findall(text)) + 2


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By code point: 0 white space, 1 a sign, 2 of a word."""
    every, kinds = "".join(map(chr, range(0x110000))), np.ones(0x110000, np.uint8)
    for pattern, kind in ((r"\s+", 0), (r"\w+", 2)):
        for m in re.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def part_counts(text: str) -> Callable[[int, int], int]:
    """`count_tokens` of the text's parts by their places, from running totals of the places where a word or sign begins."""
    kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    goes_on = np.zeros(len(kinds) + 1, bool)
    goes_on[1:-1] = (kinds[1:] == 2) & (kinds[:-1] == 2)
    begun = np.concatenate([[0], np.cumsum((kinds > 0) & ~goes_on[:-1])])
    return lambda a, b: int(begun[b] - begun[a] + goes_on[a]) + 2 if a < b else 2


class Packer:
    """Packs one document's units. `head` tokens stand before each text for its place; `count` counts a text's tokens.

    Words and signs add up over texts, so for `count_tokens` a text is read once and its parts are counted by their places.
    """

    def __init__(self, path: str, language: str, config: IndexConfig, count: Callable[[str], int] = count_tokens):
        self.path, self.language, self.config = path, language, config
        self.additive = count is count_tokens
        self.count = lru_cache(4096)(count)

    def _head(self, trail: list[str], symbols: list[str]) -> str:
        lines = [f"Path: {self.path}", f"File: {self.path.rpartition('/')[2]}", f"Format: {self.language}"]
        if trail:
            lines.append("Heading: " + " > ".join(h or "" for h in trail))
        if symbols:
            lines.append("Symbol: " + ", ".join(symbols))
        return "\n".join(lines) + "\n\n"

    def full(self, unit: dict, text: str | None = None) -> int:
        head, text = self._head(unit["heading_trail"], unit["symbols"]), unit["search_text"] if text is None else text
        return self.count(head) + count_tokens(text) - 2 if self.additive else self.count(head + text)

    def _counts(self, text: str) -> Callable[[int, int], int]:
        """Counts of the text's parts by their places."""
        return part_counts(text) if self.additive else lambda a, b: self.count(text[a:b])

    def _fulls(self, unit: dict, counts: Callable[[int, int], int]) -> Callable[[int, int], int]:
        """`full` of parts of the unit's text by their places."""
        text = unit["search_text"]
        if not self.additive:
            return lambda a, b: self.full(unit, text[a:b])
        head = self.count(self._head(unit["heading_trail"], unit["symbols"])) - 2
        return lambda a, b: head + counts(a, b)

    def _cut(self, text: str, start: int, full: Callable[[int, int], int]) -> int:
        """Where the longest text from `start` that fits ends: at white space if that lies in its last two fifths."""
        limit = self.config.chunk_size_tokens
        reach = 8 * limit  # counts grow with the text, so only as much as may fit is ever counted
        while start + reach < len(text) and full(start, start + reach) <= limit:
            reach *= 2
        places = range(start + 1, min(len(text), start + reach) + 1)
        end = start + bisect_right(places, limit, key=lambda e: full(start, e))
        if end == start:
            return start + 1
        if end < len(text):
            gap = end
            while gap > start and not text[gap - 1].isspace():
                gap -= 1
            while gap > start and text[gap - 1].isspace():
                gap -= 1
            if gap - start > floor(0.6 * (end - start)):
                return gap
        return end

    def _resume(self, text: str, start: int, end: int, counts: Callable[[int, int], int]) -> int:
        """Where the next piece begins, so that it repeats as much of this one as the overlap allows, from a word's start."""
        room = self.config.chunk_overlap_tokens
        if room <= 0 or end - start <= 1:
            return end
        places = range(end, start, -1)
        fits = bisect_right(places, room, key=lambda m: counts(m, end))
        best = places[fits - 1] if fits else end
        space = text.find(" ", best, end)
        return space + 1 if space >= 0 else best

    def split(self, unit: dict) -> Iterator[dict]:
        """The unit, or overlapping parts of it that fit; places are those of the parts by proportion."""
        text = unit["search_text"]
        counts = self._counts(text)
        full = self._fulls(unit, counts)
        if full(0, len(text)) <= self.config.chunk_size_tokens:
            yield unit
            return
        width, height, shown = unit["end_offset"] - unit["start_offset"], unit["end_line"] - unit["start_line"], unit["display_text"]
        start = 0
        while True:
            while start < len(text) and text[start].isspace():
                start += 1
            if start >= len(text):
                return
            end = self._cut(text, start, full)
            a, b = start / len(text), end / len(text)
            piece = text[start:end].strip()
            yield unit | {
                "search_text": piece, "display_text": shown[floor(len(shown) * a) : ceil(len(shown) * b)].strip() or piece,
                "start_line": unit["start_line"] + floor(height * a), "end_line": unit["start_line"] + ceil(height * b),
                "start_offset": unit["start_offset"] + floor(width * a), "end_offset": unit["start_offset"] + ceil(width * b),
            }
            if end >= len(text):
                return
            following = self._resume(text, start, end, counts)
            start = following if following > start else end

    @staticmethod
    def merged(parts: list[dict]) -> dict:
        symbols = dict.fromkeys(s for p in parts for s in p["symbols"])
        return {
            "display_text": "\n\n".join(p["display_text"] for p in parts), "search_text": "\n\n".join(p["search_text"] for p in parts),
            "start_line": min(p["start_line"] for p in parts), "end_line": max(p["end_line"] for p in parts),
            "start_offset": min(p["start_offset"] for p in parts), "end_offset": max(p["end_offset"] for p in parts),
            "heading_trail": parts[-1]["heading_trail"], "symbols": list(symbols),
        }

    def pack(self, units: list[dict]) -> list[dict]:
        """Chunks: as many consecutive parts under the same headings as fit, each chunk repeating whole parts of the one before."""
        parts = [part for unit in units if unit["search_text"].strip() for part in self.split(unit)]
        sizes = [self._counts(part["search_text"])(0, len(part["search_text"])) for part in parts]
        chunks, first = [], 0
        while first < len(parts):
            last, size = first + 1, self._together(parts, sizes, first, first + 1)
            while last < len(parts) and parts[last]["heading_trail"] == parts[first]["heading_trail"]:
                more = self._together(parts, sizes, first, last + 1)
                if more > self.config.chunk_size_tokens:
                    break
                last, size = last + 1, more
            if size > self.config.max_tokens:
                raise ValueError(f"chunk {len(chunks)} is larger than the model's limit")
            chunks.append(self.merged(parts[first:last]))
            if last == len(parts):
                break
            again, room = last, self.config.chunk_overlap_tokens
            while again - 1 > first and parts[again - 1]["heading_trail"] == parts[last]["heading_trail"] and sizes[again - 1] <= room:
                room -= sizes[again - 1]
                again -= 1
            first = again
        return chunks

    def _together(self, parts: list[dict], sizes: list[int], first: int, end: int) -> int:
        """`full` of the chunk of parts from first to end."""
        if not self.additive:
            return self.full(self.merged(parts[first:end]))
        symbols = dict.fromkeys(s for p in parts[first:end] for s in p["symbols"])
        return self.count(self._head(parts[first]["heading_trail"], list(symbols))) + sum(sizes[first:end]) - 2 * (end - first)


def chunked(units: DataFrame, config: IndexConfig = IndexConfig(), count: Callable[[str], int] = count_tokens) -> DataFrame:
    """Chunks of documents from their units (file_id, relative_path, format and the columns of a unit), sized by `count`.

    A document's units meet in one row, as a document is packed in order; documents are independent. A document that cannot be
    packed has one row with last_error instead of chunks.
    """
    fields = ["start_offset", "start_line", "end_line", "end_offset", "display_text", "search_text", "heading_trail"]
    symbols = F.when(F.col("symbol").isNull(), F.array().cast("array<string>")).otherwise(F.array("symbol"))
    rows = units.groupBy("file_id", "relative_path", "format").agg(F.array_sort(F.collect_list(F.struct(*fields, symbols.alias("symbols")))).alias("units"))

    @F.pandas_udf(f"struct<pieces:{PIECE},error:string>")
    def pack(paths: pd.Series, formats: pd.Series, listed: pd.Series) -> pd.DataFrame:
        out = []
        for path, fmt, own in zip(paths, formats, listed):
            try:
                plain = [dict(u) | {"heading_trail": list(u["heading_trail"]), "symbols": list(u["symbols"])} for u in own]
                out.append((Packer(path, fmt, config, count).pack(plain), None))
            except ValueError as error:
                out.append(([], f"CHUNKING_FAILED: {error}"))
        return pd.DataFrame(out, columns=["pieces", "error"])

    packed = rows.withColumn("packed", pack("relative_path", "format", "units")).select("file_id", "relative_path", "format", F.col("packed.error").alias("last_error"), F.posexplode_outer("packed.pieces").alias("ordinal", "piece"))
    made = packed.select("file_id", "relative_path", "format", "last_error", "ordinal", "piece.*")
    search = enriched(F.col("relative_path"), F.col("format"), F.col("heading_trail"), F.col("symbols"), F.col("search_text"))
    made = made.withColumn("search_text", search).withColumn("token_count", unicode_token_count(F.col("search_text"))).withColumn("content_hash", F.sha2("display_text", 256))
    place = F.concat(F.col("start_line").cast("string"), F.lit(":"), F.col("end_line").cast("string"), F.lit(":"), F.array_join("heading_trail", "/", ""), F.lit(":"), F.array_join("symbols", ","))
    key = F.concat(F.lit(f"chunk-v{config.chunker_version}\0"), "file_id", F.lit("\0"), place, F.lit("\0"), "content_hash")
    return made.withColumn("chunk_id", F.sha2(key, 256))
