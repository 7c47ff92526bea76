"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams, most frequent first. A document goes to the language whose
profile is at the least out-of-place distance: the sum, over the document's n-grams, of how far apart their ranks are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_broadcast, read_table, sampled_by_group, written

UNDETERMINED = "und"
_GAP = 1  # stands for what is no letter; no letter has this code point


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of letters; words are padded with one gap on each side, and no n-gram crosses a gap."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    line = np.full(len(points) + 2, _GAP, np.int64)
    line[1:-1] = np.where(letter, points, _GAP)
    line = line[np.r_[True, (line[1:] != _GAP) | (line[:-1] != _GAP)]]
    two = (line[:-1] << 21) | line[1:]
    three = (two[:-1] << 21) | line[2:]
    return np.concatenate([line[line != _GAP], two, three[line[1:-1] != _GAP]])


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent codes, most frequent first, ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.lexsort((found, -counts))[:size]]


class RankProfiles:
    """Profiles of all languages as one table of ranks."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.languages, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([np.asarray(p, np.int64) for p in profiles.values()] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)  # the last row: in no profile
        for k, language in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, np.asarray(profiles[language], np.int64)), k] = np.arange(len(profiles[language]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and 1 - distance / greatest possible distance."""
        own = ranked(ngrams(text), self.size)
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], 1 - apart[best] / (self.size * len(own))


def remainder(id_col: Column, modulus: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def _usable(docs: DataFrame, held_out: Column | None, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows (id, lang, text) that may be learnt from."""
    usable = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    return docs.where(usable if held_out is None else usable & ~held_out).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def _learnt_from(docs: DataFrame, docs_per_language: int, max_languages: int | None, held_out: Column | None, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, lang, text) to learn from, and the ids and languages chosen among them."""
    pool = _usable(docs, held_out, id_col, text_col, lang_col)
    ids = pool.select("id", "lang").distinct()
    if max_languages is not None:
        ids = ids.join(pool.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).select("lang"), "lang", "left_semi")
    return pool, few_broadcast(written(sampled_by_group(ids, "lang", F.lit(docs_per_language)), "chosen"))


def fit_profiles(docs: DataFrame, size: int = 300, docs_per_language: int = 500, max_languages: int | None = None, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> RankProfiles:
    """Profiles from at most `docs_per_language` documents of each language, the first by a hash of their id.

    Every language in the column is learnt, however many there are: the model has `size` codes of each. Only a caller that names
    `max_languages` gets no more than so many, the most frequent ones (ties by name).

    Only ids and labels are read to choose them; n-grams are counted where the texts are. Rows with a null id, text or label
    are not learnt from. The driver receives `size` codes a language.
    """
    pool, chosen = _learnt_from(docs, docs_per_language, max_languages, held_out, id_col, text_col, lang_col)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                codes, n = np.unique(np.concatenate([ngrams(text) for text in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    counted = pool.join(chosen, ["id", "lang"], "left_semi").select("lang", "text").mapInPandas(counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).select("lang", "code", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.rank)):
        profiles.setdefault(row.lang, []).append(row.code)
    return RankProfiles(profiles, size)


def predicted(spark: SparkSession, text: Column, profiles: RankProfiles) -> Column:
    """struct<lang_pred, score> of a text."""
    model = spark.sparkContext.broadcast(profiles)  # bounded: `size` codes a language

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.value.predict(x if isinstance(x, str) else None) for x in texts], columns=["lang_pred", "score"])

    return predict(text)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred and score.

    held_out: crc32 of the id as text, modulo 4, is 2, or the id is null; such rows are never learnt from. A text that is null
    or has no letter is `und` with score 0, as is every text if there is nothing to learn from. Whole texts count. Repeated
    rows come out as often as they went in; other columns of docs are ignored.
    """
    held_out = F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(True))
    profiles = fit_profiles(docs, held_out=held_out, id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = predicted(docs.sparkSession, F.col(text_col), profiles)
    return docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.*")


#: Scores are counted in so many steps of equal size.
STEPS = 10_000


def least_score(docs: DataFrame, profiles: RankProfiles, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """Half the score that all but a hundredth of the documents with letters that may be learnt from reach: what is below is like
    no language learnt. All of them are counted, by steps of their score."""
    pool = _usable(docs, held_out, id_col, text_col, lang_col)
    found = pool.select(predicted(docs.sparkSession, F.col("text"), profiles).alias("found")).where(F.col("found.lang_pred") != UNDETERMINED)
    counts = sorted((r.step, r.n) for r in found.groupBy(F.floor(F.col("found.score") * STEPS).alias("step")).agg(F.count("*").alias("n")).collect())
    left = 0.01 * sum(n for _, n in counts)
    for step, n in counts:
        left -= n
        if left <= 0:
            return step / STEPS / 2
    return 0.0


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those of no determinable language: no letters at all, or far from every profile. All others stay unchanged.

    How far is too far follows from all documents that may be learnt from. With nothing to learn from, every text that has letters stays.
    """
    held_out = F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(True))
    profiles = fit_profiles(docs, held_out=held_out, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not profiles.languages:
        return docs.where(_has_letters(F.col(text_col)))
    least = least_score(docs, profiles, held_out=held_out, id_col=id_col, text_col=text_col, lang_col=lang_col)
    mark = "__found_language"
    judged = docs.withColumn(mark, predicted(docs.sparkSession, F.col(text_col), profiles))
    return judged.where((F.col(f"{mark}.lang_pred") != UNDETERMINED) & (F.col(f"{mark}.score") >= least)).drop(mark)


def _has_letters(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def lettered(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ngrams(x if isinstance(x, str) else None)) > 0 for x in texts], dtype=bool)

    return lettered(text)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))
