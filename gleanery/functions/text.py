"""Columns over text: terms, phrases, token counts, identities and matches. All but `anchor_id` are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import FIELD_WEIGHTS, KIND_WEIGHTS

TERM = r"[\p{L}\p{N}]+"
QUERY_TERM = r"[\p{L}\p{N}_./:@-]+"
PHRASE = r'"([^"\r\n]+)"'
WORD_OR_SIGN = r"[\p{L}\p{N}_]+|[^\s]"
#: What JavaScript trims.
WHITE = " \t\n\v\f\r\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# File extensions with their formats and MIME families.
EXTENSIONS = {
    ".md": ("markdown", "text/markdown"), ".mdx": ("markdown", "text/markdown"), ".markdown": ("markdown", "text/markdown"),
    ".html": ("html", "text/html"), ".htm": ("html", "text/html"), ".py": ("python", "text/x-python"),
    ".js": ("javascript", "text/javascript"), ".jsx": ("javascript", "text/javascript"), ".mjs": ("javascript", "text/javascript"), ".cjs": ("javascript", "text/javascript"),
    ".ts": ("typescript", "text/typescript"), ".tsx": ("typescript", "text/typescript"), ".mts": ("typescript", "text/typescript"), ".cts": ("typescript", "text/typescript"),
    ".json": ("json", "application/json"), ".jsonc": ("json", "application/json"), ".yaml": ("yaml", "application/yaml"), ".yml": ("yaml", "application/yaml"), ".toml": ("toml", "application/toml"),
    ".css": ("stylesheet", "text/css"), ".scss": ("stylesheet", "text/x-scss"), ".sass": ("stylesheet", "text/x-sass"), ".less": ("stylesheet", "text/x-less"),
    ".sh": ("shell", "text/x-shellscript"), ".bash": ("shell", "text/x-shellscript"), ".zsh": ("shell", "text/x-shellscript"),
    ".sql": ("sql", "application/sql"), ".xml": ("xml", "application/xml"), ".csv": ("csv", "text/csv"), ".txt": ("text", "text/plain"), ".log": ("text", "text/plain"),
}


def js_trim(text: Column) -> Column:
    """Without white space at either end, no-break spaces and byte-order marks included."""
    return F.btrim(text, F.lit(WHITE))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def quoted_phrases(query: Column) -> Column:
    """Distinct non-blank phrases in double quotes, in order."""
    found = F.transform(F.regexp_extract_all(query, F.lit(PHRASE), F.lit(1)), js_trim)
    return F.array_distinct(F.filter(found, lambda p: p != ""))


def unquoted(query: Column) -> Column:
    """The query without its quoted phrases."""
    return js_trim(F.regexp_replace(query, PHRASE, " "))


def _first_of_each(values: Column) -> Column:
    """Values of two characters or more, the first of those that differ in case only. One fold: values are made once."""
    none = F.array().cast("array<string>")

    def step(held: Column, value: Column) -> Column:
        known = (F.length(value) < 2) | F.array_contains(held["seen"], F.lower(value))
        return F.when(known, held).otherwise(F.struct(F.array_append(held["seen"], F.lower(value)).alias("seen"), F.array_append(held["kept"], value).alias("kept")))

    return F.aggregate(values, F.struct(none.alias("seen"), none.alias("kept")), step)["kept"]


def query_terms(query: Column) -> Column:
    """Phrases, then terms."""
    return _first_of_each(F.concat(quoted_phrases(query), F.regexp_extract_all(query, F.lit(QUERY_TERM), F.lit(0))))


def metadata_terms(query: Column) -> Column:
    """The whole query without quotes, then phrases and terms."""
    whole = F.array(js_trim(F.regexp_replace(query, PHRASE, "$1")))
    return _first_of_each(F.concat(whole, quoted_phrases(query), query_terms(query)))


def unicode_token_count(text: Column) -> Column:
    """Words and other visible characters, plus two for the special tokens around them."""
    return F.regexp_count(text, F.lit(WORD_OR_SIGN)) + 2


def extension(filename: Column) -> Column:
    """The last extension in lower case; none for names such as .bashrc."""
    return F.lower(F.regexp_extract(filename, r"[^/](\.[^./]*)$", 1))


def format_of(ext: Column, default: str | None = None) -> Column:
    found = F.lit(default).cast("string")
    for name in sorted({f for f, _ in EXTENSIONS.values()}):
        found = F.when(ext.isin([e for e, (f, _) in EXTENSIONS.items() if f == name]), name).otherwise(found)
    return found


def mime_of(ext: Column, default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for e, (_, m) in EXTENSIONS.items() for x in (e, m)])
    return F.coalesce(F.element_at(table, ext), F.lit(default))


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]+$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def root_identity(path: Column) -> Column:
    return F.sha2(F.concat(F.lit("canonical-root-v1\0"), path), 256)


def file_id(root: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.lit("file-v1\0"), root, F.lit("\0"), path), 256)


def utf8_edits(one: Column, other: Column) -> Column:
    """Edits between two texts, counted in bytes of UTF-8: never fewer than in characters."""
    as_letters = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(as_letters(one), as_letters(other))


def match_kind(value: Column, term: Column, max_distance: int = 2, in_bytes: bool = False) -> Column:
    """exact, prefix, substring or fuzzy, the first that holds regardless of case; else null.

    Fuzzy: some part of the value is within one edit (two for terms over four characters) of the whole term. in_bytes: edits are
    counted in bytes of UTF-8, not in characters.
    """
    edits = utf8_edits if in_bytes else F.levenshtein
    v, t = F.lower(value), F.lower(term)
    allowed = F.when(F.length(t) <= 4, min(1, max_distance)).otherwise(min(2, max_distance))
    parts = F.filter(F.split(v, r"[^\p{L}\p{N}_@.\-]+"), lambda p: p != "")
    near = F.exists(parts, lambda p: (F.abs(F.length(p) - F.length(t)) <= allowed) & (edits(p, t) <= allowed))
    return F.when(v == t, "exact").when(F.startswith(v, t), "prefix").when(F.contains(v, t), "substring").when((allowed > 0) & near, "fuzzy")


def strength(field: Column, kind: Column) -> Column:
    """The product of the field's and the kind's weight."""
    fields = F.create_map(*[F.lit(x) for pair in FIELD_WEIGHTS.items() for x in pair])
    kinds = F.create_map(*[F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair])
    return F.element_at(fields, field) * F.element_at(kinds, kind)


def highlight_terms(wanted: Column, text: Column) -> Column:
    """The terms that the text holds, regardless of case."""
    return F.filter(wanted, lambda t: F.contains(F.lower(text), F.lower(t)))


def enriched(path: Column, language: Column, headings: Column, symbols: Column, text: Column) -> Column:
    """The text with the lines that say where it stands, as it is embedded and searched."""
    head = F.when(F.size(headings) > 0, F.concat(F.lit("Heading: "), F.array_join(headings, " > ", "")))
    named = F.when(F.size(symbols) > 0, F.concat(F.lit("Symbol: "), F.array_join(symbols, ", ")))
    lines = F.concat_ws("\n", F.concat(F.lit("Path: "), path), F.concat(F.lit("File: "), basename(path)), F.concat(F.lit("Format: "), language), head, named)
    return F.concat(lines, F.lit("\n\n"), text)


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def anchor_id(heading: Column) -> Column:
    """A heading as the fragment that links to it: letters and digits in lower case, words joined by hyphens."""
    kept = F.regexp_replace(F.lower(_decomposed(heading)), r"[^\p{L}\p{N}\s-]", "")
    return F.regexp_replace(js_trim(kept), r"[\s-]+", "-")


def anchor_safe(pattern: str) -> str | None:
    """Why a regular expression is refused for searching in files; None if it is fine."""
    import re

    if len(pattern) > 512:
        return "the pattern is longer than 512 characters"
    if re.search(r"\\[1-9]", pattern):
        return "back-references are not supported"
    if re.search(r"\([^()]*[+*}][^()]*\)[+*{]", pattern):
        return "nested repetition is not supported"
    try:
        re.compile(pattern)
    except re.error as error:
        return f"not a regular expression: {error}"
    return None


def link_kind(target: Column) -> Column:
    """`fragment` for places in the same text, `external` for web addresses, `blocked` for all else, relative paths included."""
    t = js_trim(F.coalesce(target, F.lit("")))
    return F.when(t.rlike(r"^#\S*$"), "fragment").when(t.rlike(r"(?i)^https?://[^/\s]"), "external").otherwise("blocked")


def step_match(current: Column, count: Column, step: int) -> Column:
    """The match after (step 1) or before (-1) the current one, around both ends; from none the first or last; -1 if there are none."""
    start = F.lit(0) if step > 0 else count - 1
    return F.when(count <= 0, -1).when(current < 0, start).otherwise(F.pmod(current + step, F.greatest(count, F.lit(1))))
