"""Ignore rules as predicates on path columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a folder of work usually holds that nobody searches; a list given instead replaces it.
USUAL = (
    ".git/", ".hg/", ".svn/", "node_modules/", "bower_components/", "vendor/", "dist/", "build/", "out/", "target/", "coverage/", "__pycache__/", ".venv/", "venv/", ".tox/", ".nox/", ".cache/", ".gradle/", ".idea/",
    ".vscode/", ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", ".ipynb_checkpoints/", ".next/", ".nuxt/", ".terraform/", "tmp/", "temp/", "*.pyc", "*.class", "*.o", "*.so", "*.dll", "*.exe", "*.jar", "*.min.js",
    "*.min.css", "*.map", "*.lock", "package-lock.json", "*.zip", "*.tar", "*.gz", "*.7z", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.webp", "*.ico", "*.pdf", "*.mp3", "*.mp4", "*.woff", "*.woff2", "*.ttf", "*.sqlite",
    "*.parquet", "*.swp", ".DS_Store", "Thumbs.db", ".env", ".env.*", "*.pem", "*.key",
)


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: `*` and `?` stay within a segment, `**` does not; what lies below a match matches."""
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.sub(r"([|\\{}()\[\]^$+.])", r"\\\1", part)
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a file's path (root-relative, with slashes) falls under a rule.

    Rules without a slash match at any depth; those that end in one match directories, and so the files below them. Blank rules
    and those after `#` say nothing. Whatever lies in a .git directory is ignored always.
    """
    rules = [r"^(?:.*/)?\.git(?:/.*)?$"]
    for raw in (p.strip() for p in patterns):
        if not raw or raw.startswith("#"):
            continue
        folder = raw.endswith("/")
        glob = re.sub(r"^(\./|/)", "", raw.replace("\\", "/").rstrip("/") if folder else raw.replace("\\", "/"))
        body = glob_pattern(glob if "/" in glob else f"**/{glob}")
        rules.append(f"^{body}/.*$" if folder else f"^{body}(?:/.*)?$")
    return path.rlike("|".join(f"(?:{r})" for r in rules))
