"""One writing for keys that come in several: corpus keys, DOIs, PMC numbers, authors. Null words give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: null words
NULL_WORDS = ("", "na", "n/a", "none", "null", "nan", "-", "--", "no label", "unknown")


def _known(c: Column) -> Column:
    """Trimmed lower-case text; null for null words."""
    t = F.lower(F.regexp_replace(c.cast("string"), r"^[\s\x{A0}\x{200B}\x{FEFF}]+|[\s\x{A0}\x{200B}\x{FEFF}]+$", ""))
    return F.when(~t.isin(*NULL_WORDS), t)


def _full(c: Column) -> Column:
    return F.when(c != "", c)


def corpus_key(c: Column) -> Column:
    return _full(F.regexp_replace(_known(c), r"[^0-9a-z]", ""))


def doi_key(c: Column) -> Column:
    """From the directory indicator on, percent-decoded, without closing marks."""
    t = F.regexp_replace(F.regexp_replace(_known(c), "%2f", "/"), "%3a", ":")
    return _full(F.regexp_replace(F.regexp_extract(F.regexp_replace(t, r"\s", ""), r"(10\.\d{4,9}/.+)$", 1), r"[./,;:)\]]+$", ""))


def pmc_key(c: Column) -> Column:
    return _full(F.regexp_replace(F.regexp_extract(F.regexp_replace(_known(c), r"[^0-9a-z]", ""), r"(\d+)$", 1), "^0+", ""))


def author_key(c: Column) -> Column:
    return _full(F.regexp_replace(_known(c), r"[^\p{L}\p{N}]", ""))
