"""Small values: keys, flags and forms of single fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.tokens import tokenize


def retokenized(tokens: Column) -> Column:
    """Every token cut further by the tokenizer; joined they are the same text."""
    return F.flatten(F.transform(tokens, tokenize))


def component_form(c: Column) -> Column:
    """A component's normal form: line breaks as blanks, blanks once."""
    return F.trim(F.regexp_replace(F.translate(c, "\n", " "), " +", " "))


def valid_xml(c: Column) -> Column:
    """Without the characters that XML 1.0 has no place for."""
    return F.regexp_replace(c, r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def arity(name: Column, creator: Column, version: Column, date: Column, url: Column) -> Column:
    """How many of name, creator, version or date, and URL there are."""
    return sum(x.cast("int") for x in (name.isNotNull(), creator.isNotNull(), version.isNotNull() | date.isNotNull(), url.isNotNull()))


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin("1", "true"), F.lit(False))


def concept_url(host: Column, port: Column, prefix: str = "/nerd") -> Column:
    """The address of the concept service: a named scheme is kept, else port 443 means https; ports 80 and 443 and none are left out;
    a host without a path gets the prefix."""
    bare = F.regexp_replace(host, "^https?://", "")
    scheme = F.when(host.startswith("https://") | (port == "443"), "https://").otherwise("http://")
    tail = F.when(port.isNull() | port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.when(bare.contains("/"), "").otherwise(prefix)
    return F.concat(scheme, bare, tail, path)


def scaled_certainty(c: Column) -> Column:
    """A whole number of tenths as a decimal."""
    return F.when(c.isNotNull(), F.format_string("%.1f", c / 10))
