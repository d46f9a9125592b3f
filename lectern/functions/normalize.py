"""Field normalisation as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: marks that surround fields, words around version numbers, the form of a URL, company words, addresses after companies
FIELD_MARKS = "()[],;.’“\""
VERSION_HEAD = r"(?i)^(ver-?sions?|ver|v|releases?|build)\s?\.?\s?"
VERSION_TAIL = r"(?i)(versions?|ver|releases?)$"
URL = r"(?i)((https?|ftp)\s?:\s?//\s?[-A-Z0-9+&@#/%?=~_()|!:,.;\s]*[-A-Z0-9+&@#/%=~_()|])"
COMPANY = r"(?i)^(.*?(incorporated|inc|corporation|corp|ltd)\s?\.?)"
ADDRESSES = (
    ", Berkley, CA",
    ", Santa Clara, CA, USA",
    ", San Jose, CA, USA",
    ", San Jose, CA",
    ", Oxford, UK",
    ", Cuper- tino, CA",
    ", Cupertino, CA",
    ", Palo Alto, CA",
    ", Foster City, CA, U.S.A",
    ", Sint-Martens-Latem, Belgium",
    ", Carlsbad, CA, USA",
    ", Milwaukee, WI, USA",
    "Budapest, Hungary",
    ", Amsterdam, The Netherlands",
    ", Vienna, Austria",
    ",Milwaukee",
    ", Mülheiman der Ruhr",
    ", La Jolla, CA, USA",
    ", La Jolla, CA",
    ", San Diego, CA, USA",
    ", San Diego. CA",
    ", Armonk, NY, USA",
    ", Armonk, N.Y",
    ", Armonk, NY",
    ", Armonk,NY",
    ", Chi- cago, Ill., USA",
    ", Malvern, UK",
    ", Natick, MA",
    ", London, UK",
    ", Martinsried, Germany",
    ", Seattle, WA",
    ", Houston, TX",
    ", Northhampton, MA",
    ", Sunnyvale, CA, USA",
    ", Sunnyvale, CA",
    ", Northampton, MA, U.S.A",
    ", Northampton, MA, USA",
    ", Walnut,CA, USA",
    ", Cary, NorthCarolina, USA",
    ", Cary, North Carolina, USA",
    ", Cary, NC",
    " (Cary,NC, USA",
    ", Cary, NC, USA",
    ", Cary, NC\t",
    ",Cary, NC, USA",
    ", Chicago, IL",
    "San Jose, CA",
    ", Tulsa, OK, USA",
    ", Texas, USA",
    ", Texas USA",
    ", Milan, Italy",
    ", Loughborough, UK",
    ", Carlsbad, CA",
    ", St Louis, MO, USA",
    ", Bethesda, Maryland, USA",
    ", Tokyo, Japan",
    ", Copenhagen, Denmark",
    ", France",
    ", USA",
    " USA",
    ", CA",
)


def squeeze(c: Column) -> Column:
    """White space, the no-break and wide kinds too, to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\x{85}\p{Z}]+", " "))


def strip_chars(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


def _blanks(c: Column, breaks: str = r"\n") -> Column:
    """Line breaks and blanks of other widths as blanks, runs of blanks once, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, rf"[{breaks}\x{{85}}\p{{Z}}]", " "), " +", " "), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def version(c: Column) -> Column:
    """Without brackets, the word for version on either side, and dots at the ends."""
    t = strip_chars(_blanks(c), "()[]")
    t = F.regexp_replace(F.regexp_replace(t, VERSION_HEAD, ""), VERSION_TAIL, "")
    return _blanks(strip_chars(t, "."))


def url(c: Column) -> Column:
    """The first URL, without blanks; a value without one loses its surrounding marks only."""
    t = strip_chars(_blanks(c), FIELD_MARKS)
    found = F.regexp_extract(t, URL, 1)
    return F.when(found != "", F.replace(found, F.lit(" "), F.lit(""))).otherwise(t)


def creator(c: Column, addresses: tuple[str, ...] = ADDRESSES) -> Column:
    """Up to the first company word, even inside a longer word, and without the known addresses at the end, one after the other."""
    t = strip_chars(_blanks(c, r"\n\t"), FIELD_MARKS)
    head = F.regexp_extract(t, COMPANY, 1)
    t = F.when(head != "", head).otherwise(t)
    t = F.aggregate(F.array(*map(F.lit, addresses)), t, lambda x, a: F.when(F.endswith(x, a), F.replace(x, a, F.lit(""))).otherwise(x)) if addresses else t
    return F.regexp_replace(t, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def software_name(c: Column) -> Column:
    return _blanks(strip_chars(_blanks(c), FIELD_MARKS))


def signature(c: Column) -> Column:
    """Lower case first, then ASCII letters and digits only; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def simplified(c: Column) -> Column:
    """ASCII letters and digits in lower case; null gives ''."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9]", ""))


def simplified_letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z]", ""))


def clean_value(c: Column) -> Column:
    """Trim, one quote off each end, squeeze."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.trim(F.translate(c, "\n", " ")), '^"', ""), '"$', ""))


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")


def strip_markup(c: Column) -> Column:
    t = F.regexp_replace(c, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def context(c: Column) -> Column:
    """Join words hyphenated over a line break, then squeeze."""
    return squeeze(F.regexp_replace(c, r"([a-z])-\n([a-z])", "$1$2"))


def stable_key(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 10)


def source_guess(c: Column) -> Column:
    return F.when(c.startswith("PMC"), "pmc").when(c.startswith("hal-"), "hal").when(c.startswith("10."), "doi").when(F.lower(c).startswith("arxiv"), "arxiv").otherwise("unknown")
