"""Visually identical text: confusables skeleton and one consistent form.

skeleton(): decompose (compatibility), drop invisible characters, replace every character by its prototype from the look-alike
table, decompose again. Equal skeletons look alike; originals are grouped by it (``look_alikes``).

``replacements`` are the places where a value differs from its skeleton because a character stands in for another: invisible and odd
space characters, width variants, ligatures, separate accents, and letters of another script that the script of their word and of
the value doesn't account for. A value needed it if it has such a place; canonical() makes these replacements and keeps all else.
Letters whose script leaves it open (a value with letters of another script, all of them in the table) are settled by the group:
they stand in if an ordinary writing, in ASCII, has the same skeleton.

Only values with a character that can be such a place go through Python (``may_need`` is a filter of the JVM); the rest is its own
form. Defined results: null gives null and is no case; empty text is itself; repeated rows count once; texts of any length are read
whole.

The table covers Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu, Tifinagh, Canadian syllabics, Runic and the Latin small
capitals and phonetic letters; fullwidth, mathematical, circled and Roman numeral forms come from Unicode's decompositions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_table

# fixed values: Latin letters and the letters of other scripts that look the same
PROTOTYPES = {
    "A": "ΑАᎪᗅꓮ", "B": "ΒВᏴᗷꓐ", "C": "ϹСᏟⲤꓚ", "D": "Ꭰᗞꓓ", "E": "ΕЕᎬⴹꓰ", "F": "Ϝᖴꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻᕼⲎꓧ", "I": "ΙІӀⲒꓲ", "J": "ͿЈᎫᒍꓙ",
    "K": "ΚКᏦⲔꓗ", "L": "Ꮮᒪꓡ", "M": "ΜМϺᎷᗰⲘꓟ", "N": "ΝⲚꓠ", "O": "ΟОՕⲞꓳ", "P": "ΡРᏢᑭⲢꓑ", "Q": "Ԛⵕ", "R": "ᎡᏒᖇꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢⲦꓔ",
    "U": "Սᑌꓴ", "V": "Ꮩꓦⴸ", "W": "ԜᎳᏔꓪ", "X": "ΧХ᙭Ⲭꓫⵝᚷ", "Y": "ΥУҮⲨᎩꓬ", "Z": "ΖᏃꓜ",
    "a": "аɑ", "c": "сϲᴄⲥ", "d": "ԁ", "e": "е", "g": "ցɡ", "h": "һհ", "i": "іı", "j": "јϳ", "n": "ո", "o": "оοօᴏⲟ", "p": "рⲣ", "q": "ԛգ", "s": "ѕꜱ",
    "u": "սᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уү", "z": "ᴢ",
}
LOOK_ALIKE = {c: latin for latin, cs in PROTOTYPES.items() for c in cs}
TO_CYRILLIC = {"a": "а", "c": "с", "o": "о", "e": "е", "p": "р", "x": "х", "y": "у"}
RUSSIAN = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿"
SPACES = "   -   "
HYPHENS = "‐‑⁃﹣－"


# character classes, in the form that Java and Python share
LATIN, GREEK, CYRILLIC = r"A-Za-z\u00AA\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0250-\u02AF\u1D00-\u1D25\u1E00-\u1EFF", r"\u0370-\u0373\u0376\u0377\u037B-\u037D\u037F\u0386\u0388-\u03FF\u1F00-\u1FFF", r"\u0400-\u052F\u1C80-\u1C88\uA640-\uA69F"
_TABLE = "".join(sorted(LOOK_ALIKE))
_OTHER = "".join(c for c in _TABLE if not re.match(f"[{CYRILLIC}]", c))
_FOREIGN = "".join(c for c in _TABLE if re.match(f"[{CYRILLIC}]", c) and c not in RUSSIAN)
WIDTH = "０-９Ａ-Ｚａ-ｚ･-ￜ￨-￮"
WIDE_MARKS = "　！-／：-＠［-｀｛-､"
FOLDED = r"⺀-⿟豈-\uFAFFﬀ-ﬆﬓ-ﬗﭐ-﷿ﹰ-ﻼⅠ-ⅿK\u212BǄ-ǌǱ-ǳĲĳ"
FAR = r"\U0001d400-\U0001d7ff\U0002f800-\U0002fa1f"
ACCENTS = r"\u0300-\u036F\u0653-\u0655\u3099\u309A"
SINGLE = r"\u0340\u0341\u0374\u037E\u0387\u1FEF\u2126"
CJK = r"\u1100-\u11FF\u3005-\u3007\u3040-\u30FF\u3130-\u318F\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\uFF66-\uFFDC"

_invisible = re.compile(f"[{INVISIBLE}]")
_space = re.compile(f"[{SPACES}]")
_joiner = regex.compile(r"(?<=\p{Indic_Syllabic_Category=Virama})[‌‍]|(?<=\p{Script=Arabic})‌(?=\p{Script=Arabic})")
_hyphen = re.compile(f"[{HYPHENS}]")
_word = re.compile(rf"(?:[^\W\d_{CJK}\u0E00-\u0E7F]|[{ACCENTS}{INVISIBLE}])+")
_width = re.compile(f"[{WIDTH}]")
_wide_mark = re.compile(f"[{WIDE_MARKS}]")
_folded = re.compile(f"[{FOLDED}{FAR}]")
_accent = re.compile(rf"[^\W\d_][{ACCENTS}]+")
_single = re.compile(f"[{SINGLE}]")
_cjk = re.compile(f"[{CJK}]")
_greek, _cyrillic, _latin = (re.compile(f"[{s}]") for s in (GREEK, CYRILLIC, LATIN))
_tabled = re.compile(f"[{_TABLE}]")
_suspect = re.compile(f"[{_TABLE}{CYRILLIC}]")
_lone = re.compile(rf"(?<=[{CYRILLIC},;])(\s+)([acoy])(?=\s+[{CYRILLIC}])")
_dotted_number = re.compile(r"[.\s]*\d")


def _script(text: str) -> tuple[bool, bool, bool]:
    """Whether a value is Russian; whether it is Greek; whether all its letters of other scripts are in the table, so that it's open."""
    latin, cyrillic, greek = (len(s.findall(text)) for s in (_latin, _cyrillic, _greek))
    tabled = [c for c in _tabled.findall(text)]
    own_cyrillic = cyrillic - sum(1 for c in tabled if _cyrillic.match(c))
    own_greek = greek - sum(1 for c in tabled if _greek.match(c))
    latin -= sum(1 for c in tabled if _latin.match(c))
    return own_cyrillic > 0.2 * cyrillic and cyrillic > 0.3 * latin, own_greek > 0.5 * max(1, latin), bool(tabled) and not own_cyrillic and not own_greek


def _stand_ins(text: str) -> tuple[list[tuple[int, int, str]], bool]:
    """(start, end, replacement) of words whose skeleton differs by letters that stand in for others; whether others are left open."""
    if not _suspect.search(text):
        return [], False
    russian, greek, unsettled = _script(text)
    out, left = [], False
    for m in _word.finditer(text):
        w = m.group()
        if w.isascii() or not _suspect.search(w):
            continue
        letters = [c for c in w if c.isalpha()]
        odd = [c for c in letters if c in LOOK_ALIKE]
        latin = [c for c in letters if c not in LOOK_ALIKE and _latin.match(c)]
        if odd and (latin or len(odd) == len(letters)):
            cyrillic = [c for c in letters if _cyrillic.match(c)]
            if latin and any(c not in LOOK_ALIKE for c in cyrillic):  # Latin letters inside a Cyrillic word, or a mixed one
                out.append((m.start(), m.end(), "".join(TO_CYRILLIC.get(c, c) for c in w)))
                continue
            if not latin:
                foreign = any(c not in RUSSIAN for c in cyrillic)
                if len(cyrillic) == len(letters) and russian and not foreign:
                    continue
                if not cyrillic and (greek or (letters == ["ν"] and not _dotted_number.match(text, m.end()))):
                    left = True
                    continue
            out.append((m.start(), m.end(), "".join(LOOK_ALIKE.get(c, c) for c in w)))
        elif latin and any(_cyrillic.match(c) for c in letters):
            if all(c in TO_CYRILLIC for c in latin):
                out.append((m.start(), m.end(), "".join(TO_CYRILLIC.get(c, c) for c in w)))
    if russian:
        out += [(m.start(2), m.end(2), TO_CYRILLIC[m.group(2)]) for m in _lone.finditer(text)]
    return sorted(out), unsettled and left


def _drop_invisible(text: str) -> str:
    if not _invisible.search(text):
        return text
    proper = {m.start() for m in _joiner.finditer(text)}
    return _invisible.sub(lambda m: m.group() if m.start() in proper else "", text)


def _compatible(m) -> str:
    return unicodedata.normalize("NFKC", m.group())


def _composed(m) -> str:
    return unicodedata.normalize("NFC", m.group())


def replacements(text: str | None) -> tuple[str | None, bool]:
    """The value with every character that stands in for another replaced; whether its group has to settle the rest."""
    if not text or text.isascii():
        return text, False
    t = _hyphen.sub("-", _space.sub(" ", _drop_invisible(text)))
    t = _folded.sub(_compatible, _width.sub(_compatible, t))
    if not _cjk.search(t):
        t = _wide_mark.sub(_compatible, t)
    t = _single.sub(_composed, _accent.sub(_composed, t))
    words, left = _stand_ins(t)
    if not words:
        return t, left
    parts, last = [], 0
    for a, b, new in words:
        parts += [t[last:a], new]
        last = b
    return "".join([*parts, t[last:]]), left


def canonical(text: str | None) -> str | None:
    """The consistent form."""
    return replacements(text)[0]


def is_case(text: str | None) -> bool:
    """Whether the value holds a character that stands in for another."""
    return canonical(text) != text


def skeleton(text: str | None) -> str | None:
    """Prototype form for comparisons; not for reading."""
    if text is None or text.isascii():
        return text
    t = unicodedata.normalize("NFKD", _invisible.sub("", _hyphen.sub("-", text)))
    return unicodedata.normalize("NFKD", _tabled.sub(lambda m: LOOK_ALIKE[m.group()], t))


def _java(s: str) -> str:
    """A class of characters as Java writes it: escapes of more than four digits in braces, and none left to the Python parser."""
    s = re.sub(r"\\U000([0-9A-Fa-f]{5})", r"\\x{\1}", s)
    return s.replace("[", r"\[").replace("]", r"\]") if "[" in s else s


def may_need(c: Column) -> Column:
    """True of every value that isn't its own form or is left open, and of few others.

    Letters that never stand in are taken out first, so that the long class meets few characters."""
    rest = F.regexp_replace(c, r"[\x00-\x7F\u00C0-\u00FF\u0410-\u044F\u0900-\u097F\u0E00-\u0E7F\u0620-\u0652\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF]+", "")
    marks = "".join(_java(x) for x in (INVISIBLE, SPACES, HYPHENS, WIDTH, FOLDED, FAR, SINGLE, _OTHER, _FOREIGN)) + ACCENTS
    count = lambda p: F.regexp_count(c, F.lit(p))
    cyrillic, latin = count(f"[{CYRILLIC}]"), count(f"[{LATIN}]")
    own = count(f"[{CYRILLIC}&&[^{_TABLE}]]")
    mixed = c.rlike(rf"[{LATIN}][{ACCENTS}]*[{CYRILLIC}]|[{CYRILLIC}][{ACCENTS}]*[{LATIN}]|[{CYRILLIC},;]\s+[acoy]\s+[{CYRILLIC}]")
    wide = rest.rlike(f"[{_java(WIDE_MARKS)}]") & ~c.rlike(f"[{CJK}]")
    other = c.rlike(f"[{CYRILLIC}]") & (mixed | ~((own > 0.2 * cyrillic) & (cyrillic > 0.3 * latin)))
    return c.rlike(r"[^\x00-\x7F]") & (rest.rlike(f"[{marks}]") | wide | other)


FORMS = "row_key string, original string, text string, skeleton string, needed boolean, left boolean"


def canonicalize(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """row_key, original, text (consistent form), skeleton, needed; one row per key and value."""
    src = df.select(F.col(key_col).cast("string").alias("row_key"), F.col(text_col).cast("string").alias("original")).distinct()
    plain = F.coalesce(F.col("original").rlike(r"^[\x00-\x7F]*$"), F.lit(True))
    same = src.where(plain).select("row_key", "original", F.col("original").alias("text"), F.col("original").alias("skeleton"), F.lit(False).alias("needed"))
    forms = cut_table(src.where(~plain).mapInPandas(_forms, FORMS))
    open_ = settled(forms.select("row_key", "original", "text", "skeleton", "needed", "left", *_hashes("skeleton")), src)
    own = open_.select("row_key", "original", F.when(F.col("needed"), F.col("skeleton")).otherwise(F.col("text")).alias("text"), "skeleton", "needed")
    return same.unionByName(forms.where("needed or not left").select(*own.columns)).unionByName(own)


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        known = {v: (*replacements(v), skeleton(v)) for v in pdf["original"].unique()}
        text, left, skel = zip(*(known[v] for v in pdf["original"])) if len(pdf) else ((), (), ())
        yield pdf.assign(text=list(text), skeleton=list(skel), needed=[a != b for a, b in zip(text, pdf["original"])], left=list(left))


def _hashes(c: str) -> list[Column]:
    return [F.xxhash64(c).alias("k1"), F.xxhash64(F.lit(1), c).alias("k2")]


def settled(forms: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of forms (a written table with the hashes of skeletons) left open, needed if an ASCII value has the same skeleton."""
    left = forms.where("left and not needed").drop("needed")
    if left.isEmpty():
        return left.withColumn("needed", F.lit(False))
    plain = values.where(F.col("original").rlike(r"^[\x00-\x7F]+$")).select(*_hashes("original")).distinct().withColumn("plain", F.lit(True))
    return left.join(plain, ["k1", "k2"], "left").withColumn("needed", F.coalesce("plain", F.lit(False))).drop("plain")


def found(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """row_key of the values that needed it."""
    values = df.select(F.col(key_col).cast("string").alias("row_key"), F.col(text_col).cast("string").alias("original"))
    odd = values.where(may_need(F.col("original"))).mapInPandas(_forms, FORMS).where("needed or left")
    forms = cut_table(odd.select("row_key", "needed", "left", *_hashes("skeleton")))
    return forms.where("needed").select("row_key").unionByName(settled(forms, values).where("needed").select("row_key")).distinct()


def look_alikes(forms: DataFrame) -> DataFrame:
    """skeleton, writing, n_rows, n_writings (of the skeleton): each writing of the skeletons that occur in several. forms: see canonicalize."""
    w = forms.where("skeleton is not null").groupBy("skeleton", F.col("original").alias("writing")).agg(F.count(F.lit(1)).alias("n_rows"))
    g = w.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n_writings")).where("n_writings > 1")
    return w.join(g, "skeleton").select("skeleton", "writing", "n_rows", "n_writings")
