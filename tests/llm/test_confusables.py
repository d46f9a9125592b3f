import random

import pytest
from pyspark.sql import functions as F

from lectern.llm.confusables import LOOK_ALIKE, canonical, canonicalize, found, is_case, look_alikes, may_need, replacements, skeleton

CASES = ["PаvsSona", "Ρlyphyl", "ＡＢ１", "na​me", "a b", "été", "co­op", "Ply‑Stat", "ofﬁce", "⽐較", "позвoляет", "ν12.0", "Ѕ.A.", "а rewrite", "ガス"]
PLAIN = ["TNF-α was", "x² at 37 °C, № 5", "naïve “quote” … d’été", "中文（括号），！", "Не все с каждого", "किया गया।", "ＯＫ"[:0], "tab\t  two", "α and ν differ", "「雨」、ー"]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert is_case(text) and not is_case(canonical(text))


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert not is_case(text)


def test_skeleton_groups_look_alikes():
    assert skeleton("PаvsSоna") == skeleton("PavsSona") == skeleton("Ｐavs​Sona") and skeleton(None) is None
    assert canonical("x" * 200_000 + " ") == "x" * 200_000 + " "


def test_frames(spark):
    rows = [("1", "PavsSona"), ("2", "PаvsSona"), ("2", "PаvsSona"), ("3", None), ("4", ""), (None, "a b")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k string, t string, text int")
    assert [r.row_key for r in found(df, "k", "t").orderBy("row_key").collect()] == [None, "2"]
    assert canonicalize(df, "k", "t").count() == 5
    g = sorted(look_alikes(canonicalize(df, "k", "t")).collect(), key=lambda r: r.writing)
    assert [(r.writing, r.n_rows, r.n_writings) for r in g] == [("PavsSona", 1, 2), ("PаvsSona", 1, 2)] and len({r.skeleton for r in g}) == 1
    assert canonicalize(df.where("k = 'none'"), "k", "t").count() == 0


def test_a_group_settles_what_its_script_leaves_open(spark):
    """A lone Greek nu is Greek, unless the same value is written elsewhere with the Latin letter."""
    df = spark.createDataFrame([("1", "ν"), ("2", "v"), ("3", "ν or η"), ("4", "ν - ν")], "k string, t string")
    assert {r.row_key for r in found(df, "k", "t").collect()} == {"1"}
    assert {r.row_key for r in found(df.where("k <> '2'"), "k", "t").collect()} == set()
    assert {r.row_key: r.text for r in canonicalize(df, "k", "t").where("needed").collect()} == {"1": "v"}


def test_scripts_beyond_the_three():
    for c in "ⲞꓮᎪⴹᑭᴄꜱᏔᚷ":
        assert is_case(f"Pla{c}ka") and skeleton(f"Pla{c}ka").isascii(), c
    assert len(set(LOOK_ALIKE.values())) == 45 and is_case("使用РАВС软件") and not is_case("ⲁⲟⲃ") and not is_case("ⲁⲃⲅ") and not is_case("ꮿꮧ") and not is_case("ᐃᓄᒃᑎᑐᑦ")


def test_the_filter_of_the_jvm_keeps_all_cases(spark):
    r = random.Random(4)
    pool = list("ab Z9.,;-éßñа́́вгеνλΩоКТЅꓮⲞ中文の「！，Ａ１­​‍ ‑ﬁⅣ𝐀Ⅰµ²№°กिक्ا‌بАСЕ") + [" ", " ", "\u0301", "\u3099", "\u2126"]
    values = {"".join(r.choice(pool) for _ in range(r.randint(1, 9))) for _ in range(6000)} | {"это а a все", "ab и c все", "Привет мир, a он", "word Привет", "Ρ", "т"}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    sent = {x.v for x in df.where(may_need(F.col("v"))).collect()}
    assert {v for v in values if is_case(v) or replacements(v)[1]} <= sent
