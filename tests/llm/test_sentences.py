import random

from lectern.llm.sentences import candidates, inside, manner, sentences, word_type

NAMES = ["Barsonne", "Corvassal", "Hultagre", "Iwatora", "Kvellin", "Drabeck"]
MAKE = [
    lambda r: f"Dr. {r.choice(NAMES)} and E. M. {r.choice(NAMES)} rated the {r.randint(2, 99)} plots blindly.",
    lambda r: f"The counts were exported in {r.randint(1, 9)}.{r.randint(1, 9)} s, cf. Tab. {r.randint(1, 99)}, and stored.",
    lambda r: f"A licence was bought from {r.choice(NAMES)} S.A. for approx. {r.randint(1, 99)} sites, i.e. all.",
    lambda r: 'The manual states: "Leave them as they are. Do not merge them." and we complied.',
    lambda r: f"Was it lost after {r.randint(2, 90)} runs?",
    lambda r: f"The plates were bought from {r.choice(NAMES)} S.A.",
    lambda r: f"We waited {r.randint(2, 9)} weeks ... and more ... to get it (see Fig. {r.randint(1, 9)}).",
]


def test_generated_english(spark):
    r = random.Random(2)
    rows, want = [], set()
    for i in range(300):
        text, pos = "", 0
        if i % 10 == 0:
            text = "Study design\n"
            want.add((i, 0, 12))
        for _ in range(r.randint(1, 6)):
            s = r.choice(MAKE)(r)
            want.add((i, len(text), len(text) + len(s)))
            text += s + r.choice([" ", " ", "\n", "  "])
        rows.append((i, text, "en", 0))
    rows += [rows[0], (900, None, "en", 0), (901, "  ", None, 0), (902, "完成了。他说：“不要动。再来。”然后走了！", None, 0)]
    df = spark.createDataFrame(rows, "text_id bigint, text string, lang string, id int")
    got = {(x.text_id, x.start_pos, x.end_pos) for x in sentences(df).collect()}
    assert {g for g in got if g[0] == 902} == {(902, 0, 4), (902, 4, 21)}
    got = {g for g in got if g[0] < 900}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    assert sentences(df.where("text_id < 0")).count() == 0


def test_parts():
    assert manner("これはペンです。", None) == "ja" and manner("12", None) == "" and manner("ab", "zh") == "zh"
    assert inside('a "b. c" d (e. f) «g') == [(2, 7), (11, 16)]
    assert inside('5" and 6" wide') == [] and inside("„Ja.“ und „Nein.”") == [(0, 4), (10, 16)]
    assert word_type("(Ver") == "ver" and word_type("12.5") == "##"
    assert [c[:2] for c in candidates("ก ข", "th")] == [(1, 2)]
    assert candidates("word " * 200_000, "") == [] and len(inside("(" * 100_000 + "a" + ")" * 100_000)) == 1


def test_a_quotation_of_any_length_is_one():
    for n in (5, 90, 150, 5000):
        text = 'It says: "' + "Leave them. " * n + 'Go on." Then we left.'
        assert [c[0] for c in candidates(text, "")] == [text.index(" Then")]


def test_a_language_learned_from_the_texts(spark):
    """Abbreviations, starters and collocations of an invented language, and untagged texts of it."""
    r = random.Random(8)
    nouns = [f"{a}{b}" for a in ("vol", "kir", "pem", "sat", "dun") for b in ("aki", "uno", "este", "oro")]
    names = [n.capitalize() + "is" for n in nouns[:12]]

    def sentence():
        body = " ".join(r.choice(nouns) for _ in range(r.randint(4, 9)))
        return r.choice([f"Lo {body} dok. {r.choice(names)} {r.choice(nouns)}.", f"Sen {body} {r.randint(2, 30)}. Zimar {r.choice(nouns)}.", f"Lo {body}.", f"Mir {body} {r.choice(nouns)}."])

    rows, want = [], set()
    for i in range(400):
        text = ""
        for _ in range(r.randint(2, 5)):
            s = sentence()
            want.add((i, len(text), len(text) + len(s)))
            text += s + " "
        rows.append((i, text, "xx" if i % 5 else None))
    rows += [(1000 + i, "The cat sat on the mat. The dog was there.", "en") for i in range(50)]
    got = {tuple(x) for x in sentences(spark.createDataFrame(rows, "text_id bigint, text string, lang string")).where("text_id < 1000").collect()}
    assert len(got & want) / len(want) > 0.98 and len(got & want) / len(got) > 0.98


def test_long_headings_of_many_lines(spark):
    """Headings of any length and number of lines, if they stand before different texts; copies of one text prove nothing."""
    head = "Of the many\nways in\nwhich the plots\nwere read and what was done with what had been found in each of them by the readers"
    rows = [(i, f"{head}\nSome {i} plots were read. Others {i} were not.", "en") for i in range(4)] + [(10 + i, "We went\nHome to rest. All slept.", "en") for i in range(4)]
    got = {tuple(x) for x in sentences(spark.createDataFrame(rows, "text_id bigint, text string, lang string")).collect()}
    assert (0, 0, len(head)) in got and (10, 0, 7) not in got
