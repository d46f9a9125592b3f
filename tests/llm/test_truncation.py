import random

import pytest

from lectern.llm.truncation import limits, report, tail_kind, trie, truncated, words

KINDS = {
    "All was read.": "abbreviation", "All was read": "open", "He said \"no more.\"": "cut", "\"No more.\"": "whole", "Seen in plots, [truncated]": "cut", "Seen in plo…": "cut",
    "Is it?": "whole", "x.\na; b; c of d": "list", "x.\nKeywords: a; b": "list", "x.\nTable 1\t2\t3": "row", "x.\nhttps://a.example/src": "link", "x.\n[3] Kvellin F. (2017)": "reference",
    "stored at -20 °C.": "abbreviation", "cut off �": "cut", "we went,": "cut", "": "whole", "  ": "whole", "rated by E. M.": "cut", "": "whole", "done. [truncated]": "abbreviation",
}


@pytest.mark.parametrize("text", KINDS)
def test_kinds(text):
    assert tail_kind(text)[0] == KINDS[text]


def corpus():
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(4, 10))) for _ in range(300)]
    rows, want = [], set()
    for i in range(400):
        t = " ".join(" ".join(r.choice(vocab) for _ in range(9)).capitalize() + ", cf. " + r.choice(vocab) + "." for _ in range(r.randint(2, 12)))
        source = r.choice(["a", "b", "c"])
        if source == "a" and len(t) > 200:
            t = t[:200]
            if not t.endswith("."):
                want.add(i)
        elif i % 11 == 0:
            t += "\nStudy design"
        elif i % 13 == 0:
            t += "\nKeywords: " + "; ".join(r.choice(vocab) for _ in range(4))
        elif i % 17 == 0:
            t += "\nKeywords: " + "; ".join(r.choice(vocab) for _ in range(4)) + "; " + max(vocab, key=len)[:-3]
            want.add(i)
        elif i % 19 == 0:
            t += " It was, cf."
            want.add(i)
        rows.append((i, source, t, 0))
    return rows, want


def test_planted_cuts(spark):
    rows, want = corpus()
    df = spark.createDataFrame([*rows, rows[0], (900, "a", None, 0), (901, None, "", 0), (902, None, "word " * 50_000 + "End.", 0)], "doc_id bigint, source string, text string, n int")
    flags = truncated(df)
    got = {r.doc_id for r in flags.where("cut").collect()}
    assert got == want
    by = {r.source: r for r in report(flags).collect()}
    assert by["a"].share > by["b"].share and by["a"].n_at_limit > 50
    assert truncated(df.where("doc_id < 0")).count() == 0


def test_trie_and_limits(spark):
    v = words(spark.createDataFrame([("Word words word wo",), (None,)], "text string"))
    got = {r.token: (r.ends, r.runs_on) for r in trie(v, spark.createDataFrame([("wo",), ("word",), ("x",)], "token string")).collect()}
    assert got == {"wo": (1, 3), "word": (2, 1)}
    t = spark.createDataFrame([("s", n) for n in [*range(50, 100), *[600] * 9]], "source string, n int")
    assert [tuple(r) for r in limits(t).collect()] == [("s", 600)]


def test_headings_and_cut_headings_that_collide(spark):
    body = lambda i: f"Study {i} was done in town {i}.\n"
    rows = [(i, body(i) + "Statistical analysis\n" + body(i + 1000) + "Results") for i in range(8)]
    rows += [(100 + i, body(i + 50) + "Results\n" + body(i + 70)) for i in range(8)]
    rows += [(200 + i, body(i + 200) + "Statistical") for i in range(3)]
    rows += [(300 + i, body(300) + "All runs of the arm were") for i in range(2)]
    rows += [(400 + i, body(i + 400) + "Statistical analysis") for i in range(2)]
    df = spark.createDataFrame([(i, f"s{i}", t) for i, t in rows], "doc_id bigint, source string, text string")
    assert {r.doc_id for r in truncated(df).where("cut").collect()} == {200, 201, 202, 300, 301}


def test_nothing_is_bounded(spark):
    """Long last lines, words and headings, white space at the end, and a mark of a cut on a line of its own."""
    long = "a" * 70
    listed = "Keywords: " + "; ".join(f"term{i}" for i in range(2000))
    head = "Statistics of the second kind as they were agreed upon with all who took part in the study and beyond it"
    rows = [(1, f"All was read.\n{listed}"), (2, f"All was read.\n{listed}; "), (3, f"It was {long}b\nNo.\n{listed}; {long}"), (4, f"{long}b was read by us all."), (5, f"{long}b, and {long}b."), (6, f"Of the {long}b and the {long}b.")]
    rows += [(10 + i, f"Body {i} was read.\n{head}\nMore {i} was read.") for i in range(3)] + [(20 + i, f"Text {i} was read.\n{head}") for i in range(2)]
    rows += [(30, "We read the plots and\n\n \t\n"), (31, "They read the rows and\n\n[truncated]\n"), (32, "All was read.\n\n[truncated]"), (33, "We read the plo\u00a0"), (34, "[truncated]")]
    rows += [(40 + i, f"{w} plots and rows {w}.") for i, w in enumerate(["plots", "read", "rows"] * 9)]
    df = spark.createDataFrame([(i, f"s{i}", t) for i, t in rows], "doc_id bigint, source string, text string")
    assert {r.doc_id for r in truncated(df).where("cut").collect()} == {2, 3, 30, 31, 33}
