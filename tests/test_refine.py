"""Refinement and alignment on small worked cases."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lectern.functions import values
from lectern.functions.normalize import signature
from lectern.functions.tokens import DELIMITERS, tokenize
from lectern.operators import align, refine, report


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_types_and_languages(spark):
    names = [("t", "n1", 0, 13, "Python Foo 2x"), ("t", "n2", 20, 29, "Bar  Java"), ("t", "n3", 40, 41, "R"), ("t", "n4", 60, 63, "Baz"), ("t", "n5", 80, 83, "Qux")]
    types = [("t", "l1", 0, 6, "Python", "language"), ("t", "l2", 25, 29, "Java", "language"), ("t", "l3", 40, 41, "R", "language"), ("t", "l4", 70, 73, "C++", "language"), ("t", "l5", 200, 203, "Ada", "language"), ("t", "i1", 60, 63, "Baz", "component"), ("t", "i2", 300, 306, "script", "implicit")]
    n = spark.createDataFrame(names, "text string, id string, start int, end int, raw string")
    y = spark.createDataFrame(types, "text string, tid string, t0 int, t1 int, traw string, type string")
    got = {r.id: (r.start, r.end, r.raw, r.type, r.language) for r in refine.refine_types(n, y, ["text"]).collect()}
    assert got == {
        "n1": (7, 13, "Foo 2x", "software", "Python"), "n2": (20, 23, "Bar", "software", "Java"), "n3": (40, 41, "R", "environment", None),
        "n4": (60, 63, "Baz", "component", "C++"), "n5": (80, 83, "Qux", "software", None), "i2": (300, 306, "script", "implicit", None),
    }
    assert refine.refine_types(n.where("id = '-'"), y.where("tid = '-'"), ["text"]).count() == 0


def test_urls_keys_and_classes(spark):
    texts = spark.createDataFrame([(1, "see https://www.libreoffice.org/download/download/ online, ftp://a.example."), (2, None), (3, "none")], "id int, text string")
    assert rows(refine.pattern_spans(texts, ["id"], refine.URL_IN_TEXT), "match", "start", "end") == [("ftp://a.example", 59, 74), ("https://www.libreoffice.org/download/download/", 4, 50)]
    c = spark.createDataFrame([("[12]", 0.6, 0.2, 0.9), ("(x)", 0.5, None, 0.1)], "m string, a double, b double, c double")
    assert rows(c.select(F.coalesce(refine.callout_key(F.col("m")), F.lit("-")).alias("k"), refine.context_classes(F.col("a"), F.col("b"), F.col("c")).alias("x")), "k", "x") == [("#b11", "used,shared"), ("-", "")]
    bad = spark.createDataFrame([("software", "("), ("software", "the"), ("software", "12"), ("software", "Foo"), ("url", "//"), ("version", "12"), ("publisher", "-a\nb")], "l string, c string")
    assert [r.v for r in bad.select(refine.is_chunk(F.col("l"), F.col("c"), "".join(map(chr, DELIMITERS)), F.col("c") == "the", F.lit(False)).alias("v")).collect()] == [False, False, False, True, False, True, False]


def test_values(spark):
    df = spark.createDataFrame([("a\u0000b\u000b c", "Foo\n  Bar", "İx-Y 2")], "x string, c string, s string")
    r = df.select(values.valid_xml(F.col("x")).alias("x"), values.component_form(F.col("c")).alias("c"), signature(F.col("s")).alias("s"), values.scaled_certainty(F.lit(7)).alias("k"), values.is_true(F.lit("TRUE")).alias("t"), values.is_true(F.lit(None)).alias("n")).first()
    assert (r.x, r.c, r.s, r.k, r.t, r.n) == ("ab c", "Foo Bar", "ixy2", "0.7", True, False)
    u = spark.createDataFrame([("h.example", "8090"), ("https://h.example", "80"), ("h.example", "443"), ("h.example/x", None)], "h string, p string")
    assert [r.u for r in u.select(values.concept_url(F.col("h"), F.col("p")).alias("u")).collect()] == ["http://h.example:8090/nerd", "https://h.example/nerd", "https://h.example/nerd", "http://h.example/x"]
    assert spark.range(1).select(values.retokenized(F.array(F.lit("v13 a"), F.lit("b-c"))).alias("t")).first().t == spark.range(1).select(tokenize(F.lit("v13 ab-c")).alias("t")).first().t[:3] + ["a", "b", "-", "c"]


def test_aligned_paragraphs_against_brute_force(spark):
    left = [("d", 1, "We used SPSS 13 here."), ("d", 2, "A part of it"), ("d", 3, "Foo and Bar were run on all plots."), ("d", 4, "Nothing alike 123"), ("e", 5, "We used SPSS 13 here."), ("d", 6, None), ("d", 7, "")]
    right = [("d", 11, "We  used SPSS-13 here"), ("d", 12, "This is a part of it, and more"), ("d", 13, "Foo and also Bar were run on most plots."), ("d", 14, "Foo Bar"), ("d", 15, None)]
    names = [(3, "Foo"), (3, "Bar"), (4, "XYZ"), (2, None)]
    make = lambda x: spark.createDataFrame(x, "doc string, id int, text string")
    got = rows(align.aligned_paragraphs(make(left), make(right), "doc", spark.createDataFrame(names, "id int, name string")), "left_id", "right_id", "how")
    assert got == [(1, 11, "equal"), (2, 12, "contained"), (3, 13, "similar")]
    assert SequenceMatcher(None, left[2][2], right[2][2], autojunk=False).ratio() > 0.5


def test_sentences_quotes_and_transfer(spark):
    units = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 20, 30), (2, 0, 5)], "k int, start int, end int")
    crossing = spark.createDataFrame([(1, 8, 12), (1, 20, 22), (1, None, None)], "k int, start int, end int")
    assert rows(align.merged_sentences(units, crossing, ["k"]), "k", "start", "end") == [(1, 0, 20), (1, 20, 30), (2, 0, 5)]
    t = spark.createDataFrame([(1, "one Foo 2.0 and then Foo 2.0 again")], "k int, text string")
    f = spark.createDataFrame([(1, "v", "version", "2.0", 21), (1, "w", "version", "9", 21)], "k int, id string, label string, raw string, anchor int")
    assert rows(align.nearest_occurrence(t, f, "k", {"version": 20}), "id", "pos", "distance") == [("v", 14, 2)]
    s = spark.createDataFrame([("1", "foo", "a", "b", None), ("2", "foo", "a", "b", True), ("3", "foo", "x", "b", None)], "id string, text string, left string, right string, used boolean")
    assert rows(align.transferred(s, ["used"], "id").where("used"), "id") == [("1",), ("2",)]


def test_reports(spark):
    a, b = (spark.createDataFrame(x, "f string, n int, rate double") for x in ([("p", 2, 0.5), ("q", 1, 1.0)], [("p", 4, 1.0)]))
    assert rows(report.averaged(a, b, "f", ["rate"]), "f", "n", "rate") == [("p", 6, 0.75), ("q", 1, 1.0)]
    texts = spark.createDataFrame([(1, "a <b> & SPSS 13."), (2, None), (3, "x")], "k int, text string")
    spans = spark.createDataFrame([(1, 8, 12, "software", "s1"), (1, 10, 12, "version", "s2"), (1, 13, 15, "version", "s3"), (1, 90, 95, "url", "s4")], "k int, start int, end int, type string, id string")
    got = {r.k: r.snippet for r in report.inline_markup(texts, spans, ["k"]).collect()}
    assert got == {1: '<p>a &lt;b&gt; &amp; <rs type="software" id="s1">SPSS</rs> <rs type="version" id="s3">13</rs>.</p>', 2: None, 3: "<p>x</p>"}
    p = spark.createDataFrame([("x", "x", 6), ("x", "y", 2), ("y", "y", 2)], "gold string, found string, n int")
    assert rows(report.label_scores(p, 10), "label", "accuracy", "precision", "recall", "support") == [("x", 0.8, 1.0, 0.75, 8), ("y", 0.8, 0.5, 1.0, 2)]
