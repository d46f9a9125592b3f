import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import lectern.plans.corpus_queries as core
from lectern.functions import normalize
from lectern.functions.tokens import FAST, PATTERN, offsets, tokenize
from lectern.operators import spans
from lectern.operators.match import dictionary_hits, keep_term, lexicon, non_overlapping

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = core.QUERIES[name](spark, DATA)
    r = con.sql(core.SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    order = sorted(df.columns)
    key = lambda cols, rows: sorted((repr(tuple(row[cols.index(c)] for c in order)) for row in rows))
    assert key(df.columns, map(tuple, df.collect())) == key(list(r.columns), r.fetchall())


def test_tokens(spark):
    golden = {"SPSS v13": ["SPSS", " ", "v", "13"], "v0.7.1": ["v", "0", ".", "7", ".", "1"], "abc12_x": ["abc", "12", "_x"], "ab_12": ["ab_12"], "a-b": ["a", "-", "b"], "": [], "é12 ü": ["é12", " ", "ü"]}
    df = spark.createDataFrame([(k,) for k in golden], "text string").withColumn("t", tokenize(F.col("text"))).withColumn("o", offsets(F.col("t")))
    same = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    for r in df.withColumn("p", same).collect():
        assert list(r.t) == golden[r.text] == list(r.p) and "".join(r.t) == r.text
        assert [r.text[o.start : o.end] for o in r.o] == list(r.t)
    assert FAST != PATTERN


def test_normalisers(spark):
    n = lambda f, x: spark.createDataFrame([(x,)], "c string").select(f(F.col("c"))).first()[0]
    versions = {"version 1.1": "1.1", "Version 5.0    ": "5.0", "1.31 version": "1.31", "v.9.3": "9.3", "v0.9.6": "0.9.6", "ver.12.0": "12.0", "ver.13 ": "13", "release  1.31": "1.31"}
    assert {k: n(normalize.version, k) for k in versions} == versions
    assert n(normalize.url, "(http://www.superarray.com/ pcr/arrayanalysis.php),") == "http://www.superarray.com/pcr/arrayanalysis.php" and n(normalize.url, "random.org") == "random.org"
    assert n(normalize.creator, "SPSS Inc., Chicago IL, USA") == "SPSS Inc." and n(normalize.creator, "(Bruker Corporation, Santa Barbara, CA, USA)") == "Bruker Corporation"
    assert n(normalize.simplified, "Foo-Bar 2.0") == "foobar20" and n(normalize.simplified_letters, "Foo-Bar 2.0") == "foobar" and n(normalize.simplified, None) == ""
    assert n(normalize.strip_markup, "<b>a &lt; b</b>") == "a < b" and n(normalize.context, "soft-\nware  x") == "software x"


def test_nested_dictionary_hits_and_greedy_choice(spark):
    lex = lexicon(spark.createDataFrame([("LibreOffice",), ("LibreOffice Draw",), ("LibreOffice Math",)], "name string"), "name")
    texts = spark.createDataFrame([(1, "install LibreOffice Draw version 12.1 and LibreOffice Math version 0.9.")], "id int, text string")
    hits = dictionary_hits(texts, lex, ("id",))
    assert hits.count() == 4
    kept = non_overlapping(hits.select("id", "term", F.col("start").cast("int"), F.col("end").cast("int")), ["id"], extra=("term",))
    assert sorted(r.term for r in kept.collect()) == ["LibreOffice Draw", "LibreOffice Math"]


def test_worked_cases(spark):
    chunk = "doc int, id string, role string, start int, end int"
    a = spark.createDataFrame([(1, "A", "name", 0, 4), (1, "v", "version", 10, 12), (1, "B", "name", 20, 24)], chunk)
    assert spans.attach_nearest(a, ["doc"]).first().name_id == "A"
    b = spark.createDataFrame([(1, "A", "name", 0, 4), (1, "v", "version", 17, 19), (1, "B", "name", 20, 24)], chunk)
    assert spans.attach_nearest(b, ["doc"]).first().name_id == "B"
    names = spark.createDataFrame([(1, "n", 6, 10)], "doc int, id string, start int, end int")
    refs = spark.createDataFrame([(1, "r1", 12, 15), (1, "r2", 18, 20), (1, "r3", 30, 33)], "doc int, ref string, start int, end int")
    assert sorted(r.ref for r in spans.attach_callouts(names, refs, ["doc"]).collect()) == ["r1", "r2"]
    gate = spark.createDataFrame([(9, 0.0, "ab"), (1, 0.0005, "ab"), (1, None, "ab"), (1, None, "x"), (1, None, "R")], "f int, idf double, t string")
    assert [r[0] for r in gate.select(keep_term(F.col("f"), F.col("idf"), F.length("t"), F.col("t"))).collect()] == [True, False, True, False, True]
