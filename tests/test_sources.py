import gzip
import json
from datetime import datetime

from pyspark.sql import functions as F

from lectern.operators import corpus, entities, evaluate
from lectern.operators.match import dictionary_hits, lexicon, propagate
from lectern.operators.spans import containing, sentence_spans
from lectern.plans.pipeline import extract_mentions
from lectern.sources import files, sinks, xml
from lectern.streaming import mentions

TEI = """<!DOCTYPE TEI [<!ENTITY x "y">]><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title type="main">On  plots</title></titleStmt>
<idno>x</idno><idno type="DOI">10.99/ab</idno><author><persName><forename>A.</forename><surname>Bee</surname></persName></author></fileDesc></teiHeader>
<text><front><abstract><p>Short.</p></abstract></front><body><div><head>Methods</head><p>We used <rs type="software" xml:id="s1">Foo</rs> <rs type="publisher" corresp="#s1">Bar Inc.</rs> <ref type="bibr" target="#b0">[1]</ref> at <ref type="uri">http://a.b</ref>.</p></div></body>
<back><listBibl><biblStruct xml:id="b0"><analytic><title level="a">Pests</title><author><persName><forename>C.</forename><surname>Dee</surname></persName></author></analytic><monogr><title level="j">Journal</title><imprint><biblScope unit="page" from="63" to="70"/><date when="1993-02"/></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_xml(spark):
    df = spark.createDataFrame([(1, TEI), (2, "<bad"), (3, None)], "doc_id int, xml string")
    p = xml.tei_paragraphs(df).orderBy("para_no").collect()
    assert [r.para_no for r in p] == [0, 1] and all(len(r.text) == len(r.original) for r in p) and p[1].global_offset == len(p[0].text)
    c = p[1].callouts[0]
    assert p[1].original[c.start : c.end] == "[1]" and c.target == "b0" and p[1].text[c.start : c.end] == "   " and "http://a.b" in p[1].text
    b = xml.tei_bibliography(df).collect()
    assert len(b) == 1 and (b[0].xml_id, b[0].journal, b[0].year, b[0].begin_page, b[0].authors) == ("b0", "Journal", 1993, "63", ["C. Dee"])
    m = xml.article_metadata(df).first()
    assert (m.title, m.doi, m.authors) == ("On plots", "10.99/ab", "A. Bee")
    a = xml.inline_annotations(df).where("para_no = 1").first()
    assert [(s.type, a.text[s.start : s.end], s.corresp) for s in a.spans] == [("software", "Foo", None), ("creator", "Bar Inc.", "#s1")]
    j = json.loads(xml.lossy_json(df).first().payload)
    assert j["abstract"][0]["text"] == "Short." and j["body_text"][0]["section"] == "Methods" and j["body_text"][0]["ref_spans"][0]["ref_id"] == "b0"
    assert xml.text_chunks(df).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TXT").write_text("one\ntwo\t3")
    (tmp_path / "a" / "y.txt").write_text("  ")
    assert sorted(str(r.text) for r in files.texts(spark, str(tmp_path)).collect()) == ["None", "one two 3"]
    (tmp_path / "l1").write_text("alpha # c\n# only\nR\n")
    (tmp_path / "l2").write_text("beta\nalpha\n")
    assert sorted(r.term for r in files.term_list(spark, [str(tmp_path / "l1"), str(tmp_path / "l2")], ("R",)).collect()) == ["alpha", "beta"]
    with gzip.open(tmp_path / "idf.tsv.gz", "wt") as f:
        f.write("foo\t1.5\nbad\n")
    assert [tuple(r) for r in files.idf_table(spark, str(tmp_path / "idf.tsv.gz")).collect()] == [("foo", 1.5)]
    (tmp_path / "c.csv").write_text('id,x\n1,"a ""b"", c"\n2,N/A\n')
    assert [tuple(r) for r in files.annotation_csv(spark, str(tmp_path / "c.csv"), "id int, x string").collect()] == [(1, 'a "b", c'), (2, None)]
    (tmp_path / "u.csv").write_text("s1,#a,TRUE\ns2,x\ns3,#b,no\n")
    assert [(r.id, r.used) for r in files.usage_corrections(spark, str(tmp_path / "u.csv")).collect()] == [("s1", True), ("s3", False)]
    (tmp_path / "t.csv").write_text("d1,A, b\n")
    assert tuple(files.first_comma(spark, str(tmp_path / "t.csv")).first()) == ("d1", "A, b")
    (tmp_path / "d.ann").write_text("T1\tApplication 3 6\tFoo\nR1\trel x y\tz\n")
    assert tuple(files.standoff(spark, str(tmp_path / "d.ann")).first()) == ("d", "T1", "Application", 3, 6, "Foo")
    answer = json.dumps({"language": {"lang": "en"}, "entities": [{"offsetStart": 3, "confidence_score": 0.5, "wikipediaExternalRef": -1, "wikidataId": "Q1", "statements": [{"propertyId": "P31", "value": "Q2"}, {"propertyId": "P31", "value": "Q3"}]}]})
    e = files.linking_response(spark.createDataFrame([(answer,)], "response string")).first()
    assert (e.lang, e.start, e.wikipedia_ref, e.statements) == ("en", 3, None, {"P31": ["Q2", "Q3"]})


def test_sinks_and_pipeline(spark):
    texts = spark.createDataFrame([(1, "We used Foo 2.1 & <b>. Then Foo again.")], "id int, text string")
    names = spark.createDataFrame([("Foo",)], "name string")
    out = extract_mentions(texts, names, "name", ("id",)).orderBy("start").collect()
    assert [(r.start, r.version) for r in out] == [(8, "2.1"), (28, None)] and json.loads(out[0].json)["software-name"]["offsetEnd"] == 11
    marked = sinks.marked_up(texts, spark.createDataFrame([(1, 8, 11, "software")], "id int, start int, end int, type string"), ["id"]).first().xml
    assert marked == 'We used <rs type="software">Foo</rs> 2.1 &amp; &lt;b&gt;. Then Foo again.'
    assert sinks.distinct_references(spark.createDataFrame([(1, "k", 5), (1, "k", 2)], "d int, k string, o int"), "d", "k", "o").first().first_use == 2
    assert sinks.feature_lines(spark.createDataFrame([("a", "b", "<x>")], "f string, g string, l string"), ["f", "g"], "l").first().value == "a b <x>"


def test_propagation_reaches_all_segments_and_is_idempotent(spark):
    texts = spark.createDataFrame([(1, 1, "Foo here, Foo there"), (1, 2, "and Foo"), (2, 3, "no Foo known")], "doc int, seg int, text string")
    known = spark.createDataFrame([(1, "Foo")], "doc int, term string")
    taken = spark.createDataFrame([(1, 0, 3)], "seg int, start int, end int")
    idf = spark.createDataFrame([("Foo", 2.0)], "term string, idf double")
    texts = texts.select("doc", "seg", "text")
    hits = dictionary_hits(texts, lexicon(known, "term"), ("doc", "seg"))
    got = {(r.seg, r.start) for r in propagate(hits, known, taken, "doc", "seg", idf).collect()}
    assert got == {(1, 10), (2, 4)}
    again = taken.unionByName(propagate(hits, known, taken, "doc", "seg", idf).select("seg", F.col("start").cast("int"), "end"))
    assert propagate(hits, known, again, "doc", "seg", idf).count() == 0
    assert lexicon(spark.createDataFrame([], "n string"), "n").count() == 0


def test_document_attributes_and_scores(spark):
    m = spark.createDataFrame([(1, "d", "Foo", "foo", True, 0.9), (2, "d", "Foo", "foo", False, 0.2), (3, "d", "FOO", "foo", None, None), (4, "d", "Bar", "bar", False, 0.4)], "id int, doc string, raw string, norm string, used boolean, used_score double")
    got = {r.id: (r.doc_used, r.doc_used_score) for r in entities.document_attributes(m, "doc", ["raw", "norm"], ["used"]).collect()}
    assert got == {1: (True, 0.9), 2: (True, 0.9), 3: (True, 0.9), 4: (False, 0.4)}
    v, s = entities.binary_class(F.lit(0.3), F.lit(0.6))
    assert tuple(spark.range(1).select(v, s).first()) == (False, 0.4)
    a = spark.createDataFrame([("d", "x", "f", "spss"), ("d", "x", "f", "r"), ("d", "y", "f", "spss")], "i string, w string, f string, v string")
    assert corpus.agreement(a, "i", "w", "f", "v").first().agreements == 1
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(["<a>", "<a>", "<other>", "<b>"])], "s int, pos int, label string")
    assert sorted((r.label, r.first, r.last) for r in evaluate.chunks(evaluate.begin_labels(t, ["s"]), ["s"]).collect()) == [("<a>", 0, 1), ("<b>", 3, 3)]
    units = sentence_spans(spark.createDataFrame([(1, "One. Two here. Three")], "id int, text string"), ["id"])
    s = spark.createDataFrame([(1, 5, 8)], "id int, start int, end int")
    assert tuple(containing(s, units, ["id"]).first())[-2:] == (5, 15)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"text {i} with Foo and Bar {'Foo' if i % 2 else ''}", datetime(2020, 1, 1, 0, i % 50)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, at timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    lex = lexicon(spark.createDataFrame([("Foo",), ("Bar",)], "n string"), "n")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    mentions.run_once(mentions.stream_hits(stream, lex, ("id",)), str(tmp_path / "out"), str(tmp_path / "cp"))
    from lectern.operators.match import dictionary_hits

    want = sorted(map(tuple, dictionary_hits(df, lex, ("id",)).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want and len(want) == 100
    m = df.select("id", F.lit("d").alias("doc"), F.lit("foo").alias("name"), (F.col("id") == 3).alias("used"), (F.col("id") / 100).alias("score"), "at")
    m.write.parquet(str(tmp_path / "m"))
    live = spark.readStream.schema(m.schema).parquet(str(tmp_path / "m"))
    mentions.run_once(mentions.stream_attributes(live, "doc", "name", "used", "score", "at"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() <= 1
