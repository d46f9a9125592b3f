"""Labelled collections, annotators, relevant text, annotation tables, whole mentions and files."""

import json

from pyspark.sql import functions as F

from lectern.sources import files, sinks, xml

TEI = """<TEI><teiHeader><respStmt xml:id="a7"><name>Ann  B</name></respStmt><respStmt><name xml:id="c9">Cy</name></respStmt><respStmt/></teiHeader>
<text><abstract><p>We used <rs type="software" xml:id="s1">Foo Bar</rs><lb/> <rs type="version">2.1</rs>.</p></abstract><body><head>Methods</head><p><s>One <rs type="url">u</rs>.</s><s>Two <ref type="bibr">[12]</ref> three.</s><pb/></p>
<note place="foot">Foot</note><note place="margin">No</note><figure><figDesc>Fig</figDesc></figure></body></text></TEI>"""


def frame(spark):
    return spark.createDataFrame([("d", TEI), ("e", None), ("f", "<p>broken")], "doc_id string, xml string")


def test_labelled_tokens(spark):
    got = [(r.token, r.label) for r in xml.labelled_tokens(frame(spark)).where("para_no = 0").orderBy("pos").collect()]
    assert got == [("We", "<other>"), (" ", "<other>"), ("used", "<other>"), (" ", "<other>"), ("Foo", "I-<software>"), (" ", "<software>"), ("Bar", "<software>"), ("+L+", None), (" ", "<other>"), ("2", "I-<version>"), (".", "<version>"), ("1", "<version>"), (".", "<other>")]
    assert xml.labelled_tokens(frame(spark)).where("token = '+PAGE+'").count() == 1


def test_sentences_and_inclusive_ends(spark):
    s = xml.inline_annotations(frame(spark), unit="s").orderBy("para_no").collect()
    assert [(r.text, len(r.spans)) for r in s] == [("One u.", 1), ("Two [12] three.", 0)]
    p = xml.inline_annotations(frame(spark), inclusive=True).where("para_no = 0").first()
    assert [(x.start, x.end, x.raw) for x in p.spans][0] == (8, 14, "Foo Bar")


def test_annotators_and_relevant_text(spark):
    assert [(r.no, r.id, r.name) for r in xml.annotators(frame(spark)).orderBy("no").collect()] == [(0, "a7", "Ann B"), (1, "c9", "Cy"), (2, "annotator2", None)]
    got = [(r.kind, r.text, r.n_ref) for r in xml.relevant_text(frame(spark)).orderBy("no").collect()]
    assert [g[0] for g in got] == ["abstract", "heading", "paragraph", "note", "figure"] and got[1][1] == "Methods" and got[3][1] == "Foot"


def test_annotation_tables(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,who,code,present,label\n1,a,"x ""y""",TRUE,No Label\n2,b,z,,L\n')
    got = files.annotation_table(spark, f"{tmp_path}/c.csv", "codes_applied").orderBy("annotation_id").collect()
    assert [(r.code, r.was_present, r.label) for r in got] == [('x "y"', True, None), ("z", False, "L")]
    (tmp_path / "l.csv").write_text("Foo,http://w/Foo,Q2\nfoo,http://w/foo,Q1\n,,\n")
    assert [tuple(r) for r in files.languages(spark, f"{tmp_path}/l.csv").collect()] == [("foo", "foo", "http://w/foo", "Q1")]
    (tmp_path / "p.txt").write_text("Big Data # x\nbig data\n\n")
    assert [r.value for r in files.property_values(spark, f"{tmp_path}/p.txt").collect()] == ["big data"]


def test_whole_mentions_and_files(spark):
    df = spark.createDataFrame([("d", 5, "Foo", "1.0", "In Foo 1.0.", True, 0.9), ("d", 1, "Bar", None, "Bar.", None, None)], "doc string, at int, name string, version string, context string, used boolean, score double")
    part = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("rawForm")))
    m = df.select("doc", "at", sinks.mention_record({"software-name": part("name"), "version": part("version")}, F.col("context"), F.col("at"), F.col("used"), F.col("score"), F.array(F.struct(F.lit("[1]").alias("label"), F.lit(0).alias("refKey")))).alias("json"))
    f = spark.createDataFrame([("d", "AB", 3, 7, '{"doi":"10.1/x"}'), ("e", "CD", 1, 2, None)], "doc string, md5 string, pages int, runtime int, metadata string")
    got = {r.doc: json.loads(r.json) for r in sinks.file_envelopes(m, f, "doc", "json", "at", "lectern", "1", "2024-01-01").collect()}
    assert got["e"]["mentions"] == [] and got["e"]["metadata"] == {} and got["d"]["metadata"]["doi"] == "10.1/x" and got["d"]["md5"] == "AB"
    assert [x["software-name"]["rawForm"] for x in got["d"]["mentions"]] == ["Bar", "Foo"] and "version" not in got["d"]["mentions"][0]
    assert got["d"]["mentions"][1]["mentionContextAttributes"] == {"used": {"value": True, "score": 0.9}}
    t = spark.createDataFrame([("d", 2, "b"), ("d", 1, "<rs>a</rs>")], "doc string, no int, xml string")
    tei = sinks.tei_document(t, "doc", "no", "xml", F.lit("A & B")).first().tei
    assert "<title>A &amp; B</title>" in tei and tei.endswith("<body><p><rs>a</rs></p><p>b</p></body></text></TEI>") and xml.parse(tei) is not None


def test_mentions_of_a_tei_document_with_their_references(spark):
    from lectern.plans.pipeline import tei_mentions

    doc = '<TEI><text><body><p>We used Foo 2.1 <ref type="bibr" target="#b0">[1]</ref> and <ref type="bibr" target="#b7">[8]</ref>. Foo again.</p></body><back><listBibl><biblStruct xml:id="b0"><analytic><title level="a">On Foo</title></analytic></biblStruct></listBibl></back></text></TEI>'
    tei = spark.createDataFrame([("d", doc), ("e", None)], "doc_id string, xml string")
    got = tei_mentions(tei, spark.createDataFrame([("Foo",)], "n string"), "n").orderBy("start").collect()
    assert [(r.term, r.start, r.version, [tuple(x) for x in r.references]) for r in got] == [("Foo", 8, "2.1", [("[1]", 0, "On Foo"), ("[8]", None, None)]), ("Foo", 29, None, [])]
