"""Texts to mentions: dictionary, greedy choice, versions beside names, sentence contexts, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import normalize
from lectern.operators import match, spans
from lectern.session import cut_table
from lectern.sources.sinks import mention_json
from lectern.sources.xml import tei_bibliography, tei_paragraphs

VERSION_BESIDE = r"^[ \n]*\(?(?:[vV]ersion|[vV]er|[vV]|[rR]elease)? ?\.? ?([0-9]+(?:\.[0-9]+)*)"


def extract_mentions(texts: DataFrame, names: DataFrame, name: str, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """keys, term, start, end, version, sentence_start, sentence_end, json. The text is joined back once, on its key."""
    hits = match.dictionary_hits(texts, match.lexicon(names, name), keys, text)
    kept = match.non_overlapping(hits.select(*keys, "term", F.col("start").cast("int"), F.col("end").cast("int")), list(keys), extra=("term",))
    inside = spans.containing(kept, spans.sentence_spans(texts, list(keys), text), list(keys))
    beside = F.expr(f"substring({text}, end + 1, 40)")
    j = inside.join(texts.select(*keys, text), list(keys)).withColumn("version", F.nullif(normalize.version(F.regexp_extract(beside, VERSION_BESIDE, 0).substr(1, 40)), F.lit("")))
    context = F.expr(f"substring({text}, unit_start + 1, unit_end - unit_start)")
    out = mention_json(F.lit("software"), F.col("term"), F.col("start"), F.col("end"), {"version": F.col("version"), "context": normalize.context(context)})
    return j.select(*keys, "term", "start", "end", "version", F.col("unit_start").alias("sentence_start"), F.col("unit_end").alias("sentence_end"), out.alias("json"))


def tei_mentions(tei: DataFrame, names: DataFrame, name: str, doc: str = "doc_id", xml: str = "xml", gap: int = 10) -> DataFrame:
    """Mentions of TEI documents with their references: paragraphs, dictionary and versions as in extract_mentions, callouts that follow in
    the paragraph, chained within ``gap`` characters, met with the bibliography by their target. Output: that of extract_mentions by document and
    paragraph, and references (array of label, ref_key, title), empty if there are none."""
    p = cut_table(tei_paragraphs(tei, doc, xml))
    keys = ["doc_id", "para_no"]
    found = cut_table(extract_mentions(p.select(*keys, "text"), names, name, tuple(keys)))
    calls = p.select(*keys, F.explode("callouts").alias("c")).select(*keys, F.col("c.start").alias("c0"), F.col("c.end").alias("c1"), F.struct(F.col("c.target").alias("target"), F.col("c.label").alias("label")).alias("ref"))
    inside = found.join(calls, keys).where(F.col("c0") >= F.col("end"))
    chained = spans.attach_callouts(found.select(*keys, F.col("start").alias("id"), "end"), inside.select(*keys, F.col("start").alias("id"), "ref", F.col("c0").alias("start"), F.col("c1").alias("end")).distinct(), [*keys, "id"], gap=gap)
    bib = tei_bibliography(tei, doc, xml).select("doc_id", F.col("xml_id").alias("target"), "ref_key", "title")
    refs = chained.select("doc_id", "para_no", "id", "ref.target", "ref.label").join(bib, ["doc_id", "target"], "left")
    refs = refs.groupBy("doc_id", "para_no", F.col("id").alias("start")).agg(F.array_sort(F.collect_set(F.struct("label", "ref_key", "title"))).alias("references"))
    none = "cast(array() as array<struct<label:string,ref_key:int,title:string>>)"
    return found.join(refs, ["doc_id", "para_no", "start"], "left").withColumn("references", F.coalesce("references", F.expr(none)))
