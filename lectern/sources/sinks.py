"""Sinks: mention JSON, envelopes, marked-up text, feature lines, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mention_json(kind: Column, name: Column, start: Column, end: Column, more: dict[str, Column] | None = None) -> Column:
    """One mention as JSON; missing parts are left out."""
    head = F.struct(name.alias("rawForm"), start.alias("offsetStart"), end.alias("offsetEnd"))
    return F.to_json(F.struct(kind.alias("software-type"), head.alias("software-name"), *[c.alias(k) for k, c in (more or {}).items()]))


def envelopes(mentions: DataFrame, doc: str, json_col: str, order: str, application: str, version: str) -> DataFrame:
    """One answer per document: its mentions in order."""
    m = mentions.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, json_col))), lambda x: x[json_col]).alias("m"))
    head = F.format_string('{"application":"%s","version":"%s","mentions":[%s]}', F.lit(application), F.lit(version), F.array_join("m", ","))
    return m.select(doc, head.alias("json"))


def mention_record(parts: dict[str, Column], context: Column, offset: Column, used: Column, score: Column, references: Column) -> Column:
    """A whole mention as JSON: its fields (each with form and offsets, or null), context with its place, usage with score, references."""
    attributes = F.struct(F.struct(used.alias("value"), score.alias("score")).alias("used"))
    return F.to_json(F.struct(F.lit("software").alias("type"), *[c.alias(k) for k, c in parts.items()], context.alias("context"), offset.alias("contextOffset"), attributes.alias("mentionContextAttributes"), references.alias("references")))


def file_envelopes(mentions: DataFrame, files: DataFrame, doc: str, json_col: str, order: str, application: str, version: str, date: str) -> DataFrame:
    """One answer per file, also for files without mentions. files: doc, md5, pages, runtime and metadata (a JSON object or null)."""
    m = mentions.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, json_col))), lambda x: x[json_col]).alias("m"))
    j = files.join(m, doc, "left")
    head = F.to_json(F.struct(F.lit(application).alias("application"), F.lit(version).alias("version"), F.lit(date).alias("date"), F.col("md5"), F.col("pages"), F.col("runtime")))
    body = F.concat(F.lit(',"metadata":'), F.coalesce("metadata", F.lit("{}")), F.lit(',"mentions":['), F.coalesce(F.array_join("m", ","), F.lit("")), F.lit("]}"))
    return j.select(doc, F.concat(F.regexp_replace(head, r"\}$", ""), body).alias("json"))


def tei_document(paragraphs: DataFrame, doc: str, order: str, xml: str, title: Column) -> DataFrame:
    """doc, tei: a header with the title and the marked-up paragraphs in order."""
    esc = F.replace(F.replace(F.coalesce(title, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    g = paragraphs.groupBy(doc).agg(F.first(esc).alias("title"), F.transform(F.array_sort(F.collect_list(F.struct(order, xml))), lambda x: F.concat(F.lit("<p>"), x[xml], F.lit("</p>"))).alias("p"))
    return g.select(doc, F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), "title", F.lit("</title></titleStmt></fileDesc></teiHeader><text><body>"), F.array_join("p", ""), F.lit("</body></text></TEI>")).alias("tei"))


def distinct_references(refs: DataFrame, doc: str, key: str, order: str) -> DataFrame:
    """One row per reference key in the order of first use."""
    return refs.groupBy(doc, key).agg(F.min(order).alias("first_use"))


def marked_up(texts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Text with <rs type=...> around non-overlapping spans (start, end, type); text is escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    s = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("spans"))
    j = texts.join(s, keys, "left").withColumn("spans", F.coalesce("spans", F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("type"))), 1, 0)))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = F.substr(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        own = F.substr(F.col("text"), x["start"] + 1, x["end"] - x["start"])
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], escape(before), F.lit('<rs type="'), x["type"], F.lit('">'), escape(own), F.lit("</rs>")).alias("out"))

    j = j.withColumn("f", F.aggregate("spans", zero, step))
    return j.select(*keys, F.concat(F.col("f.out"), escape(F.expr("substring(text, f.at + 1)"))).alias("xml"))


def feature_lines(features: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """Space separated features; the label last."""
    return features.select(F.concat_ws(" ", *columns, *([label] if label else [])).alias("value"))


def corpus_json(identifier: Column, title: Column, text: Column, annotations: Column) -> Column:
    return F.to_json(F.struct(identifier.alias("identifier"), title.alias("title"), text.alias("text"), annotations.alias("annotations")))


def term_vector(names: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """Distinct names, case-insensitive order within each bucket of the first letter, weight 1.0: one JSON line per bucket."""
    d = names.select(F.col(name).alias("term")).where("term is not null").distinct()
    g = d.groupBy(F.lower(F.left("term", F.lit(1))).alias("letter")).agg(F.array_sort(F.collect_list(F.struct(F.lower("term").alias("k"), "term"))).alias("x"))
    return g.select("letter", F.to_json(F.transform("x", lambda t: F.struct(t["term"].alias("term"), F.lit(1.0).alias("score")))).alias("json"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
