"""Refinement of spans: validity of chunks, types and languages of names, links between mentions, callouts, context classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.spans import overlaps

# fixed values: a URL in running text
URL_IN_TEXT = r"(?:https?|ftp)://[-A-Za-z0-9+&@#/%?=~_|!:,.;]*[-A-Za-z0-9+&@#/%=~_|]"


def pattern_spans(texts: DataFrame, keys: list[str], pattern: str, text: str = "text") -> DataFrame:
    """keys, match, start, end of every match, in characters; texts are read in place, a fold adds up what lies between the matches."""
    found, between = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)
    t = texts.select(*keys, found.alias("found"), between.alias("between")).where("size(found) > 0")
    pair = F.zip_with(F.slice("between", F.lit(1), F.size("found")), "found", lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("match")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x["match"].alias("match"), start.alias("start"), end.alias("end")))).alias("out"))

    return t.select(*keys, F.explode(F.aggregate(pair, zero, step, lambda a: a["out"])).alias("m")).select(*keys, "m.match", "m.start", "m.end")


def is_chunk(label: Column, content: Column, delimiters: str, stopword: Column, blacklisted: Column) -> Column:
    """Whether a labelled chunk is well formed: by label no lone delimiter, no stopword, no number, no black-listed name."""
    c = F.trim(content)
    lone, number = F.instr(F.lit(delimiters), c) > 0, c.rlike("^[0-9]+$")
    common = ~(lone | stopword | number)
    broken = c.startswith("-") & c.contains("\n")
    return (
        F.when(label == "software", common & ~blacklisted)
        .when(label == "url", common & (F.replace(c, F.lit("\n"), F.lit("")) != "//"))
        .when(label == "version", ~lone)
        .when(label == "publisher", common & ~broken)
        .otherwise(common)
    )


def refine_types(names: DataFrame, types: DataFrame, keys: list[str], reach: int = 20) -> DataFrame:
    """Names with the types and languages found beside them. names: keys, id, start, end, raw; types: keys, tid, t0, t1, traw, type.

    The first overlapping type other than a language sets the type. A language that begins or ends a longer name is cut off it and
    becomes its language; one that is the name makes it an environment; one that meets no name goes to the nearest within ``reach``
    characters, the one before if both are as near. An implicit type that meets no name is a name of its own.
    Output: keys, id, start, end, raw, type, language."""
    j = names.join(types, keys).where(overlaps(F.col("start"), F.col("end"), F.col("t0"), F.col("t1")))
    exact = (F.col("t0") == F.col("start")) & (F.col("t1") == F.col("end"))
    is_lang = F.col("type") == "language"
    lead, trail = is_lang & ~exact & F.startswith("raw", "traw"), is_lang & ~exact & F.endswith("raw", "traw")
    first = lambda cond, *c: F.min(F.when(cond, F.struct("t0", "tid", *c)))
    own = j.groupBy(*keys, "id").agg(first(~is_lang, "type").alias("other"), first(lead | trail, "traw", lead.alias("lead")).alias("cut"), F.max(is_lang & exact).alias("env"))
    used = j.select(*keys, "tid").distinct()
    free = types.join(used, [*keys, "tid"], "left_anti")
    near = names.join(free.where(is_lang), keys).withColumn("d", F.when(F.col("end") <= F.col("t0"), F.col("t0") - F.col("end")).otherwise(F.col("start") - F.col("t1"))).where((F.col("d") >= 0) & (F.col("d") < reach))
    to = near.groupBy(*keys, "tid", "traw").agg(F.min(F.struct("d", "start", "id")).alias("n")).select(*keys, F.col("n.id").alias("id"), F.struct(F.col("n.d").alias("d"), "tid", "traw").alias("x"))
    to = to.groupBy(*keys, "id").agg(F.min("x").alias("near"))
    r = names.join(own, [*keys, "id"], "left").join(to, [*keys, "id"], "left")
    is_lead = F.coalesce(F.col("cut.lead"), F.lit(False))
    rest = F.when(F.col("cut").isNull(), F.col("raw")).when(is_lead, F.ltrim(F.expr("substring(raw, length(cut.traw) + 1)"))).otherwise(F.rtrim(F.expr("left(raw, length(raw) - length(cut.traw))")))
    lost = F.length("raw") - F.length(rest)
    out = r.select(
        *keys, "id", F.when(is_lead, F.col("start") + lost).otherwise(F.col("start")).alias("start"), F.when(F.col("cut").isNotNull() & ~is_lead, F.col("end") - lost).otherwise(F.col("end")).alias("end"),
        rest.alias("raw"), F.when(F.coalesce("env", F.lit(False)), "environment").otherwise(F.coalesce("other.type", F.lit("software"))).alias("type"), F.coalesce("cut.traw", "near.traw").alias("language"),
    )
    implicit = free.where("type = 'implicit'").select(*keys, F.col("tid").alias("id"), F.col("t0").alias("start"), F.col("t1").alias("end"), F.col("traw").alias("raw"), "type", F.lit(None).cast("string").alias("language"))
    return out.unionByName(implicit)


def copied_refs(mentions: DataFrame, doc: str, name: str, order: list[str], column: str) -> DataFrame:
    """mentions whose empty ``column`` is that of the first mention of the same name in the document that has one."""
    w = Window.partitionBy(doc, name).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return mentions.withColumn(column, F.coalesce(column, F.first(column, ignorenulls=True).over(w)))


def callout_key(marker: Column) -> Column:
    """#b<n> of a numbered marker, counted from 0; null without a number."""
    n = F.regexp_extract(marker, r"([0-9]{1,9})", 1)
    return F.when(n != "", F.concat(F.lit("#b"), (n.try_cast("bigint") - 1).cast("string")))


def context_classes(used: Column, created: Column, shared: Column, threshold: float = 0.5) -> Column:
    """The classes of a context whose probabilities exceed the threshold, in order."""
    named = F.array(*[F.when(c > threshold, F.lit(n)) for n, c in (("used", used), ("created", created), ("shared", shared))])
    return F.array_join(F.filter(named, lambda x: x.isNotNull()), ",")
