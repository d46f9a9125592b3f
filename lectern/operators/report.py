"""Tables of a corpus: counters, averaged agreement, scores of attachments and labels, samples, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def averaged(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Two tables of statistics field by field: counts are added, ``columns`` averaged; a field of one table only is kept as it is."""
    j = a.withColumnsRenamed({c: f"a_{c}" for c in a.columns if c != key}).join(b.withColumnsRenamed({c: f"b_{c}" for c in b.columns if c != key}), key, "full")
    both = lambda c: F.when(F.col(f"a_{c}").isNull(), F.col(f"b_{c}")).when(F.col(f"b_{c}").isNull(), F.col(f"a_{c}"))
    mean = [both(c).otherwise((F.col(f"a_{c}") + F.col(f"b_{c}")) / 2).alias(c) for c in columns]
    total = [both(c).otherwise(F.col(f"a_{c}") + F.col(f"b_{c}")).alias(c) for c in a.columns if c != key and c not in columns]
    return j.select(key, *total, *mean)


def rates(correct: Column, predicted: Column, expected: Column) -> list[Column]:
    """precision, recall, f1; 0 where there is nothing to divide by."""
    p = F.when(predicted > 0, correct / predicted).otherwise(0.0)
    r = F.when(expected > 0, correct / expected).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def label_scores(pairs: DataFrame, total: int | Column) -> DataFrame:
    """label, accuracy, precision, recall, f1, support from pairs of gold and found labels with counts: gold, found, n."""
    one = pairs.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), (F.col("gold") == F.col("found")).cast("int").alias("f")), F.struct(F.col("found").alias("label"), (F.col("gold") == F.col("found")).cast("int").alias("g"), F.lit(1).alias("f")))).alias("x"), "gold", "found", "n")
    # an equal pair comes twice and counts half each time
    w = F.when(F.col("gold") == F.col("found"), F.col("n") / 2).otherwise(F.col("n").cast("double"))
    s = one.groupBy("x.label").agg(F.sum(w * F.col("x.g")).alias("support"), F.sum(w * F.col("x.f")).alias("predicted"), F.sum(F.when(F.col("gold") == F.col("found"), w)).alias("c"))
    c = F.coalesce("c", F.lit(0.0))
    wrong = F.col("support") + F.col("predicted") - 2 * c
    return s.select("label", (1 - wrong / total).alias("accuracy"), *rates(c, F.col("predicted"), F.col("support")), F.col("support").cast("bigint").alias("support"))


def every_kth(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """Each k-th row of every group, in order; groups are spread over the cluster, so no task orders all rows."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") % k == 0).drop("_n")


def missing_titles(df: DataFrame, titles: DataFrame, key: str, column: str) -> DataFrame:
    """df with an empty ``column`` filled from titles (key, title)."""
    return df.join(titles.withColumnRenamed("title", "_title"), key, "left").withColumn(column, F.coalesce(F.when(F.trim(column) != "", F.col(column)), "_title")).drop("_title")


def variants(paragraphs: DataFrame, positive: DataFrame, unmatched: DataFrame, key: str) -> DataFrame:
    """variant, rows of key: the corpus with and without documents of unmatched annotations, and its positive paragraphs only."""
    p = paragraphs.select("doc", key)
    full = p.join(unmatched.select("doc").distinct(), "doc", "left_anti")
    only = full.join(positive.select(key).distinct(), key, "left_semi")
    named = lambda df, name: df.select(F.lit(name).alias("variant"), "doc", key)
    return named(p, "with_unmatched").unionByName(named(full, "full")).unionByName(named(only, "positives"))


def inline_markup(texts: DataFrame, spans: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, snippet: the text with every span in a tag of its type, ids kept; spans: keys, start, end, type, id; of overlapping ones the
    first by start, the longer first. Spans outside the text are left out."""
    s = spans.join(texts.select(*keys, F.length(text).alias("n")), keys).where("start >= 0 and start < end and end <= n")
    item = F.struct(F.col("start").alias("s"), (-F.col("end")).alias("e"), F.col("type").alias("t"), F.col("id").alias("i"))
    g = s.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("all"))
    j = texts.select(*keys, F.col(text).alias("_text")).join(g, keys, "left")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def step(acc: Column, x: Column) -> Column:
        free, end = x["s"] >= acc["upto"], -x["e"]
        between, inside = F.substring("_text", acc["upto"] + 1, x["s"] - acc["upto"]), F.substring("_text", x["s"] + 1, end - x["s"])
        tag = F.concat(acc["out"], esc(between), F.lit('<rs type="'), x["t"], F.lit('" id="'), x["i"], F.lit('">'), esc(inside), F.lit("</rs>"))
        return F.struct(F.when(free, end).otherwise(acc["upto"]).cast("int").alias("upto"), F.when(free, tag).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("upto"), F.lit("").alias("out"))
    body = F.aggregate(F.coalesce("all", F.array().cast("array<struct<s:int,e:int,t:string,i:string>>")), zero, step, lambda a: F.concat(a["out"], esc(F.substring("_text", a["upto"] + 1, F.lit(2147483647)))))
    return j.select(*keys, F.concat(F.lit("<p>"), body, F.lit("</p>")).alias("snippet"))
