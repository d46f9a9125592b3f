"""Corpus operators: counts, agreement, corrections, alignment, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreement(labels: DataFrame, item: str, who: str, field: str, value: str, z: float = 1.96) -> DataFrame:
    """Per field: values shared by pairs of annotators of one item, samples, rate, errors and 95 % interval.

    labels: item, who, field, value (simplified). Pairs come from an equi join on the item, not on values of all items."""
    l = labels.select(item, who, field, value).distinct()
    a, b = l.alias("a"), l.alias("b")
    both = a.join(b, (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col(f"a.{field}") == F.col(f"b.{field}")) & (F.col(f"a.{who}") < F.col(f"b.{who}")))
    pairs = both.select(F.col(f"a.{item}").alias(item), F.col(f"a.{field}").alias(field), F.col(f"a.{who}").alias("x"), F.col(f"b.{who}").alias("y"), (F.col(f"a.{value}") == F.col(f"b.{value}")).cast("int").alias("same"))
    g = pairs.groupBy(field).agg(F.sum("same").alias("agreements"), F.count(F.lit(1)).alias("samples"))
    p, n = F.col("agreements") / F.col("samples"), F.col("samples")
    sd = F.sqrt(p * (1 - p))
    return g.select(field, "agreements", "samples", p.alias("rate"), (sd / n).alias("std_error_ref"), (sd / F.sqrt(n)).alias("std_error"), (p - z * sd / F.sqrt(n)).alias("low"), (p + z * sd / F.sqrt(n)).alias("high"))


def largest_run(counts: DataFrame, doc: str, n: str) -> DataFrame:
    """Sum over documents of the largest count of one annotator."""
    return counts.groupBy(doc).agg(F.max(n).alias("m")).agg(F.sum("m").alias("largest_run"))


def pivot_last(rows: DataFrame, key: str, attribute: str, value: str, order: list[str], names: list[str]) -> DataFrame:
    """One row per key with the last value of each attribute."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(*[F.max_by(F.when(F.col(attribute) == n, F.col(value)), F.when(F.col(attribute) == n, at)).alias(n) for n in names])


def hash_unit(c: Column, salt: str = "") -> Column:
    """A number in [0, 1) from a key, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / 4294967296.0


def stratified_holdout(counts: DataFrame, key: str, n: str, strata: int = 5, share: float = 0.2) -> DataFrame:
    """Rows ranked by count into bands; of each band a hashed share is held out. The rank is over counts, not over rows:
    a band is given to a whole count value by the cumulative share of rows at or below it, so no task orders all rows."""
    by = counts.groupBy(n).agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy(n)
    upto = by.select(n, (F.sum("m").over(w) / F.sum("m").over(Window.partitionBy())).alias("upto"))
    band = F.least(F.floor(F.col("upto") * strata), F.lit(strata - 1)).cast("int")
    return counts.join(upto, n).select(key, n, band.alias("band"), (hash_unit(F.col(key)) < share).alias("held_out"))


def select_negatives(scored: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The k best scored rows, ties by key (a top-k feature)."""
    return scored.orderBy(F.desc(score), key).limit(k)


def novel(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(present.select(*keys).distinct(), keys, "left_anti")


def corrections(spans: DataFrame, fixes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Spans with corrected verdicts, and the corrections that match no span. fixes: key, fixed (one row a key)."""
    return spans.join(fixes, key, "left"), fixes.join(spans.select(key).distinct(), key, "left_anti")


def neighbours(paragraphs: DataFrame, doc: str, order: str, text: str, words: int = 100) -> DataFrame:
    """Previous and next paragraphs, a second one where the first is short."""
    w = Window.partitionBy(doc).orderBy(order)
    n = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    c = paragraphs
    for k in (1, 2):
        c = c.withColumn(f"prev{k}", F.lag(text, k).over(w)).withColumn(f"next{k}", F.lead(text, k).over(w))
    for side in ("prev", "next"):
        c = c.withColumn(f"{side}2", F.when(n(F.col(f"{side}1")) < words, F.col(f"{side}2")))
    return c
