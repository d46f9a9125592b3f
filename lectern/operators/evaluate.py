"""Labels to chunks, and scores of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def begin_labels(tokens: DataFrame, keys: list[str], label: str = "label", order: str = "pos") -> DataFrame:
    """I- before the first label of a run."""
    before = F.lag(label).over(Window.partitionBy(*keys).orderBy(order))
    begins = (F.col(label) != "<other>") & ~F.col(label).eqNullSafe(before)
    return tokens.withColumn("iob", F.when(begins, F.concat(F.lit("I-"), F.col(label))).otherwise(F.col(label)))


def chunks(tokens: DataFrame, keys: list[str], iob: str = "iob", order: str = "pos") -> DataFrame:
    """Gaps and islands: keys, label, first, last of every labelled run."""
    w = Window.partitionBy(*keys).orderBy(order)
    label = F.regexp_replace(iob, "^I-", "")
    starts = F.when(F.col(iob).startswith("I-") | ~label.eqNullSafe(F.lag(label).over(w)), 1).otherwise(0)
    t = tokens.select(*keys, F.col(order).alias("_at"), label.alias("label"), starts.alias("_begins"))
    t = t.withColumn("_island", F.sum("_begins").over(Window.partitionBy(*keys).orderBy("_at")))
    return t.where("label <> '<other>'").groupBy(*keys, "_island", "label").agg(F.min("_at").alias("first"), F.max("_at").alias("last")).drop("_island")


def prf(gold: DataFrame, found: DataFrame, on: list[str], by: str) -> DataFrame:
    """by, expected, predicted, correct, precision, recall, f1 by a full outer join."""
    g, f = gold.select(*on).distinct().withColumn("g", F.lit(1)), found.select(*on).distinct().withColumn("f", F.lit(1))
    j = g.join(f, on, "full").groupBy(by).agg(F.count("g").alias("expected"), F.count("f").alias("predicted"), F.sum((F.col("g").isNotNull() & F.col("f").isNotNull()).cast("int")).alias("correct"))
    p = F.col("correct") / F.when(F.col("predicted") > 0, F.col("predicted"))
    r = F.col("correct") / F.when(F.col("expected") > 0, F.col("expected"))
    return j.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * p * r / F.when(p + r > 0, p + r))
