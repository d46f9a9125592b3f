"""Entities over a document: copying and merging between equal names, document attributes, the knowledge-base rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def copy_first(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Fill missing columns from the first row of the same keys that has them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(w)) for c in columns})


def document_attributes(mentions: DataFrame, doc: str, names: list[str], flags: list[str]) -> DataFrame:
    """Any value and the best score of each flag over all mentions sharing one of the names; rows keep their own columns.

    mentions: id, doc, names, <flag> boolean, <flag>_score double. A mention belongs to the group of each of its names."""
    keyed = mentions.select("*", F.explode(F.array_distinct(F.array(*[F.struct(F.lit(n).alias("by"), F.col(n).alias("key")) for n in names]))).alias("k")).where("k.key is not null")
    g = keyed.groupBy(doc, "k").agg(*[F.bool_or(f).alias(f"any_{f}") for f in flags], *[F.max(f"{f}_score").alias(f"max_{f}") for f in flags])
    back = keyed.select("id", doc, "k").join(g, [doc, "k"])
    return back.groupBy("id").agg(*[F.bool_or(f"any_{f}").alias(f"doc_{f}") for f in flags], *[F.max(f"max_{f}").alias(f"doc_{f}_score") for f in flags])


def binary_class(p: Column, q: Column) -> tuple[Column, Column]:
    """(value, score) of a two-class output."""
    return (p > 0.5) & (p > q), F.when(p > q, p).otherwise(1 - q)


def kb_keep(statements: Column, types: Column) -> Column:
    """Whether a knowledge-base entry is software. statements: map of property to values."""
    has = lambda p: F.map_contains_key(statements, F.lit(p))
    meets = lambda p: F.coalesce(F.arrays_overlap(statements[p], types), F.lit(False))
    host = F.exists(F.coalesce(statements["P856"], F.array()), lambda u: u.contains("apache") | u.contains("github") | u.contains("stanford.edu"))
    props = has("P178") | has("P3499") | has("P1324") | has("P277") | has("P348")
    return meets("P31") | meets("P279") | props | host | meets("P1056") | (F.size(statements) == 0)


def hyphen_fragments(mentions: DataFrame, doc: str, name: str) -> DataFrame:
    """Names ending in a hyphen that are part of another hyphenated name of the document."""
    h = mentions.select(doc, F.col(name).alias("name")).where(F.col(name).contains("-")).distinct()
    frag = h.where(F.col("name").endswith("-"))
    other = h.select(doc, F.col("name").alias("whole"))
    return frag.join(other, doc).where((F.col("whole") != F.col("name")) & F.col("whole").contains(F.col("name"))).select(doc, "name").distinct()
