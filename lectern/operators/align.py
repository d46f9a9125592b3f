"""Alignment of annotations and paragraphs that come from different renderings of one text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lectern.functions.normalize import signature
from lectern.functions.tokens import count_tokens, tokenize


def field_in_quote(quote: Column, field: Column) -> Column:
    """Place of the first occurrence of a field in its quote, whatever the case; -1 if there's none."""
    return F.instr(F.lower(quote), F.lower(field)) - 1


def side_signatures(text: Column, start: Column, end: Column, reach: int = 10) -> tuple[Column, Column]:
    """Letters and digits of so many characters left and right of a span."""
    left = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, start - F.greatest(start - reach, F.lit(0)))
    return signature(left), signature(F.substring(text, end + 1, F.lit(reach)))


def transferred(spans: DataFrame, columns: list[str], order: str) -> DataFrame:
    """spans whose empty columns come from the first span of the same text and the same context. spans: text, left, right and the columns."""
    w = Window.partitionBy("text", "left", "right").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return spans.withColumns({c: F.coalesce(c, F.first(c, ignorenulls=True).over(w)) for c in columns})


def nearest_occurrence(texts: DataFrame, fields: DataFrame, key: str, reach: dict[str, int]) -> DataFrame:
    """key, id, pos, distance: the occurrence of each field nearest to its name, closer than its label's reach in tokens.

    fields: key, id, label, raw, anchor (a character of the text). An equi join on text and first token; ties take the earlier one."""
    t = texts.select(key, tokenize(F.col("text")).alias("tokens"), "text")
    f = fields.where("raw <> ''").select(key, "id", "label", "anchor", tokenize(F.col("raw")).alias("words"))
    j = f.join(t, key).withColumn("at", count_tokens(F.expr("left(text, anchor)")))
    n = F.size("words")
    places = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.slice("tokens", i + 1, n) == F.col("words"))
    hit = j.where("size(tokens) > 0").select(key, "id", "label", "at", F.explode(places).alias("pos"))
    hit = hit.withColumn("distance", F.abs(F.col("pos") - F.col("at")))
    near = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in reach.items()])
    best = hit.where(F.col("distance") < near).groupBy(key, "id").agg(F.min(F.struct("distance", "pos")).alias("b"))
    return best.select(key, "id", "b.pos", "b.distance")


def merged_sentences(units: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end of sentences, those joined that a span straddles. units, spans: keys, start, end."""
    s = spans.select(*keys, F.col("start").alias("s0"), F.col("end").alias("s1"))
    crossed = units.join(s, keys).where((F.col("start") > F.col("s0")) & (F.col("start") < F.col("s1"))).select(*keys, "start").distinct().withColumn("joined", F.lit(0))
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.sum(F.coalesce("joined", F.lit(1))).over(w)
    return units.join(crossed, [*keys, "start"], "left").withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


def _words(c: str) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def _windows(words: str, k: int) -> Column:
    """All runs of k words, each in one."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, k), "")))


def aligned_paragraphs(left: DataFrame, right: DataFrame, doc: str, names: DataFrame, least: float = 0.5, k: int = 3) -> DataFrame:
    """left_id, right_id, how: each left paragraph with the right one of its document that is equal by signature, else contains it or is
    contained, else holds all its names and is more than ``least`` similar (Ratcliff and Obershelp, only there in Python).

    left, right: doc, id, text. names: id (of a left paragraph), name. Candidates meet by keys, never all with all: equal signatures, the
    first k words of one among those of the other, the first token of a name. Paragraphs of fewer than k words align if they are equal or
    similar. Of several the best kind, then the most similar, then the smallest id."""
    a = left.select(doc, F.col("id").alias("left_id"), F.col("text").alias("ta"), signature(F.col("text")).alias("sa"), _words("text").alias("wa")).where("sa <> ''")
    b = right.select(doc, F.col("id").alias("right_id"), F.col("text").alias("tb"), signature(F.col("text")).alias("sb"), _words("text").alias("wb")).where("sb <> ''")
    own = names.where("name <> ''").select(F.col("id").alias("left_id"), "name", tokenize(F.col("name"))[0].alias("key"))
    head = lambda w: F.when(F.size(w) >= k, F.array_join(F.slice(w, 1, k), ""))
    ids = lambda df, x, c: df.select(doc, f"{x}_id", c.alias("key"))
    keyed = [(ids(a, "left", F.col("sa")), ids(b, "right", F.col("sb"))), (ids(a, "left", head("wa")), ids(b, "right", F.explode(_windows("wb", k)))), (ids(a, "left", F.explode(_windows("wa", k))), ids(b, "right", head("wb")))]
    keyed.append((a.select(doc, "left_id").join(own.select("left_id", "key"), "left_id").distinct(), ids(b, "right", F.explode(F.array_distinct(tokenize(F.col("tb")))))))
    pairs = None
    for x, y in keyed:
        p = x.join(y, [doc, "key"]).select(doc, "left_id", "right_id")
        pairs = p if pairs is None else pairs.unionByName(p)
    all_names = own.groupBy("left_id").agg(F.collect_set("name").alias("names"))
    full = pairs.distinct().join(a.drop("wa"), [doc, "left_id"]).join(b.drop("wb"), [doc, "right_id"]).join(all_names, "left_id", "left")
    how = F.when(F.col("sa") == F.col("sb"), "equal").when(F.contains("sb", "sa") | F.contains("sa", "sb"), "contained").when(F.forall("names", lambda n: F.contains(F.col("tb"), n)), "similar")
    found = full.withColumn("how", how).where("how is not null")
    sure = found.where("how <> 'similar'").withColumn("score", F.lit(1.0))
    doubtful = found.where("how = 'similar'").withColumn("score", F.pandas_udf(_similarity, DoubleType())("ta", "tb")).where(F.col("score") > least)
    rank = F.when(F.col("how") == "equal", 0).when(F.col("how") == "contained", 1).otherwise(2)
    best = sure.unionByName(doubtful).groupBy("left_id").agg(F.min(F.struct(rank.alias("r"), (-F.col("score")).alias("s"), "right_id", "how")).alias("b"))
    return best.select("left_id", "b.right_id", "b.how")
