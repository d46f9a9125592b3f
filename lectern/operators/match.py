"""Dictionary matching, term statistics, propagation and greedy selection of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.tokens import tokenize

SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else the join is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lexicon(names: DataFrame, column: str) -> DataFrame:
    """term, words (its tokens), first, n; the same tokenizer as for texts."""
    t = names.select(F.col(column).alias("term")).where("term is not null and term <> ''").distinct()
    return t.select("term", tokenize(F.col("term")).alias("words")).select("term", "words", F.col("words")[0].alias("first"), F.size("words").alias("n"))


def dictionary_hits(texts: DataFrame, lex: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """keys, term, pos, n, start, end of every occurrence, nested ones included.

    Texts are tokenised once and never shuffled: the first token joins the lexicon, the rest is compared in place."""
    t = texts.select(*keys, tokenize(F.col(text)).alias("tokens"))
    at = t.select(*keys, "tokens", F.posexplode_outer("tokens").alias("pos", "first")).where("pos is not null")  # else a filter on their size tokenises twice more
    hit = at.join(small(lex), "first").where(F.slice("tokens", F.col("pos") + 1, F.col("n")) == F.col("words"))
    start = F.when(F.col("pos") > 0, F.length(F.array_join(F.slice("tokens", F.lit(1), F.greatest(F.col("pos"), F.lit(1))), ""))).otherwise(0)
    return hit.select(*keys, "term", "pos", "n", start.alias("start"), (start + F.length("term")).alias("end"))


def term_frequency(hits: DataFrame, doc: str) -> DataFrame:
    return hits.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequency(tf: DataFrame, n_docs: DataFrame, doc: str) -> DataFrame:
    """term, df, idf = ln(N / df). n_docs: one row with the number of documents."""
    df = tf.groupBy("term").agg(F.countDistinct(doc).alias("df"))
    return df.join(F.broadcast(n_docs)).select("term", "df", F.log(F.col("n_docs") / F.col("df")).alias("idf"))


def keep_term(freq: Column, idf: Column, length: Column, term: Column, threshold: float = 0.001, single: str = "R") -> Column:
    """The propagation gate: no weight known, or tf x idf above the threshold; terms of one letter only if exempt."""
    weight = freq * F.coalesce(idf, F.lit(0.0))
    return ((weight <= 0) | (weight > threshold)) & ((length > 1) | (term == single))


def non_overlapping(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", extra: tuple[str, ...] = ()) -> DataFrame:
    """Greedy choice by start, the longer first: a span is kept if it meets none that was kept before."""
    s = F.struct(F.col(start).alias("s"), (-F.col(end)).alias("e"), *[F.col(x).alias(x) for x in extra])

    def step(acc: Column, x: Column) -> Column:
        free = x["s"] >= acc["upto"]
        return F.struct(F.when(free, -x["e"]).otherwise(acc["upto"]).cast("int").alias("upto"), F.when(free, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    g = spans.groupBy(*keys).agg(F.array_sort(F.collect_set(s)).alias("all"))
    zero = F.struct(F.lit(-1).alias("upto"), F.slice("all", 1, 0).alias("kept"))
    kept = g.select(*keys, F.explode(F.aggregate("all", zero, step, lambda a: a["kept"])).alias("x"))
    return kept.select(*keys, F.col("x.s").alias(start), (-F.col("x.e")).cast("int").alias(end), *[F.col(f"x.{x}").alias(x) for x in extra])


def propagate(hits: DataFrame, known: DataFrame, taken: DataFrame, doc: str, seg: str, idf: DataFrame) -> DataFrame:
    """Document-wide propagation: of all occurrences of terms, those of terms known in their document; gated by tf x idf, off taken spans.

    hits: doc, seg, term, start, end (see dictionary_hits), read twice, so a written table. known: doc, term. taken: seg, start, end. idf: term, idf."""
    own = hits.join(known.select(doc, "term").distinct(), [doc, "term"], "left_semi")
    gated = own.join(term_frequency(own, doc), [doc, "term"]).join(idf.select("term", "idf"), "term", "left").where(keep_term(F.col("tf"), F.col("idf"), F.length("term"), F.col("term")))
    busy = taken.select(F.col(seg).alias("seg_"), F.col("start").alias("s_"), F.col("end").alias("e_"))
    free = gated.join(busy, (F.col(seg) == F.col("seg_")) & (F.col("start") < F.col("e_")) & (F.col("s_") < F.col("end")), "left_anti")
    return non_overlapping(free, [doc, seg], extra=("term",))
