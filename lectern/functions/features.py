"""Token features and context windows. Letters, digits and marks are those of all scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_class(t: Column) -> Column:
    return F.when(t.rlike(r"\p{Lu}") & ~t.rlike(r"[^\p{Lu}\p{M}\p{Nd}]"), "ALLCAP").when(t.rlike(r"^\p{Lu}"), "INITCAP").otherwise("NOCAPS")


def digit_class(t: Column) -> Column:
    return F.when(t.rlike(r"^\p{Nd}+$"), "ALLDIGIT").when(t.rlike(r"\p{Nd}"), "CONTAINDIGIT").otherwise("NODIGIT")


def punctuation_class(t: Column) -> Column:
    return (
        F.when(t.isin("(", "[", "（"), "OPENBRACKET")
        .when(t.isin(")", "]", "）"), "ENDBRACKET")
        .when(t == ".", "DOT")
        .when(t == ",", "COMMA")
        .when(t == "-", "HYPHEN")
        .when(t.isin('"', "'", "`", *"“”„‘’«»"), "QUOTE")
        .when(t.rlike(r"^[^\p{L}\p{M}\p{N}]+$"), "PUNCT")
        .otherwise("NOPUNCT")
    )


def shape(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"\p{Nd}", "d")


def squeezed(s: Column) -> Column:
    """Runs of one shape letter once."""
    for c in "Xxd":
        s = F.regexp_replace(s, f"{c}+", c)
    return s


def feature_row(token: Column) -> list[Column]:
    t = token
    affixes = [F.left(t, F.lit(i)).alias(f"prefix{i}") for i in range(1, 6)] + [F.right(t, F.lit(i)).alias(f"suffix{i}") for i in range(1, 6)]
    return [
        t.alias("token"), F.lower(t).alias("lower"), *affixes, case_class(t).alias("caps"), digit_class(t).alias("digits"), (F.length(t) == 1).alias("single"),
        punctuation_class(t).alias("punct"), F.regexp_replace(t, r"\p{Nd}", "0").alias("shadow"), shape(t).alias("shape"), squeezed(shape(t)).alias("trimmed_shape"),
    ]


def context_window(tokens: DataFrame, keys: list[str], column: str = "token", order: str = "pos", reach: int = 4) -> DataFrame:
    """The column at -reach..+reach and its bigrams with the neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = {k: (F.lag(column, -k) if k < 0 else F.lead(column, k)).over(w) for k in range(-reach, reach + 1) if k}
    named = [c.alias(f"m{-k}" if k < 0 else f"p{k}") for k, c in at.items()]
    return tokens.select(*keys, order, column, *named, F.concat_ws("|", at[-1], F.col(column)).alias("bigram_left"), F.concat_ws("|", F.col(column), at[1]).alias("bigram_right"))
