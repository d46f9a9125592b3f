"""Tokenizer: one pattern without lookaround, the same in Spark and DuckDB. Tokens concatenate to the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: delimiter characters, as code points
DELIMITERS = (
    0x20, 0x0A, 0x0D, 0x09, 0x28, 0xFF08, 0x5B, 0x5E, 0x25, 0x2030, 0xB0, 0x2022, 0x2A, 0x2C, 0x3A, 0x3B, 0x3F, 0x2E, 0x21, 0x2F, 0x29, 0xFF09, 0x2D, 0x2013, 0x2212,
    0x2010, 0xAB, 0xBB, 0x201E, 0x3D, 0x2248, 0x3C, 0x3E, 0x2B, 0x7E, 0x22, 0x201C, 0x201D, 0x2018, 0x2019, 0x27, 0x60, 0x24, 0xAE, 0x5D, 0x2666, 0x2665, 0x2663, 0x2660, 0xA0,
)
D = "".join(f"\\x{{{c:X}}}" for c in DELIMITERS)
PATTERN = f"[{D}]|(?:[^{D}0-9]*[^{D}0-9a-zA-Z])?[0-9]+|[^{D}0-9]+"

#: The same tokens for Java's matcher, without backtracking: digits join what is before them unless that is a letter.
FAST = f"[{D}]|[^{D}0-9]++(?:(?<![a-zA-Z])[0-9]++)?|[0-9]++"


def tokenize(text: Column) -> Column:
    """All tokens in order; null gives null."""
    return F.regexp_extract_all(text, F.lit(FAST), F.lit(0))


def offsets(tokens: Column) -> Column:
    """array<struct<pos, token, start, end>> of a token array, end exclusive."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<pos:int,token:string,start:int,end:int>>)").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(t)
        one = F.struct(F.size(acc["out"]).alias("pos"), t.alias("token"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(tokens, zero, step, lambda acc: acc["out"])


def token_table(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per token with its place: keep, pos, token, start, end (end exclusive).

    Places come from a running sum of lengths; the window is per text, so no text is shuffled whole."""
    from pyspark.sql import Window

    t = df.select(*keep, F.posexplode_outer(tokenize(F.col(text))).alias("pos", "token")).where("pos is not null")  # else a filter on their size tokenises twice more
    w = Window.partitionBy(*keep).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("token")).over(w)
    return t.select(*keep, "pos", "token", end.alias("end")).select(*keep, "pos", "token", (F.col("end") - F.length("token")).alias("start"), "end")


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(FAST))


def without_spaces(tokens: Column) -> Column:
    """Tokens but single spaces."""
    return F.filter(tokens, lambda t: t != " ")


def is_long(tokens: Column, cap: int = 512) -> Column:
    return F.size(tokens) > cap
