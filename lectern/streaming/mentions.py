"""The same operators on streams: stateless matching, and document attributes by sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.match import dictionary_hits


def stream_hits(stream: DataFrame, lex: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Dictionary hits of a stream of texts; the static lexicon is joined in place, so no state is kept."""
    return dictionary_hits(stream, lex, keys)


def stream_attributes(mentions: DataFrame, doc: str, name: str, flag: str, score: str, at: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Any value and best score per document and name, once a document has been quiet for the gap; later rows than the watermark are dropped."""
    m = mentions.withWatermark(at, late)
    g = m.groupBy(F.session_window(at, gap).alias("session"), doc, name).agg(F.bool_or(flag).alias(flag), F.max(score).alias(score), F.count(F.lit(1)).alias("mentions"))
    return g.select(doc, name, flag, score, "mentions", F.col("session.end").alias("until"))


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
