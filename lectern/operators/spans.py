"""Joins of intervals and nearest neighbours on positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def containing(spans: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Each span with the first unit (start, end renamed unit_start, unit_end) that covers it; equi join on the keys."""
    u = units.select(*keys, F.col("start").alias("unit_start"), F.col("end").alias("unit_end"))
    j = spans.join(u, keys).where((F.col("unit_start") <= F.col("start")) & (F.col("end") <= F.col("unit_end")))
    first = F.min(F.struct("unit_start", "unit_end")).alias("u")
    return j.groupBy(*spans.columns).agg(first).select(*spans.columns, "u.unit_start", "u.unit_end")


def attach_nearest(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Attach attribute chunks to the name before or after: the one before wins if its distance is at most twice the other.

    chunks: keys, start, end, role ('name' or an attribute), id. Two windows instead of a join; of several chunks of one role the
    closest keeps the name, ties the first. Output: keys, id, role, name_id, distance."""
    back = Window.partitionBy(*keys).orderBy("start", "end", "id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("start", "end", "id").rowsBetween(1, Window.unboundedFollowing)
    name = F.when(F.col("role") == "name", F.struct("id", "start", "end"))
    c = chunks.withColumn("prev", F.last(name, ignorenulls=True).over(back)).withColumn("next", F.first(name, ignorenulls=True).over(ahead))
    c = c.where("role <> 'name'").withColumn("dp", F.col("start") - F.col("prev.end")).withColumn("dn", F.col("next.start") - F.col("end"))
    use_prev = F.col("prev").isNotNull() & (F.col("next").isNull() | (F.col("dp") <= 2 * F.col("dn")))
    c = c.withColumn("name_id", F.when(use_prev, F.col("prev.id")).otherwise(F.col("next.id"))).withColumn("distance", F.when(use_prev, F.col("dp")).otherwise(F.col("dn"))).where("name_id is not null")
    best = Window.partitionBy(*keys, "name_id", "role").orderBy("distance", "start", "id")
    return c.withColumn("rn", F.row_number().over(best)).where("rn = 1").select(*keys, "id", "role", "name_id", "distance")


def attach_callouts(entities: DataFrame, callouts: DataFrame, keys: list[str], gap: int = 5) -> DataFrame:
    """Chained callouts: one attaches if it starts within the limit, which then moves to its end + gap.

    entities: keys, id, start, end (last end of the entity). callouts: keys, ref, start, end. An ordered fold over the callouts that
    follow an entity. Output: keys, id, ref."""
    c = callouts.select(*keys, F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("ref").alias("r")).alias("c"))
    after = entities.join(c, keys).where(F.col("c.s") >= F.col("end")).groupBy(*keys, "id", "end").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    zero = F.struct((F.col("end") + gap).cast("int").alias("limit"), F.slice("cs", 1, 0).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        ok = x["s"] <= acc["limit"]
        return F.struct(F.when(ok, x["e"] + gap).otherwise(acc["limit"]).cast("int").alias("limit"), F.when(ok, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return after.select(*keys, "id", F.explode(F.aggregate("cs", zero, step, lambda a: a["kept"])).alias("k")).select(*keys, "id", F.col("k.r").alias("ref"))


def in_zone(spans: DataFrame, zones: DataFrame, keys: list[str], flag: str = "in_zone") -> DataFrame:
    """A flag: whether the span meets a zone."""
    z = zones.select(*keys, F.col("start").alias("z0"), F.col("end").alias("z1"))
    hit = spans.join(z, keys).where(overlaps(F.col("start"), F.col("end"), F.col("z0"), F.col("z1"))).select(*spans.columns).distinct().withColumn(flag, F.lit(True))
    return spans.join(hit, spans.columns, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def sentence_spans(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A plain splitter for offsets: a mark of .!? and blanks end a sentence. keys, start, end; spans cover the text."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[^.!?]*[.!?]+[ \n]*|[^.!?]+"), F.lit(0))
    p = texts.select(*keys, F.posexplode_outer(parts).alias("no", "part")).where("no is not null")
    end = F.sum(F.length("part")).over(Window.partitionBy(*keys).orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    return p.select(*keys, "no", "part", end.alias("end")).select(*keys, "no", (F.col("end") - F.length("part")).alias("start"), "end")
