"""Splits that keep related records together: frontier breadth-first components.

Adjacency is a hash-partitioned edge table. Per level every vertex whose hash is smallest among its neighbours is a seed;
all seeds are expanded at once, frontier by frontier; a vertex reached from several seeds takes the smallest label, and edges
between different labels are the collisions, which form the smaller graph of the next level. The hashes make a level
shrink the graph by a constant factor, so levels are logarithmic in the longest chain, whatever its order of ids.

A key shared by many rows (up to a third of all) is tied by stars of several levels, each of bounded width: rows to the smallest of
their salt, those to the smallest of a wider salt, up to the smallest of the key; no pairs are made. Nothing is collected to the driver but counts.

Defined results: null keys and null words tie nothing; rows repeated in all columns count once; a row without ties is a
group of its own; an empty table gives empty tables; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.keys import author_key, corpus_key, doi_key, pmc_key
from lectern.session import cut

DOCUMENT_KEYS = {"id": corpus_key, "doi": doi_key, "pmc": pmc_key, "corresp_author": author_key}


def key_edges(df: DataFrame, id_col: str, keys: dict[str, Column], fan: int = 1024) -> DataFrame:
    """Star edges a > b between rows that share a key's value; linear in the rows, and no row has more than about ``fan`` of a key.

    Rows with one key are tied to the least of their salt, those to the least of the wider salt, up to that of the key; the number
    of such levels follows from the most frequent key. Keys are compared by kind and value."""
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("value")) for n, c in keys.items()])
    ties = df.select(F.col(id_col).alias("v"), F.explode(kinds).alias("k")).select("v", "k.kind", "k.value").where("value is not null and v is not null")
    most = ties.groupBy("kind", "value").count().agg(F.max("count")).first()[0] or 0
    edges, level = None, ties.distinct().withColumn("salt", F.xxhash64("v"))
    for wide in [fan**n for n in range(math.ceil(math.log(max(most, 2), fan)) - 1, -1, -1)]:
        level = level.withColumn("salt", F.pmod("salt", F.lit(wide))).withColumn("rep", F.min("v").over(Window.partitionBy("kind", "value", "salt")))
        own = level.where("v <> rep").select(F.col("v").alias("a"), F.col("rep").alias("b"))
        edges, level = own if edges is None else edges.unionByName(own), level.where("v = rep").drop("rep")
    return edges.distinct()


def _level(edges: DataFrame, rounds: int) -> DataFrame:
    """v, label of one level: seeds and what their frontiers reach in the given rounds; the rest label themselves."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    least = edges.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("v"), "m")
    labels = least.select("v", F.when(order("v") < F.col("m"), F.col("v")).alias("label"), F.when(order("v") < F.col("m"), 0).alias("at"))
    for i in range(rounds):
        frontier = labels.where(F.col("at") == i).select(F.col("v").alias("b"), "label")
        reached = edges.join(frontier, "b").groupBy("a").agg(F.min(order("label")).alias("m")).select(F.col("a").alias("v"), F.col("m.v").alias("new"))
        labels = labels.join(reached, "v", "left").select("v", F.coalesce("label", "new").alias("label"), F.coalesce("at", F.when(F.col("new").isNotNull(), i + 1)).alias("at"))
    return labels.select("v", F.coalesce("label", "v").alias("label"))


def components(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """v, component for every vertex of the edges; component is the smallest vertex of its group."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    now = cut(both)
    total = None
    while not now.isEmpty():
        labels = cut(_level(now, rounds))
        to = labels.withColumnRenamed("label", "to")
        if total is None:
            total = labels
        else:
            total = cut(total.join(to.withColumnRenamed("v", "label"), "label", "left").select("v", F.coalesce("to", "label").alias("label")))
        x, y = to.select(F.col("v").alias("a"), F.col("to").alias("x")), to.select(F.col("v").alias("b"), F.col("to").alias("y"))
        now = cut(now.where("a < b").join(x, "a").join(y, "b").where("x <> y").select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("e")).select("e.*").distinct())
    if total is None:
        return both.select(F.col("a").alias("v"), F.col("b").alias("component"))
    smallest = total.groupBy("label").agg(F.min("v").alias("component"))
    return total.join(smallest, "label").select("v", "component")


def related(df: DataFrame, id_col: str = "doc_id", keys: dict | None = None) -> DataFrame:
    """v, component of the rows tied to others."""
    keys = keys or DOCUMENT_KEYS
    return components(key_edges(df, id_col, {n: f(F.col(n)) for n, f in keys.items()}))


def assign_splits(df: DataFrame, id_col: str = "doc_id", keys: dict | None = None, shares: tuple = (("train", 0.8), ("valid", 0.1), ("test", 0.1)), buckets: int = 4096) -> DataFrame:
    """id_col, group, split: whole groups in the order of their hashes, cut at the given shares of rows.

    Groups larger than half the smallest share come first, so that a giant group can't overrun a small split. The running sum is
    taken over a fixed number of hash buckets and then within each, so no task orders all groups."""
    ids = df.select(F.col(id_col).alias("v")).where("v is not null").distinct()
    member = cut(ids.join(related(df, id_col, keys), "v", "left").select("v", F.coalesce("component", "v").alias("group")))
    n = member.count()
    small = min(s for _, s in shares) * n / 2
    groups = member.groupBy("group").agg(F.count(F.lit(1)).alias("rows")).withColumn("h", F.xxhash64("group", F.lit(7)))
    groups = groups.withColumn("bucket", F.when(F.col("rows") > small, -1).otherwise(F.pmod("h", F.lit(buckets))))
    sums = groups.groupBy("bucket").agg(F.sum("rows").alias("s"))
    sums = sums.select("bucket", (F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).alias("base"))  # at most buckets + 1 rows
    inside = F.sum("rows").over(Window.partitionBy("bucket").orderBy("h", "group").rowsBetween(Window.unboundedPreceding, -1))
    at = groups.withColumn("before", F.coalesce(inside, F.lit(0))).join(sums, "bucket").withColumn("at", (F.col("base") + F.col("before") + F.col("rows") / 2) / F.lit(max(n, 1)))
    split, upto = F.lit(shares[-1][0]), 1.0
    for name, share in reversed(shares[:-1]):
        upto -= shares[[x for x, _ in shares].index(name) + 1][1]
        split = F.when(F.col("at") < upto, F.lit(name)).otherwise(split)
    placed = at.select("group", F.when(F.col("bucket") == -1, F.lit(shares[0][0])).otherwise(split).alias("split"))
    return member.join(placed, "group").select(F.col("v").alias(id_col), "group", "split")
