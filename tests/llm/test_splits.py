import random

from pyspark.sql import functions as F

from lectern.llm.keys import author_key, corpus_key, doi_key, pmc_key
from lectern.llm.splits import assign_splits, components, key_edges, related


def union_find(pairs):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(80)] + [(5000, 5001 + i) for i in range(100)]
    got = {r.v: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {v: c for v, c in union_find([p for p in pairs if p[0] != p[1]]).items()}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_writings_and_null_words(spark):
    rows = [("10.99/ab.1", "https://doi.org/10.99000/AB.1", "PMC52", "au-01", "9d8c"), (None, "DOI: 10.99000%2Fab.1.", "PMCID: PMC52", "AU01 ", " #9D8C"), ("NA", " - ", "52/", "None", "none")]
    df = spark.createDataFrame(rows, "x string, doi string, pmc string, au string, id string")
    got = df.select(doi_key(F.col("doi")), pmc_key(F.col("pmc")), author_key(F.col("au")), corpus_key(F.col("id"))).collect()
    assert tuple(got[0]) == tuple(got[1]) == ("10.99000/ab.1", "52", "au01", "9d8c")
    assert tuple(got[2]) == (None, "52", None, None)


def test_one_key_holding_a_third_and_splits(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).alias("k"), F.concat(F.lit("g"), (F.col("id") / 4).cast("int")).alias("doc"), F.lit(1).alias("v"))
    edges = key_edges(df, "doc_id", {"k": F.col("k")})
    assert edges.count() < 1100
    narrow = key_edges(df, "doc_id", {"k": F.col("k")}, fan=8)
    assert narrow.groupBy("b").count().agg(F.max("count")).first()[0] < 60 and components(narrow).select("component").distinct().count() == 1
    keys = {"k": lambda c: c}
    assert related(df, "doc_id", keys).select("component").distinct().count() == 1
    out = assign_splits(df, "doc_id", {"k": lambda c: c}).groupBy("split").count().collect()
    n = {r["split"]: r["count"] for r in out}
    assert sum(n.values()) == 3000 and abs(n["train"] - 2400) < 60 and abs(n["valid"] - 300) < 30
    assert assign_splits(df.where("doc_id < 0"), "doc_id", keys).count() == 0
