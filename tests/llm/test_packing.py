import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.tokens import tokenize
from lectern.llm.packing import fill, pack, summary


def test_every_token_once_and_no_container_over(spark):
    r = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(r.choice([1, 5, 30, 60, 90, 400])))) for i in range(500)]
    rows += [(900, None), (901, ""), (902, "a " * 20_000), rows[0]]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id bigint, text string, part_no int")
    targets = [(1, 100), (2, 301)]
    out = pack(docs, targets, group_size=200)
    n = {x.doc_id: x.n for x in docs.select("doc_id", F.size(tokenize(F.col("text"))).alias("n")).where("n > 0").collect()}
    for i, capacity in targets:
        per, full = defaultdict(list), defaultdict(int)
        for x in out.where(F.col("target_id") == i).collect():
            per[x.doc_id].append((x.part_no, x.token_start, x.n_tokens))
            full[x.container_id] += x.n_tokens
        assert max(full.values()) <= capacity
        assert {d for d in n} == set(per)
        for d, parts in per.items():
            at = 0
            for k, (part, start, m) in enumerate(sorted(parts)):
                assert (part, start) == (k, at)
                at += m
            assert at == n[d] and (len(parts) == 1 or n[d] > capacity)
    assert all(x.unused < 0.08 for x in summary(out, targets).collect())
    assert pack(docs.where("doc_id < 0"), targets).count() == 0
    with pytest.raises(ValueError):
        pack(docs, [])


def test_all_three_limits_hold():
    rng = np.random.default_rng(1)
    sizes = np.column_stack([rng.integers(1, 50, 300), np.ones(300), rng.integers(0, 30, 300)]).astype(float)
    limits = np.array([100, 6, 50.0])
    container, place = fill(sizes, limits)
    for k in range(container.max() + 1):
        assert (sizes[container == k].sum(0) <= limits).all() and sorted(place[container == k]) == list(range((container == k).sum()))


def test_each_limit_can_be_the_tight_one(spark):
    """Tokens, segments and loss-bearing tokens in turn."""
    docs = spark.createDataFrame([(i, " ".join("w" for _ in range(10))) for i in range(300)], "doc_id bigint, text string")
    per = lambda **x: pack(docs, [(1, 190)], group_size=300, **x).groupBy("container_id").count().agg(F.max("count")).first()[0]
    assert per() == 10 and per(max_segments=4) == 4 and per(loss_share=0.35) == 6
