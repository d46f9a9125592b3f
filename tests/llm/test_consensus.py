import random
from datetime import datetime

from lectern.llm import consensus as C


def simulated(seed=3, n=600):
    rng = random.Random(seed)
    skill = {"a1": 0.95, "a2": 0.9, "a3": 0.85, "liar": 0.1, "coin": 0.5}
    truth = {f"s{i}": int(rng.random() < 0.6) for i in range(n)}
    votes = [(i, w, z if rng.random() < skill[w] else 1 - z) for i, z in truth.items() for w in rng.sample(sorted(skill), 3)]
    return truth, votes


def test_recovers_truth_better_than_majority(spark):
    truth, votes = simulated()
    v = spark.createDataFrame(votes, "item string, who string, y int")
    items = C.patterns(v, spark.createDataFrame([("s0", 1), ("s1", 0)], "item string, fixed int"))
    for inline in (10_000, 1):
        model = C.fit(items, max_inline=inline, iterations=4)
        got = {r.item: r for r in C.posteriors(items, model).collect()}
        assert got["s0"].consensus is True and got["s1"].consensus is False
        right = sum(got[i].consensus == bool(z) for i, z in truth.items()) / len(truth)
        by = {}
        for i, _, y in votes:
            by.setdefault(i, []).append(y)
        majority = sum((sum(by[i]) >= 2) == z for i, z in truth.items()) / len(truth)
        assert right > majority
    one, other = (C.fit(items, max_inline=n, iterations=3) for n in (10_000, 1))
    for r in other.params.collect():
        assert abs(one.inline[r.who][0] - r.alpha) < 1e-9 and abs(one.inline[r.who][1] - r.bias) < 1e-9
    assert abs(one.prior - other.prior) < 1e-9
    table = {r.who: r for r in C.reliability(v, C.posteriors(items, C.fit(items)), C.fit(items)).collect()}
    assert table["a1"].skill > table["coin"].skill > table["liar"].skill and table["a1"].kappa > 0.6


def test_latest_verdicts_passes_and_writings(spark):
    t = lambda d: datetime(2020, 1, d)
    rows = [("s", "#Annotator1", "TRUE", t(1), 1), ("s", " annotator1", " no", t(2), 2), ("s", "annotator1", "NA", t(3), 3), ("s", "annotator2", "T", None, None), ("s", "annotator2", "0", t(1), 4), (None, "x", "yes", t(1), 5), ("u", None, "1", None, None)]
    df = spark.createDataFrame(rows, "item string, resp string, used string, at timestamp, seq bigint")
    got = {(r.item, r.who): r.y for r in C.latest_labels(df).collect()}
    assert got == {("s", "annotator1"): 0, ("s", "annotator2"): 0, ("u", ""): 1}


def test_agreement_and_empty(spark):
    v = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 0), ("b", "y", 0), ("c", "x", 1)], "item string, who string, y int")
    assert C.agreement(v).first().alpha == 1.0
    none = v.where("y > 5")
    items = C.patterns(none, spark.createDataFrame([], "item string, fixed int"))
    assert C.posteriors(items, C.fit(items)).count() == 0


def test_an_item_with_very_many_labels(spark):
    votes = [("many", f"w{i}", int(i % 3 > 0)) for i in range(3000)] + [(f"i{k}", f"w{j}", k % 2) for k in range(20) for j in range(3)]
    items = C.patterns(spark.createDataFrame(votes, "item string, who string, y int"), spark.createDataFrame([], "item string, fixed int"))
    got = {r.item: r.consensus for r in C.posteriors(items, C.fit(items, iterations=2)).collect()}
    assert got["many"] is True and got["i0"] is False and got["i1"] is True
