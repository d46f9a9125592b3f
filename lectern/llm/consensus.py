"""Consensus labels from several annotators: latent ability and difficulty, learned jointly by gradient EM.

P(annotator i says yes on item j | truth z) = sigmoid(exp(ease_j) * (bias_i +- skill_i)), plus for yes, minus for no. The E step
gives label posteriors, the M step ascends the gradient of the expected log posterior in skills, biases and item eases.
Items with the same labels by the same annotators have the same posterior, so the data are pre-aggregated to patterns with counts;
each iteration maps over patterns and sums gradients per annotator with partial aggregation. An item's ease is solved within
its row, so no state is kept between iterations. Parameters travel to the tasks by value while there are at most
``max_inline`` annotators; beyond that they are joined to the labels and never leave the executors. Both ways take the same steps and
stop by the same rule, so they end with the same parameters.

Defined results: passes and unreadable verdicts count for nothing; an annotator's latest verdict on an item replaces earlier
ones (ties in time: the higher label id); a verdict without a time is the earliest; a verdict without an annotator is that of an
unnamed one; a curator's verdict is final and is taken as known while learning; of several curator's verdicts the positive one
holds; an even posterior is "not used"; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import cut

# fixed values: spellings of the two verdicts
YES = ("true", "t", "1", "yes", "y", "used")
NO = ("false", "f", "0", "no", "n", "not_used", "not used")


def verdict(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*YES), 1).when(t.isin(*NO), 0)


def annotator(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9a-z_]", "")


def latest_labels(labels: DataFrame) -> DataFrame:
    """item, who, y: one verdict per item and annotator. labels: item, resp, used, at, seq."""
    known = labels.select("item", annotator(F.col("resp")).alias("who"), verdict(F.col("used")).alias("y"), "at", "seq").where("y is not null and item is not null")
    return known.groupBy("item", "who").agg(F.max_by("y", F.struct("at", "seq")).alias("y"))


def patterns(votes: DataFrame, known: DataFrame) -> DataFrame:
    """item, labels (sorted array of who, y), fixed (the curator's verdict or null)."""
    by_item = votes.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("who", "y"))).alias("labels"))
    return by_item.join(known, "item", "full").select("item", F.coalesce("labels", F.expr("cast(array() as array<struct<who:string,y:int>>)")).alias("labels"), "fixed")


class Flat:
    """The labels of many rows as flat arrays: row, y, annotator (a code) and its parameters; nothing is padded."""

    def __init__(self, pdf: pd.DataFrame, params: dict | None):
        self.rows = len(pdf)
        self.row = np.repeat(np.arange(self.rows), pdf["y"].map(len).to_numpy(np.int64))
        flat = lambda c, kind: np.concatenate(list(pdf[c])).astype(kind) if len(self.row) else np.empty(0, kind)
        self.sign = np.where(flat("y", np.int64) == 1, 1.0, -1.0)
        self.code, self.names = pd.factorize(flat("who", object))
        if params is None:
            self.alpha, self.bias = flat("alpha", float), flat("bias", float)
        else:
            known = np.array([params.get(w, (1.0, 0.0)) for w in self.names], float).reshape(-1, 2)
            self.alpha, self.bias = known[self.code].T if len(self.row) else (np.empty(0), np.empty(0))
        self.fixed = pdf["fixed"].astype("float").fillna(-1).to_numpy()
        self.n = np.bincount(self.row, minlength=self.rows)

    def by_row(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x, self.rows)

    def posterior(self, prior: float, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of yes and ease of every row."""
        ease = np.zeros(self.rows)
        one, other = self.sign * (self.bias + self.alpha), self.sign * (self.bias - self.alpha)
        for step in range(steps + 1):
            e = np.exp(ease)[self.row]
            yes, no = e * one, e * other
            l1, l0 = -np.logaddexp(0, -yes), -np.logaddexp(0, -no)
            odds = np.log(prior) - np.log1p(-prior) + self.by_row(l1 - l0)
            p = np.where(self.fixed >= 0, self.fixed, 1 / (1 + np.exp(-np.clip(odds, -500, 500))))
            if step == steps:
                return p, ease
            q = p[self.row]
            g = self.by_row(q * (1 - np.exp(l1)) * yes + (1 - q) * (1 - np.exp(l0)) * no) - ease
            ease = np.clip(ease + 0.3 * g / (1 + 0.25 * self.n), -3, 3)
        raise AssertionError


SUMS = "who string, ga double, gb double, ha double, hb double, n double"


def _gradients(prior: float, params: dict | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f, times = Flat(pdf, params), pdf["times"].to_numpy()
            p, ease = f.posterior(prior)
            b, q, t = np.exp(ease)[f.row], p[f.row], times[f.row]
            r1, r0 = 1 / (1 + np.exp(f.sign * b * (f.bias + f.alpha))), 1 / (1 + np.exp(f.sign * b * (f.bias - f.alpha)))
            one, other = t * f.sign * b * q * r1, t * f.sign * b * (1 - q) * r0
            h = t * b**2 * (q * r1 * (1 - r1) + (1 - q) * r0 * (1 - r0))
            ga, gb, ha, n = (np.bincount(f.code, x, len(f.names)) for x in (one - other, one + other, h, t))
            yield pd.DataFrame({"who": [*f.names, "\0prior"], "ga": [*ga, (p * times).sum()], "gb": [*gb, 0.0], "ha": [*ha, 0.0], "hb": [*ha, 0.0], "n": [*n, times.sum()]})

    return run


def _step(alpha, bias, s):
    """One damped Newton step under the priors skill ~ N(1, 1), bias ~ N(0, 1)."""
    da, db = (s["ga"] - (alpha - 1)) / (s["ha"] + 1), (s["gb"] - bias) / (s["hb"] + 1)
    return alpha + np.clip(da, -0.7, 0.7), bias + np.clip(db, -0.7, 0.7)


class Consensus:
    """params: who, alpha, bias (inline as a dict, or a table beyond max_inline annotators); prior: share of yes."""

    def __init__(self, inline: dict | None, params: DataFrame | None, prior: float):
        self.inline, self.params, self.prior = inline, params, prior


def _with_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """labels with the annotators' parameters, joined on the executors."""
    ids = df.withColumn("row", F.struct(F.xxhash64("labels", "fixed").alias("h1"), F.xxhash64(F.lit(1), "fixed", "labels").alias("h2")))
    flat = ids.select("row", F.explode("labels").alias("l")).select("row", "l.*").distinct().join(params, "who")
    back = flat.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("who", "y", "alpha", "bias"))).alias("joined"))
    none = "cast(array() as array<struct<who:string,y:int,alpha:double,bias:double>>)"
    return ids.join(back, "row", "left").withColumn("labels", F.coalesce("joined", F.expr(none))).drop("row", "joined")


def _columns(df: DataFrame, joined: bool, *keep: str) -> DataFrame:
    """Labels as one array a field, which reach Python as flat arrays."""
    return df.select(*keep, "fixed", *[F.col(f"labels.{c}").alias(c) for c in (["who", "y", "alpha", "bias"] if joined else ["who", "y"])])


def fit(items: DataFrame, iterations: int = 25, max_inline: int = 10_000, tolerance: float = 2e-3) -> Consensus:
    counted = cut(items.groupBy("labels", "fixed").agg(F.count(F.lit(1)).cast("double").alias("times")))
    names = counted.select(F.explode("labels.who").alias("who")).distinct()
    prior = 0.5
    if names.limit(max_inline + 1).count() <= max_inline:
        inline = {r.who: (1.0, 0.0) for r in names.collect()}  # at most max_inline names
        for _ in range(iterations):
            sums = _columns(counted, False, "times").mapInPandas(_gradients(prior, inline), SUMS).groupBy("who").agg(*[F.sum(c).alias(c) for c in ("ga", "gb", "ha", "hb", "n")]).collect()
            moved, new = 0.0, {}
            for s in sums:
                if s.who == "\0prior":
                    prior = float(np.clip(s.ga / s.n, 0.01, 0.99))
                else:
                    a, b = inline[s.who]
                    new[s.who] = tuple(map(float, _step(a, b, s.asDict())))
                    moved = max(moved, abs(new[s.who][0] - a), abs(new[s.who][1] - b))
            inline |= new
            if moved < tolerance:
                break
        return Consensus(inline, None, prior)
    params = cut(names.select("who", F.lit(1.0).alias("alpha"), F.lit(0.0).alias("bias")))
    schema = "who string, alpha double, bias double, n double, yes double, moved double"

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = _step(pdf["alpha"].to_numpy(), pdf["bias"].to_numpy(), pdf)
            moved = np.maximum(np.abs(a - pdf["alpha"]), np.abs(b - pdf["bias"]))
            yield pd.DataFrame({"who": pdf["who"], "alpha": a, "bias": b, "n": pdf["n"], "yes": pdf["ga"], "moved": moved})

    for _ in range(iterations):
        sums = _columns(_with_params(counted, params), True, "times").mapInPandas(_gradients(prior, None), SUMS).groupBy("who").agg(*[F.sum(c).alias(c) for c in ("ga", "gb", "ha", "hb", "n")])
        new = cut(sums.join(params, "who", "left").fillna({"alpha": 1.0, "bias": 0.0}).mapInPandas(update, schema))
        head = new.where(F.col("who") == "\0prior").first()
        prior = float(np.clip(head.yes / head.n, 0.01, 0.99)) if head else prior
        params = new.where(F.col("who") != "\0prior").select("who", "alpha", "bias")
        if (new.where(F.col("who") != "\0prior").agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    return Consensus(None, params, prior)


def posteriors(items: DataFrame, model: Consensus) -> DataFrame:
    """item, n_labels, fixed, p_yes, difficulty, consensus; items without verdicts of two annotators or the curator have none."""
    inline, prior = model.inline, model.prior
    schema = "item string, n_labels int, fixed int, p_yes double, difficulty double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = Flat(pdf, inline)
            p, ease = f.posterior(prior)
            yield pd.DataFrame({"item": pdf["item"], "n_labels": f.n.astype("int32"), "fixed": pdf["fixed"], "p_yes": p, "difficulty": np.exp(-ease)})

    src = items if inline is not None else _with_params(items, model.params)
    out = _columns(src.withColumn("item", F.col("item").cast("string")), inline is None, "item").mapInPandas(run, schema)
    judged = F.col("fixed").isNotNull() | (F.col("n_labels") >= 2)
    return out.withColumn("consensus", F.when(judged, F.col("p_yes") > 0.5))


def agreement(votes: DataFrame) -> DataFrame:
    """Chance-corrected agreement over all items with two verdicts or more: Krippendorff's alpha for two values, one row."""
    n = votes.groupBy("item").agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("m")).where("m >= 2").select("m", "n1", (F.col("m") - F.col("n1")).alias("n0"))
    s = n.agg(F.count(F.lit(1)).alias("items"), F.sum("m").alias("labels"), F.sum(2 * F.col("n0") * F.col("n1") / (F.col("m") - 1)).alias("apart"), F.sum("n0").alias("a0"), F.sum("n1").alias("a1"))
    observed, expected = F.col("apart") / F.col("labels"), 2 * F.col("a0") * F.col("a1") / (F.col("labels") * (F.col("labels") - 1))
    return s.select("items", "labels", observed.alias("disagreement"), expected.alias("by_chance"), (1 - observed / F.when(expected > 0, expected)).alias("alpha"))


def reliability(votes: DataFrame, consensus: DataFrame, model: Consensus) -> DataFrame:
    """who, n_labels, skill, bias, accuracy and kappa against the consensus."""
    spark = votes.sparkSession
    params = model.params if model.inline is None else spark.createDataFrame([(w, a, b) for w, (a, b) in model.inline.items()], "who string, alpha double, bias double")
    both = votes.join(consensus.where("consensus is not null").select("item", F.col("consensus").cast("int").alias("z")), "item")
    s = both.groupBy("who").agg(F.count(F.lit(1)).alias("n_labels"), F.avg((F.col("y") == F.col("z")).cast("int")).alias("accuracy"), F.avg("y").alias("py"), F.avg("z").alias("pz"))
    chance = F.col("py") * F.col("pz") + (1 - F.col("py")) * (1 - F.col("pz"))
    s = s.withColumn("kappa", (F.col("accuracy") - chance) / F.when(chance < 1, 1 - chance))
    return s.join(params, "who").select("who", "n_labels", F.col("alpha").alias("skill"), "bias", "accuracy", "kappa")


def usage_votes(entity_spans: DataFrame, usage_labels: DataFrame, use_corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """votes (item, who, y) and the curator's verdicts (item, fixed) on software spans."""
    spans = entity_spans.where("entity_type = 'software'").select("span_id", "resp", "used").distinct()
    software = spans.select(F.col("span_id").alias("item")).distinct()
    own = spans.select(F.col("span_id").alias("item"), "resp", F.col("used").cast("string").alias("used"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("bigint").alias("seq"))
    more = usage_labels.select(F.col("span_id").alias("item"), "resp", "used", F.col("labelled_at").cast("timestamp").alias("at"), F.col("label_id").cast("bigint").alias("seq"))
    votes = latest_labels(own.unionByName(more)).join(software, "item", "left_semi")
    said = use_corrections.select(F.col("id").alias("item"), verdict(F.col("used")).alias("fixed")).where("fixed is not null")
    return votes, said.groupBy("item").agg(F.max("fixed").alias("fixed")).join(software, "item", "left_semi")
