"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic.

Items carry three sizes (tokens, one segment, loss-bearing tokens) and containers three limits. A container is filled by taking,
again and again, the item that fits and has the largest dot product of its sizes with the room left, each measured against its limit.
Items are spread by hash over groups of about ``group_size``; a group is packed in one task with bounded memory, and only its last
containers are not full, so quality doesn't depend on the size of the corpus. Only texts above the capacity are split, in order.

Defined results: null and empty texts have no tokens and take no place; repeated rows count once, two ids with one text are two items;
a text of several times the capacity gives full parts and a rest; extra columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.tokens import count_tokens, tokenize
from lectern.session import cut_table

MAX_TARGETS = 1000


def measured(docs: DataFrame, smallest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_loss, marks: one mark a token, 1 if it bears loss (isn't white space), kept only for texts that may be split."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    t = t.withColumn("n_tokens", count_tokens(F.col("text")))
    blanks = F.length("text") - F.length(F.translate("text", " \n\r\t", ""))
    marks = F.array_join(F.transform(tokenize(F.col("text")), lambda x: F.when(x.isin(" ", "\n", "\r", "\t"), "0").otherwise("1")), "")
    return t.select("doc_id", "n_tokens", (F.col("n_tokens") - blanks).alias("n_loss"), F.when(F.col("n_tokens") > smallest, marks).alias("marks")).dropDuplicates(["doc_id"])


def items(m: DataFrame, targets: list[tuple[int, int]]) -> DataFrame:
    """target_id, capacity, doc_id, part_no, token_start, n_tokens, n_loss."""
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("target_id"), F.lit(c).alias("capacity")) for i, c in targets])).alias("t")
    per = m.select("*", t).select("doc_id", "n_tokens", "n_loss", "marks", "t.*")
    parts = per.withColumn("part_no", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / F.col("capacity")).cast("int"))))
    start = (F.col("part_no") * F.col("capacity")).cast("int")
    n = F.least(F.col("capacity"), F.col("n_tokens") - start)
    own = F.length(F.replace(F.substr("marks", start + 1, n), F.lit("0"), F.lit("")))
    return parts.select("target_id", "capacity", "doc_id", "part_no", start.alias("token_start"), n.alias("n"), F.when(F.col("n_tokens") > F.col("capacity"), own).otherwise(F.col("n_loss")).alias("loss"))


def fill(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Container and place of every item. sizes: n x 3; an item above a limit in the other sizes gets a container of its own."""
    n = len(sizes)
    share = sizes / limits
    container, place = np.full(n, -1), np.zeros(n, np.int64)
    left = np.arange(n)
    order = np.argsort(-share[:, 0], kind="stable")
    left = order
    k = 0
    while len(left):
        room = np.ones(share.shape[1])
        slot = 0
        while len(left):
            s = share[left]
            fits = (s <= room + 1e-12).all(1)
            if not fits.any():
                if slot:
                    break
                best = 0
            else:
                score = s @ room
                score[~fits] = -1
                best = int(score.argmax())
            i = left[best]
            container[i], place[i] = k, slot
            room = room - share[i]
            left = np.delete(left, best)
            slot += 1
            if room.min() <= 1e-12:
                break
        k += 1
    return container, place


def pack(docs: DataFrame, targets: list[tuple[int, int]], max_segments: int = 32, loss_share: float = 1.0, group_size: int = 2048) -> DataFrame:
    """target_id, container_id, slot, doc_id, part_no, token_start, n_tokens."""
    if not 0 < len(targets) <= MAX_TARGETS:
        raise ValueError(f"give 1 to {MAX_TARGETS} targets")
    m = cut_table(measured(docs, min(c for _, c in targets)))
    n = items(m, targets).groupBy("target_id").count()
    groups = {r["target_id"]: max(1, math.ceil(r["count"] / group_size)) for r in n.collect()}  # a row a target
    if not groups:
        groups = {i: 1 for i, _ in targets}
    n_groups = F.coalesce(*[F.when(F.col("target_id") == i, F.lit(g)) for i, g in groups.items()])
    placed = items(m, targets).withColumn("group", F.pmod(F.xxhash64("doc_id", "part_no"), n_groups))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "part_no"])
        sizes = np.column_stack([pdf["n"], np.ones(len(pdf)), pdf["loss"]]).astype(float)
        container, place = fill(sizes, np.array([capacity, max_segments, max(1.0, capacity * loss_share)]))
        return pd.DataFrame({
            "target_id": pdf["target_id"], "container_id": key[1] * (1 << 24) + container, "slot": place.astype("int32"), "doc_id": pdf["doc_id"],
            "part_no": pdf["part_no"], "token_start": pdf["token_start"], "n_tokens": pdf["n"],
        })

    out = "target_id int, container_id bigint, slot int, doc_id bigint, part_no int, token_start int, n_tokens int"
    return placed.groupBy("target_id", "group").applyInPandas(run, out)


def summary(packed: DataFrame, targets: list[tuple[int, int]]) -> DataFrame:
    """target_id, n_containers, n_tokens, unused (share of the space)."""
    capacity = F.coalesce(*[F.when(F.col("target_id") == i, F.lit(c)) for i, c in targets])
    c = packed.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    s = c.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"))
    return s.withColumn("unused", 1 - F.col("n_tokens") / (F.col("n_containers") * capacity))
