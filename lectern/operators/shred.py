"""Nested JSON records to related flat tables, by adjacency-table shredding.

``shred_json`` stores every node of a payload as a row (record, node, parent, label, ordinal, kind, scalar).
``entity_tables`` then only joins and pivots that table: lists are matched to their parents by node ids, object nodes
are joined with their scalar children, and the scalars are pivoted into columns.

Defined results: a null, empty or unusable payload has no nodes; a byte order mark, white space or NULs around the JSON
and JSON text kept inside a JSON string are unwrapped, however often; nesting of any depth is read; repeated rows count once; null list elements keep their
place but give no row; a lone object counts as a list of one; two lists of one paragraph whose names differ only in case
or underscores are read as one list after the other; column names of the input don't matter, only the two given are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "record_id bigint, node int, parent int, owner int, depth int, label string, ordinal int, kind string, size int, scalar string"

PARAGRAPH_LISTS = ("abstract", "bodytext", "texts")


class _Pairs(list):
    """The members of a JSON object as stored: a repeated name is kept."""


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|([^\s{}\[\],:"]+))', re.S)


def parse_deep(text: str):
    """JSON nested deeper than the parser's own stack allows; ValueError if it isn't complete JSON."""
    root: list = []
    stack, names, state, at = [(root, False)], [], "value", 0  # state: what may come next
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip(" \t\r\n"):
                raise ValueError("no token")
            break
        at = m.end()
        mark, quoted, word = m.groups()
        top, is_object = stack[-1]
        if state in ("name", "first name") and (quoted or mark == "}"):
            if quoted:
                names.append(json.loads(quoted, strict=False))
                state = "colon"
                continue
            if state == "name":
                raise ValueError("a comma before the end")
        elif state == "colon" and mark == ":":
            state = "value"
            continue
        elif state == "more" and mark == "," and len(stack) > 1:
            state = "name" if is_object else "value"
            continue
        elif not (state in ("value", "first value") and (quoted or word or mark in ("{", "[")) or (state in ("first value", "more") and mark in ("}", "]"))):
            raise ValueError("misplaced token")
        if mark in ("}", "]"):
            if len(stack) == 1 or is_object != (mark == "}"):
                raise ValueError("misplaced end")
            stack.pop()
            state = "more"
            continue
        value = _Pairs() if mark == "{" else [] if mark == "[" else json.loads(quoted or word, strict=False)
        top.append((names.pop(), value) if is_object else value)
        state = "more"
        if mark:
            stack.append((value, mark == "{"))
            state = "first name" if mark == "{" else "first value"
    if len(stack) > 1 or len(root) != 1:
        raise ValueError("not complete")
    return root[0]


def load_wrapped(payload: str | None):
    """The JSON value of a payload, or None if it can't be read as complete JSON."""
    value = payload
    while isinstance(value, str):
        text = value.strip("﻿\x00 \t\r\n")
        if not text:
            return None
        try:
            value = json.loads(text, object_pairs_hook=_Pairs, strict=False)
        except RecursionError:
            try:
                value = parse_deep(text)
            except ValueError:
                return None
        except ValueError:
            return None
    return value


def _is_wrapped(value) -> bool:
    return isinstance(value, str) and value.lstrip("﻿\x00 \t\r\n")[:1] in ("{", "[", '"')


def nodes_of(record_id, payload: str | None) -> list[tuple]:
    """The adjacency rows of one payload, parents before children."""
    root = load_wrapped(payload)
    if not isinstance(root, list):
        return []
    out, stack, n = [], [(root, -1, -1, 0, "", 0)], 0
    while stack:
        value, parent, owner, depth, label, ordinal = stack.pop()
        node, n = n, n + 1
        if depth <= 2 and label == "" and _is_wrapped(value):
            value = load_wrapped(value)
        if isinstance(value, _Pairs):
            out.append((record_id, node, parent, owner, depth, label, ordinal, "object", len(value), None))
            stack.extend((v, node, node, depth + 1, k, i) for i, (k, v) in enumerate(value))
        elif isinstance(value, list):
            out.append((record_id, node, parent, owner, depth, label, ordinal, "list", len(value), None))
            stack.extend((v, node, owner, depth + 1, "", i) for i, v in enumerate(value))
        elif value is None:
            out.append((record_id, node, parent, owner, depth, label, ordinal, "null", 0, None))
        elif isinstance(value, str):
            out.append((record_id, node, parent, owner, depth, label, ordinal, "string", 0, value.encode("utf-8", "replace").decode()))
        else:
            out.append((record_id, node, parent, owner, depth, label, ordinal, type(value).__name__, 0, json.dumps(value)))
    return out


def shred_json(df: DataFrame, id_col: str = "record_id", json_col: str = "payload") -> DataFrame:
    """The adjacency table of all payloads (NODE_SCHEMA). Rows of one record stay in one partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64]
                rows = [r for i, p in zip(part["record_id"], part["payload"]) for r in nodes_of(i, p)]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")]).astype({"node": "int32", "parent": "int32", "owner": "int32", "depth": "int32", "ordinal": "int32", "size": "int32"})

    src = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(json_col).alias("payload"))
    src = src.where("payload is not null and record_id is not null").dropDuplicates()
    return src.mapInPandas(run, NODE_SCHEMA)


def _name(label: Column) -> Column:
    return F.lower(F.replace(label, F.lit("_"), F.lit("")))


def _elements(objects: DataFrame, lists: DataFrame, keep: list[str]) -> DataFrame:
    """The object elements of list-like nodes: a list's objects with their places, or the lone object itself at 0.

    objects: see _objects. lists: record_id, node, kind, offset and the columns of keep. One join, so plans stay linear in depth."""
    cols = ["record_id", F.col("element").alias("node"), *keep, (F.col("place") + F.col("offset")).alias("no")]
    return lists.join(objects, ["record_id", "node"]).where(F.col("lone") == (F.col("kind") == "object")).select(*cols)


def _objects(nodes: DataFrame) -> DataFrame:
    """Each object node, keyed by its parent and, as a list of one, by itself."""
    under = F.struct(F.col("parent").alias("node"), F.col("ordinal").alias("place"), F.lit(False).alias("lone"))
    itself = F.struct(F.col("node").alias("node"), F.lit(0).alias("place"), F.lit(True).alias("lone"))
    return nodes.where("kind = 'object'").select("record_id", F.col("node").alias("element"), F.explode(F.array(under, itself)).alias("k")).select("record_id", "element", "k.*")


def _members(nodes: DataFrame, parents: DataFrame, names: tuple[str, ...], keep: list[str], how: str = "inner") -> DataFrame:
    """The list-like members of object nodes under the given names; offset continues the places of an earlier list of the same name."""
    kids = nodes.where("kind in ('object', 'list')").select("record_id", F.col("node").alias("member"), "kind", F.col("parent").alias("node"), _name(F.col("label")).alias("name"), "ordinal", "size")
    found = parents.join(kids.where(F.col("name").isin(*names)), ["record_id", "node"], how)
    before = Window.partitionBy("record_id", "node", "name").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.sum(F.when(F.col("kind") == "object", 1).otherwise(F.col("size"))).over(before)
    found = found.withColumn("offset", F.coalesce(taken, F.lit(0)).cast("int"))
    return found.select("record_id", F.coalesce("member", "node").alias("node"), F.coalesce("kind", F.lit("object")).alias("kind"), "name", "offset", *keep)


def _scalars(nodes: DataFrame, owners: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """owners with the scalar children of their nodes pivoted into columns; fields: column -> (name, type)."""
    kids = nodes.where("kind not in ('object', 'list', 'null')").select("record_id", F.col("parent").alias("node"), _name(F.col("label")).alias("name"), "ordinal", "scalar")
    kids = kids.where(F.col("name").isin(*{n for n, _ in fields.values()}))
    wide = kids.groupBy("record_id", "node").agg(*[F.min_by(F.when(F.col("name") == n, F.col("scalar")), F.when(F.col("name") == n, F.col("ordinal"))).alias(c) for c, (n, _) in fields.items()])
    wide = wide.select("record_id", "node", *[F.expr(f"try_cast({c} as {t})").alias(c) for c, (_, t) in fields.items()])
    return owners.join(wide, ["record_id", "node"], "left")


def chain(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Document, paragraph and span nodes with their places, by joins on (record, parent)."""
    objects = _objects(nodes)
    top = nodes.where("depth = 0").select("record_id", "node", "kind", F.lit(0).alias("offset"))
    records = _elements(objects, top, []).withColumnRenamed("no", "record_no")
    wrapped = _members(nodes, records, ("documents",), ["record_no"], "left")
    wrapped = wrapped.withColumn("offset", F.when(F.col("name").isNull(), F.col("record_no")).otherwise(F.col("offset"))).drop("name")
    documents = _elements(objects, wrapped, []).withColumnRenamed("no", "doc_no")
    lists = _members(nodes, documents.withColumn("doc_node", F.col("node")), PARAGRAPH_LISTS, ["doc_no", "doc_node"])
    lists = lists.withColumn("list_name", F.when(F.col("name") == "bodytext", "body_text").otherwise(F.col("name"))).drop("name")
    paragraphs = _elements(objects, lists, ["doc_no", "doc_node", "list_name"]).withColumnRenamed("no", "para_no")
    keep = ["doc_no", "list_name", "para_no", "para_node"]
    spans = _members(nodes, paragraphs.withColumn("para_node", F.col("node")).drop("doc_node"), ("entityspans", "refspans"), keep)
    spans = spans.withColumn("span_kind", F.when(F.col("name") == "entityspans", "entity").otherwise("ref")).drop("name")
    return documents, paragraphs, _elements(objects, spans, [*keep, "span_kind"]).withColumnRenamed("no", "span_no")


def entity_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """documents, paragraphs, entity_spans and ref_spans; each row has its own node and that of its parent."""
    documents, paragraphs, spans = chain(nodes)
    text = lambda *names: {n: (n.replace("_", "").lower(), "string") for n in names}
    entity = text("id", "type", "resp") | {"raw_form": ("rawform", "string"), "start": ("start", "int"), "end": ("end", "int"), "used": ("used", "boolean"), "cert": ("cert", "double")}
    ref = text("type", "ref_id", "text") | {"start": ("start", "int"), "end": ("end", "int")}
    return {
        "documents": _scalars(nodes, documents, text("id", "doi", "pmc", "level")),
        "paragraphs": _scalars(nodes, paragraphs.withColumnRenamed("doc_node", "parent_node"), text("section", "text")),
        "entity_spans": _scalars(nodes, spans.where("span_kind = 'entity'").withColumnRenamed("para_node", "parent_node"), entity),
        "ref_spans": _scalars(nodes, spans.where("span_kind = 'ref'").withColumnRenamed("para_node", "parent_node"), ref),
    }


def other_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """objects: every object of no entity table (attributes of texts, objects inside spans, lists of other names), with the object it is
    part of; values: every scalar with the object it is part of, whatever lists lie between. Nothing of a payload is in no table."""
    documents, paragraphs, spans = chain(nodes)
    entities = documents.select("record_id", "node").unionByName(paragraphs.select("record_id", "node")).unionByName(spans.select("record_id", "node"))
    objects = nodes.where("kind = 'object'").join(entities, ["record_id", "node"], "left_anti")
    values = nodes.where("kind not in ('object', 'list', 'null')")
    return {
        "objects": objects.select("record_id", "node", F.col("owner").alias("parent_node"), "label", "ordinal", "depth", F.col("size").alias("n_members")),
        "values": values.select("record_id", "node", F.col("owner").alias("parent_node"), "label", "ordinal", "kind", F.col("scalar").alias("value")),
    }


def span_places(nodes: DataFrame) -> DataFrame:
    """record_id, doc_no, list_name, para_no, span_kind, span_no of every span object."""
    _, _, spans = chain(nodes)
    return spans.select("record_id", F.col("doc_no").cast("int"), "list_name", F.col("para_no").cast("int"), "span_kind", F.col("span_no").cast("int"))
