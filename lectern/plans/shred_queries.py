"""Queries of problem 1: nested JSON records to related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.shred import entity_tables, other_tables, shred_json, span_places
from lectern.session import cut_table, table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_table(shred_json(table(spark, sf_dir, "corpus_json")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_places(_nodes(spark, sf_dir))


def _entity(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entity_tables(_nodes(spark, sf_dir))[name]

    return query


def _other(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return other_tables(_nodes(spark, sf_dir))[name]

    return query


QUERIES = {"p1_found": p1_found} | {f"p1_{name}": _entity(name) for name in ("documents", "paragraphs", "entity_spans", "ref_spans")} | {f"p1_{name}": _other(name) for name in ("objects", "values")}
SQL: dict[str, str] = {}
