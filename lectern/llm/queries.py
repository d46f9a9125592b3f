"""Queries of problems 2 to 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.tokens import PATTERN
from lectern.llm import confusables, consensus, leakage, overlap, packing, sentences, splits, truncation
from lectern.llm.keys import NULL_WORDS, corpus_key
from lectern.session import cut, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = confusables.found(table(spark, sf_dir, "entity_spans"), "span_id", "raw_form")
    texts = confusables.found(table(spark, sf_dir, "texts"), "text_id", "text")
    return forms.select(F.lit("raw_form").alias("row_kind"), "row_key").unionByName(texts.select(F.lit("text").alias("row_kind"), "row_key"))


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = confusables.canonicalize(table(spark, sf_dir, "entity_spans"), "span_id", "raw_form")
    texts = confusables.canonicalize(table(spark, sf_dir, "texts"), "text_id", "text")
    return forms.withColumn("row_kind", F.lit("raw_form")).unionByName(texts.withColumn("row_kind", F.lit("text")))


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).select("row_kind", "row_key", "original", "text", "skeleton", "needed")


def p2_look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.look_alikes(_canonical(spark, sf_dir))


def _consensus(spark: SparkSession, sf_dir: str) -> tuple:
    votes, known = consensus.usage_votes(*[table(spark, sf_dir, t) for t in ("entity_spans", "usage_labels", "use_corrections")])
    votes = cut(votes)
    items = cut(consensus.patterns(votes, known))
    model = consensus.fit(items)
    return votes, consensus.posteriors(items, model), model


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[1].where("consensus").select(F.col("item").alias("span_id"))


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[1]


def p3_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.reliability(*_consensus(spark, sf_dir))


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agreement(consensus.usage_votes(*[table(spark, sf_dir, t) for t in ("entity_spans", "usage_labels", "use_corrections")])[0])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tied = splits.related(table(spark, sf_dir, "documents"))
    return tied.where("v <> component").select(F.col("component").alias("group_doc_id"), F.col("v").alias("doc_id"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, "documents"))


def _overlaps(spark: SparkSession, sf_dir: str) -> tuple:
    ids = table(spark, sf_dir, "id_map")
    return overlap.text_links(table(spark, sf_dir, "texts"), ids), overlap.doi_members(table(spark, sf_dir, "documents"), ids)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "id_map")
    texts, dois = overlap.text_overlaps(table(spark, sf_dir, "texts"), ids), overlap.doi_overlaps(table(spark, sf_dir, "documents"), ids)
    return overlap.ordered(texts, "text").unionByName(overlap.ordered(dois, "doi"))


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_kind, row, n_links, coverage of every evaluation record that overlaps with training."""
    (members, links), dois = _overlaps(spark, sf_dir)
    return overlap.records(members, links, "text").unionByName(overlap.records(dois, None, "doi"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    (members, links), dois = _overlaps(spark, sf_dir)
    ids = table(spark, sf_dir, "id_map")
    key = corpus_key(F.col("id")).alias("key")
    origin = overlap.splits_of(ids).groupBy("key").agg(F.min("origin").alias("source"))
    paragraphs = table(spark, sf_dir, "texts").select(F.col("text_id").alias("row"), key).distinct().join(origin, "key", "left")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), key, "source").distinct()
    texts = overlap.report(overlap.records(members, links, "text"), paragraphs, ids)
    return texts.unionByName(overlap.report(overlap.records(dois, None, "doi"), docs, ids))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "texts"))


def _packed(spark: SparkSession, sf_dir: str) -> tuple:
    targets = table(spark, sf_dir, "packing_targets").where("capacity_tokens > 0").select("target_id", "capacity_tokens").distinct().limit(packing.MAX_TARGETS + 1)
    targets = sorted(map(tuple, targets.collect()))  # pack() refuses more than MAX_TARGETS
    return packing.pack(table(spark, sf_dir, "documents"), targets), targets


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and parts of every text in the containers of each capacity, and whether the parts follow each other without a gap."""
    packed = _packed(spark, sf_dir)[0]
    w = Window.partitionBy("target_id", "doc_id").orderBy("part_no")
    p = packed.withColumn("follows", F.col("token_start") == F.coalesce(F.lag(F.col("token_start") + F.col("n_tokens")).over(w), F.lit(0)))
    g = p.groupBy("target_id", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_parts"), F.bool_and("follows").alias("in_order"))
    return g.select(F.col("target_id").cast("bigint"), "doc_id", "n_tokens", "n_parts", "in_order")


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(*_packed(spark, sf_dir))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "holdout_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("kind = 'copy'").select("item_id", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.report(truncation.truncated(table(spark, sf_dir, "documents")))


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical, "p2_look_alikes": p2_look_alikes, "p3_found": p3_found, "p3_consensus": p3_consensus, "p3_reliability": p3_reliability, "p3_agreement": p3_agreement, "p4_found": p4_found, "p4_splits": p4_splits, "p5_found": p5_found, "p5_coverage": p5_coverage, "p5_report": p5_report, "p6_found": p6_found, "p7_packing": p7_packing, "p7_tokens": p7_tokens, "p7_summary": p7_summary, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_report": p9_report}


def _known(c: str) -> str:
    blank = r"[\s\x{A0}\x{200B}\x{FEFF}]+"
    t = f"lower(regexp_replace({c}, '^{blank}|{blank}$', '', 'g'))"
    return f"CASE WHEN {t} NOT IN ({', '.join(repr(w) for w in NULL_WORDS)}) THEN {t} END"


KEYS_SQL = {
    "id": f"regexp_replace({_known('id')}, '[^0-9a-z]', '', 'g')",
    "doi": rf"regexp_replace(regexp_extract(regexp_replace(replace(replace({_known('doi')}, '%2f', '/'), '%3a', ':'), '\s', '', 'g'), '(10\.\d{{4,9}}/.+)$', 1), '[./,;:)\]]+$', '')",
    "pmc": rf"regexp_replace(regexp_extract(regexp_replace({_known('pmc')}, '[^0-9a-z]', '', 'g'), '(\d+)$', 1), '^0+', '')",
    "corresp_author": rf"regexp_replace({_known('corresp_author')}, '[^\p{{L}}\p{{N}}]', '', 'g')",
}
COMPONENTS = "k AS (" + " UNION ALL ".join(f"SELECT DISTINCT doc_id AS v, '{n}' AS kind, {c} AS value FROM documents" for n, c in KEYS_SQL.items()) + "), e AS (SELECT DISTINCT a.v AS a, b.v AS b FROM k a JOIN k b USING (kind, value) WHERE value <> ''), r(v, m) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v), c AS (SELECT v, min(m) AS m FROM r GROUP BY 1)"
SQL: dict[str, str] = {
    "p4_found": f"WITH RECURSIVE {COMPONENTS} SELECT m AS group_doc_id, v AS doc_id FROM c WHERE v <> m",
    "p7_tokens": f"WITH d AS (SELECT DISTINCT doc_id, len(regexp_extract_all(text, '{PATTERN}')) AS n FROM documents WHERE text <> '') SELECT CAST(target_id AS BIGINT) AS target_id, doc_id, n AS n_tokens, CAST(ceil(n / capacity_tokens) AS BIGINT) AS n_parts, true AS in_order FROM d, (SELECT DISTINCT target_id, capacity_tokens FROM packing_targets WHERE capacity_tokens > 0)",
}
