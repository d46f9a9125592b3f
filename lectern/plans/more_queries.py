"""Further queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F

import lectern.plans.core_queries as core
from lectern.operators import spans
from lectern.plans.core_queries import BASE, CHUNK, SENT, SPANS, TEXTS, TOKENS, _hits, _spans, _texts, query
from lectern.plans.pipeline import extract_mentions
from lectern.sources import sinks

QUERIES, SQL = core.QUERIES, core.SQL


@query()
def pipeline_mentions(t):
    return extract_mentions(_texts(t), t("software_names"), "soft_name", ("text_id",))


@query(f"WITH {SPANS} SELECT span_id, CAST(json_object('software-type', entity_type, 'software-name', json_object('rawForm', raw_form, 'offsetStart', start_pos, 'offsetEnd', end_pos)) AS VARCHAR) AS json FROM s WHERE raw_form IS NOT NULL AND entity_type IS NOT NULL")
def mention_json(t):
    s = _spans(t).where("raw_form is not null and entity_type is not null")
    return s.select("span_id", sinks.mention_json(F.col("entity_type"), F.col("raw_form"), F.col("start_pos"), F.col("end_pos")).alias("json"))


@query(f"WITH {SPANS} SELECT span_id, CAST(json_merge_patch('{{}}', json_object('software-type', entity_type, 'software-name', json_object('rawForm', raw_form, 'offsetStart', start_pos, 'offsetEnd', end_pos))) AS VARCHAR) AS json FROM s")
def mention_json_all(t):
    """Of all spans, of any characters; missing parts are left out."""
    return _spans(t).select("span_id", sinks.mention_json(F.col("entity_type"), F.col("raw_form"), F.col("start_pos"), F.col("end_pos")).alias("json"))


MENTION = "CAST(json_merge_patch('{}', json_object('software-type', entity_type, 'software-name', json_object('rawForm', raw_form, 'offsetStart', start_pos, 'offsetEnd', end_pos))) AS VARCHAR)"


@query(f"""WITH {SPANS}, m AS (SELECT text_id, start_pos, {MENTION} AS json FROM s WHERE entity_type = 'software') SELECT text_id, '{{"application":"lectern","version":"1","mentions":[' || string_agg(json, ',' ORDER BY start_pos NULLS FIRST, json) || ']}}' AS json FROM m GROUP BY 1""")
def mention_envelopes(t):
    s = _spans(t).where("entity_type = 'software'").select("text_id", "start_pos", sinks.mention_json(F.col("entity_type"), F.col("raw_form"), F.col("start_pos"), F.col("end_pos")).alias("json"))
    return sinks.envelopes(s, "text_id", "json", "start_pos", "lectern", "1")


@query(f"WITH {SPANS}, d AS (SELECT DISTINCT raw_form AS term FROM s WHERE entity_type = 'software' AND raw_form IS NOT NULL) SELECT lower(left(term, 1)) AS letter, CAST(to_json(list({{'term': term, 'score': CAST(1 AS DOUBLE)}} ORDER BY lower(term), term)) AS VARCHAR) AS json FROM d GROUP BY 1")
def term_vector(t):
    return sinks.term_vector(_spans(t).where("entity_type = 'software'"), "raw_form")


@query(f"WITH {TEXTS}, {SPANS} SELECT t.id, raw_form, min(text_id) AS first_use FROM s JOIN t USING (text_id) WHERE entity_type = 'url' GROUP BY ALL")
def distinct_references(t):
    r = _spans(t).where("entity_type = 'url'").join(_texts(t).select("text_id", "id"), "text_id")
    return sinks.distinct_references(r, "id", "raw_form", "text_id")


@query(f"WITH {SPANS} SELECT a.span_id AS left_id, b.span_id AS right_id FROM s a JOIN s b ON a.text_id = b.text_id AND a.span_id < b.span_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos")
def overlapping_spans(t):
    s = _spans(t)
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (F.col("a.text_id") == F.col("b.text_id")) & (F.col("a.span_id") < F.col("b.span_id")))
    hit = j.where(spans.overlaps(F.col("a.start_pos"), F.col("a.end_pos"), F.col("b.start_pos"), F.col("b.end_pos")))
    return hit.select(F.col("a.span_id").alias("left_id"), F.col("b.span_id").alias("right_id"))


@query(f"WITH {TEXTS}, {SPANS}, p AS (SELECT span_id, start_pos, raw_form, text, string_split(text, raw_form) AS parts FROM s JOIN t USING (text_id) WHERE raw_form <> ''), o AS (SELECT span_id, start_pos, list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(raw_form) AS pl FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS i FROM p)) SELECT span_id, CAST(min_by(pl - start_pos, abs(pl - start_pos) * 2 + CASE WHEN pl > start_pos THEN 1 ELSE 0 END) AS BIGINT) AS shift FROM o GROUP BY 1")
def reanchored_spans(t):
    """How far each span's text stands from its offsets: the nearest of all its occurrences, the one before if two are as near."""
    j = _spans(t).where("raw_form <> ''").join(_texts(t).select("text_id", "text"), "text_id")
    parts = F.expr("split(text, concat('\\\\Q', raw_form, '\\\\E'), -1)")
    j = j.select("span_id", "start_pos", F.length("raw_form").alias("n"), F.transform(parts, F.length).alias("lengths")).where("size(lengths) > 1")
    at = F.aggregate(F.slice("lengths", F.lit(1), F.size("lengths") - 1), F.struct(F.lit(0).alias("upto"), F.lit(None).cast("int").alias("best")), _nearer)
    return j.select("span_id", at["best"].alias("shift")).distinct()


def _nearer(acc, length):
    d = acc["upto"] + length - F.col("start_pos")
    nearer = acc["best"].isNull() | (F.abs(d) < F.abs(acc["best"]))
    return F.struct((acc["upto"] + length + F.col("n")).cast("int").alias("upto"), F.when(nearer, d).otherwise(acc["best"]).cast("int").alias("best"))


@query(f"WITH {TEXTS}, {SPANS}, f AS (SELECT DISTINCT t.id, raw_form FROM s JOIN t USING (text_id) WHERE length(raw_form) > 2) SELECT text_id FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = t.id AND contains(t.text, f.raw_form))")
def clean_paragraphs(t):
    texts = _texts(t)
    f = _spans(t).where("length(raw_form) > 2").join(texts.select("text_id", "id"), "text_id").select(F.col("id").alias("fid"), "raw_form").distinct()
    return texts.join(f, (F.col("id") == F.col("fid")) & F.col("text").contains(F.col("raw_form")), "left_anti").select("text_id")


@query(f"WITH {TEXTS}, {SENT} SELECT text_id, max(b - a) < 1500 AND NOT bool_or(starts_with(substr(text, CAST(a + 1 AS BIGINT), 2), '. ')) AS valid FROM se JOIN t USING (text_id) GROUP BY 1")
def segmentation_validity(t):
    u = spans.sentence_spans(_texts(t), ["text_id"]).join(_texts(t).select("text_id", "text"), "text_id")
    bad = F.expr("startswith(substring(text, start + 1, 2), '. ')")
    return u.groupBy("text_id").agg(((F.max(F.col("end") - F.col("start")) < 1500) & ~F.bool_or(bad)).alias("valid"))


@query(f"""WITH {CHUNK}, n AS (SELECT *, last_value(CASE WHEN role = 'name' THEN {{'id': span_id, 'a': a, 'b': b}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, first_value(CASE WHEN role = 'name' THEN {{'id': span_id, 'a': a, 'b': b}} END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM c WINDOW w AS (PARTITION BY text_id ORDER BY a, b, span_id)),
d AS (SELECT text_id, span_id, role, a, CASE WHEN prev IS NOT NULL AND (next IS NULL OR a - prev.b <= 2 * (next.a - b)) THEN prev.id ELSE next.id END AS name_id, CASE WHEN prev IS NOT NULL AND (next IS NULL OR a - prev.b <= 2 * (next.a - b)) THEN a - prev.b ELSE next.a - b END AS distance FROM n WHERE role <> 'name'),
p AS (SELECT span_id, role, name_id FROM (SELECT *, row_number() OVER (PARTITION BY text_id, name_id, role ORDER BY distance, a, span_id) AS rn FROM d WHERE name_id IS NOT NULL) WHERE rn = 1),
j AS (SELECT s.entity_type AS role, ltrim(s.corresp, '#') AS gold, p.name_id AS found FROM s LEFT JOIN p USING (span_id) WHERE s.entity_type <> 'software')
SELECT role, count(gold) AS expected, count(found) AS predicted, CAST(sum(CASE WHEN gold = found THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM j GROUP BY 1""")
def attachment_counts(t):
    s = _spans(t)
    c = s.select("text_id", F.col("span_id").alias("id"), F.when(F.col("entity_type") == "software", "name").otherwise(F.col("entity_type")).alias("role"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    found = spans.attach_nearest(c, ["text_id"]).select(F.col("id").alias("span_id"), F.col("name_id").alias("found"))
    j = s.where("entity_type <> 'software'").select("span_id", F.col("entity_type").alias("role"), F.ltrim(F.col("corresp"), F.lit("#")).alias("gold")).join(found, "span_id", "left")
    return j.groupBy("role").agg(F.count("gold").alias("expected"), F.count("found").alias("predicted"), F.sum(F.coalesce((F.col("gold") == F.col("found")).cast("int"), F.lit(0))).alias("correct"))


@query(f"WITH {TEXTS}, {SPANS} SELECT span_id, NOT (start_pos < 0 OR end_pos > length(text) OR start_pos > end_pos) AS sane, EXISTS (SELECT 1 FROM s b WHERE b.text_id = s.text_id AND b.span_id <> s.span_id AND b.start_pos <= s.start_pos AND s.end_pos <= b.end_pos) AS inside_other FROM s JOIN t USING (text_id) WHERE entity_type <> 'software'")
def attribute_sanity(t):
    s = _spans(t)
    a = s.where("entity_type <> 'software'").join(_texts(t).select("text_id", F.length("text").alias("n")), "text_id")
    b = s.select("text_id", F.col("span_id").alias("other"), F.col("start_pos").alias("b0"), F.col("end_pos").alias("b1"))
    hit = a.join(b, "text_id").where("other <> span_id and b0 <= start_pos and end_pos <= b1").select("span_id").distinct().withColumn("inside_other", F.lit(True))
    sane = ~((F.col("start_pos") < 0) | (F.col("end_pos") > F.col("n")) | (F.col("start_pos") > F.col("end_pos")))
    return a.join(hit, "span_id", "left").select("span_id", sane.alias("sane"), F.coalesce("inside_other", F.lit(False)).alias("inside_other"))


@query(f"WITH {TEXTS}, {TOKENS}, {SPANS}, p AS (SELECT DISTINCT text_id FROM s WHERE entity_type = 'software') SELECT text_id, len(tokens) > 30 AND len(tokens) < 400 AS fits, text_id IN (SELECT text_id FROM p) AS positive FROM tk")
def paragraph_selection(t):
    from lectern.functions.tokens import count_tokens

    n = count_tokens(F.col("text"))
    p = _spans(t).where("entity_type = 'software'").select("text_id").distinct().withColumn("positive", F.lit(True))
    return _texts(t).select("text_id", ((n > 30) & (n < 400)).alias("fits")).join(p, "text_id", "left").select("text_id", "fits", F.coalesce("positive", F.lit(False)).alias("positive"))


@query(f"{BASE}, x AS (SELECT h.id, h.term, count(*) AS n FROM hits h GROUP BY ALL) SELECT term, count(*) AS docs, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM x GROUP BY 1 ORDER BY total DESC, term LIMIT 50")
def top_terms(t):
    x = _hits(t).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.max("n").alias("most"), F.sum("n").alias("total"))
    return x.orderBy(F.desc("total"), "term").limit(50)  # a top-k report


@query("WITH d AS (SELECT CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 4 AS BIGINT) AS fold, lang, source FROM documents) SELECT coalesce(CAST(fold AS VARCHAR), '-') AS fold, coalesce(lang, '-') AS lang, count(*) AS n FROM d GROUP BY ALL")
def fold_sizes(t):
    return t("documents").groupBy((F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 4).cast("string").alias("fold"), F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TEXTS}, {SPANS}, c AS (SELECT t.id, entity_type, raw_form FROM s JOIN t USING (text_id)), p AS (SELECT DISTINCT a.id AS x, a.raw_form FROM c a JOIN (SELECT soft_name FROM software_names) n ON a.raw_form = n.soft_name) SELECT raw_form AS name, count(*) AS n_docs, md5(min(x)) AS first_doc FROM p GROUP BY 1")
def known_names(t):
    c = _spans(t).join(_texts(t).select("text_id", "id"), "text_id").join(corpus_names(t), "raw_form", "left_semi").select("id", "raw_form").distinct()
    return c.groupBy(F.col("raw_form").alias("name")).agg(F.count(F.lit(1)).alias("n_docs"), F.md5(F.min("id")).alias("first_doc"))


def corpus_names(t):
    return t("software_names").select(F.col("soft_name").alias("raw_form"))
