"""Queries of corpus building and reporting, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.tokens import count_tokens
from lectern.operators import corpus, report
from lectern.plans.core_queries import BASE, LABELLED, SPANS, TEXTS, TOKENS, VOTES, _hits, _labelled, _per_document, _spans, _texts, _votes, query
from lectern.plans.document_queries import QUERIES, SQL  # noqa: F401
from lectern.plans.more_queries import attachment_counts

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"WITH {TEXTS}, {TOKENS}, {SPANS}, p AS (SELECT text_id, count(*) AS k, count(DISTINCT entity_type) AS kinds FROM s GROUP BY 1) SELECT count(DISTINCT t.id) AS documents, count(DISTINCT CASE WHEN k > 0 THEN t.id END) AS positive_documents, count(*) AS paragraphs, count(k) AS positive_paragraphs, CAST(sum(len(tokens)) AS BIGINT) AS tokens, CAST(sum(CASE WHEN k > 0 THEN len(tokens) ELSE 0 END) AS BIGINT) AS positive_tokens, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(coalesce(sum(k), 0) AS BIGINT) AS spans, CAST(sum(CASE WHEN kinds > 1 THEN 1 ELSE 0 END) AS BIGINT) AS with_attributes FROM t JOIN tk USING (text_id) LEFT JOIN p USING (text_id)")
def training_counts(t):
    """Documents, paragraphs and tokens, and those of them with annotations."""
    p = _spans(t).groupBy("text_id").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("entity_type").alias("kinds"))
    x = _texts(t).select("text_id", "id", count_tokens(F.col("text")).alias("n"), F.length("text").alias("c")).join(p, "text_id", "left")
    some = F.col("k").isNotNull()
    return x.agg(
        F.countDistinct("id").alias("documents"), F.countDistinct(F.when(some, F.col("id"))).alias("positive_documents"), F.count(F.lit(1)).alias("paragraphs"), F.count("k").alias("positive_paragraphs"), F.sum("n").alias("tokens"),
        F.sum(F.when(some, F.col("n")).otherwise(0)).alias("positive_tokens"), F.sum("c").alias("chars"), F.coalesce(F.sum("k"), F.lit(0)).alias("spans"), F.sum(F.when(F.col("kinds") > 1, 1).otherwise(0)).alias("with_attributes"),
    )


COUNTERS = {"spans": "true", "software": "entity_type = 'software'", "version": "entity_type = 'version'", "publisher": "entity_type = 'publisher'", "url": "entity_type = 'url'", "used": "used", "not_used": "not used", "unjudged": "used is null", "without_resp": "resp is null", "without_cert": "cert is null", "attached": "corresp is not null", "blank": "raw_form is null or trim(raw_form) = ''", "one_letter": "length(raw_form) = 1", "reversed": "start_pos > end_pos"}


@query(f"WITH {SPANS} SELECT " + ", ".join(f"count(CASE WHEN {c} THEN 1 END) AS {k}" for k, c in COUNTERS.items()) + " FROM s")
def corpus_counters(t):
    return _spans(t).agg(*[F.count(F.when(F.expr(c), 1)).alias(k) for k, c in COUNTERS.items()])


@query(f"WITH {TEXTS}, {SPANS}, u AS (SELECT text_id, sum(end_pos - start_pos) AS c FROM s WHERE entity_type = 'url' AND end_pos > start_pos GROUP BY 1) SELECT coalesce(lang, '-') AS lang, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - coalesce(c, 0)) AS BIGINT) AS kept, round(sum(length(text) - coalesce(c, 0)) / sum(length(text)), 6) AS ratio FROM t LEFT JOIN u USING (text_id) GROUP BY 1")
def relevant_ratio(t):
    """The share of text that isn't reference."""
    u = _spans(t).where("entity_type = 'url' and end_pos > start_pos").groupBy("text_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("c"))
    n, kept = F.length("text"), F.length("text") - F.coalesce("c", F.lit(0))
    g = _texts(t).join(u, "text_id", "left").groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.sum(n).alias("chars"), F.sum(kept).alias("kept"))
    return g.select("lang", "chars", "kept", F.round(F.col("kept") / F.col("chars"), 6).alias("ratio"))


AGREED = "p AS (SELECT CASE WHEN item < '8' THEN 'a' ELSE 'b' END AS half, CASE WHEN a.value = 'yes' OR b.value = 'yes' THEN 'used' ELSE 'not_used' END AS field, CASE WHEN a.value = b.value THEN 1 ELSE 0 END AS same FROM v a JOIN v b USING (item) WHERE a.who < b.who AND a.value IS NOT NULL AND b.value IS NOT NULL)"


@query(f"WITH {VOTES}, {AGREED}, g AS (SELECT half, field, CAST(sum(same) AS BIGINT) AS agreements, count(*) AS samples, sum(same) / count(*) AS rate FROM p GROUP BY ALL), h AS (SELECT field, CAST(sum(agreements) AS BIGINT) AS agreements, CAST(sum(samples) AS BIGINT) AS samples, avg(rate) AS rate FROM g GROUP BY 1) SELECT field, agreements, samples, round(rate, 9) AS rate FROM h")
def combined_agreement(t):
    """Agreement of two halves of the corpus, by field, put together: counts added, rates averaged."""
    v = _votes(t).where("value is not null")
    a, b = v.select("item", F.col("who").alias("w1"), F.col("value").alias("x")), v.select("item", F.col("who").alias("w2"), F.col("value").alias("y"))
    p = a.join(b, "item").where("w1 < w2").select(F.when(F.col("item") < "8", "a").otherwise("b").alias("half"), F.when((F.col("x") == "yes") | (F.col("y") == "yes"), "used").otherwise("not_used").alias("field"), (F.col("x") == F.col("y")).cast("int").alias("same"))
    g = p.groupBy("half", "field").agg(F.sum("same").alias("agreements"), F.count(F.lit(1)).alias("samples"), F.avg("same").alias("rate"))
    half = lambda h: g.where(F.col("half") == h).drop("half")
    return report.averaged(half("a"), half("b"), "field", ["rate"]).select("field", "agreements", "samples", F.round("rate", 9).alias("rate"))


@query(f"WITH {TEXTS}, {VOTES}, d AS (SELECT t.id AS doc, who, count(*) AS n FROM v JOIN (SELECT DISTINCT span_id, text_id FROM entity_spans) e ON e.span_id = v.item JOIN t USING (text_id) GROUP BY ALL) SELECT 'annotator' AS kind, who AS name, CAST(sum(n) AS BIGINT) AS labels, count(*) AS others FROM d GROUP BY 2 UNION ALL SELECT 'document', doc, CAST(sum(n) AS BIGINT), count(*) FROM d GROUP BY 2 UNION ALL SELECT 'all', '', CAST(sum(n) AS BIGINT), count(*) FROM d")
def annotation_tables(t):
    """Labels by annotator (and documents), by document (and annotators), and in all."""
    d = _per_document(t)
    sums = [F.sum("n").alias("labels"), F.count(F.lit(1)).alias("others")]
    by = lambda kind, c: d.groupBy(F.col(c).alias("name")).agg(*sums).select(F.lit(kind).alias("kind"), "name", "labels", "others")
    return by("annotator", "who").unionByName(by("document", "doc")).unionByName(d.agg(*sums).select(F.lit("all").alias("kind"), F.lit("").alias("name"), "labels", "others"))


@query("WITH x AS (" + SQL["attachment_counts"] + ") SELECT role, expected, predicted, correct, CASE WHEN predicted > 0 THEN round(correct / predicted, 9) ELSE 0 END AS precision, CASE WHEN expected > 0 THEN round(correct / expected, 9) ELSE 0 END AS recall, CASE WHEN correct > 0 THEN round(2 * (correct / predicted) * (correct / expected) / (correct / predicted + correct / expected), 9) ELSE 0 END AS f1 FROM x")
def attachment_scores(t):
    x = attachment_counts(t)
    p, r, f = report.rates(F.col("correct"), F.col("predicted"), F.col("expected"))
    return x.select("role", "expected", "predicted", "correct", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f, 9).alias("f1"))


@query(f"""WITH {LABELLED}, {SPANS}, tl AS (SELECT text_id, i - 1 AS pos, CAST(length(array_to_string(tokens[1:i-1], '')) AS BIGINT) AS a, CAST(length(array_to_string(tokens[1:i], '')) AS BIGINT) AS b FROM tp), gd AS (SELECT tl.text_id, tl.pos, min(CASE WHEN s.entity_type IN ('software', 'version') THEN '<' || s.entity_type || '>' END) AS gold FROM tl JOIN s ON s.text_id = tl.text_id AND tl.a >= s.start_pos AND tl.b <= s.end_pos GROUP BY ALL),
pr AS (SELECT coalesce(gold, '<other>') AS gold, label AS found, count(*) AS n FROM lb LEFT JOIN gd USING (text_id, pos) GROUP BY ALL), l AS (SELECT DISTINCT unnest([gold, found]) AS label FROM pr), c AS (SELECT label, CAST(coalesce(sum(n) FILTER (WHERE gold = label AND found = label), 0) AS BIGINT) AS c, CAST(coalesce(sum(n) FILTER (WHERE gold = label), 0) AS BIGINT) AS g, CAST(coalesce(sum(n) FILTER (WHERE found = label), 0) AS BIGINT) AS f, CAST(sum(n) AS BIGINT) AS n FROM l, pr GROUP BY 1)
SELECT label, round(1 - (g + f - 2 * c) / n, 9) AS accuracy, round(CASE WHEN f > 0 THEN c / f ELSE 0 END, 9) AS precision, round(CASE WHEN g > 0 THEN c / g ELSE 0 END, 9) AS recall, round(CASE WHEN c > 0 THEN 2 * (c / f) * (c / g) / (c / f + c / g) ELSE 0 END, 9) AS f1, g AS support FROM c""")
def token_scores(t):
    """Accuracy, precision and recall of token labels against the annotated spans."""
    from lectern.functions.tokens import token_table

    at = token_table(_texts(t), keep=("text_id",)).select("text_id", "pos", "start", "end")
    s = _spans(t).where("entity_type in ('software', 'version')").select("text_id", F.concat(F.lit("<"), "entity_type", F.lit(">")).alias("gold"), "start_pos", "end_pos")
    gold = at.join(s, "text_id").where("start >= start_pos and end <= end_pos").groupBy("text_id", "pos").agg(F.min("gold").alias("gold"))
    pairs = _labelled(t).join(gold, ["text_id", "pos"], "left").groupBy(F.coalesce("gold", F.lit("<other>")).alias("gold"), F.col("label").alias("found")).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n").alias("total"))
    scores = report.label_scores(pairs.join(F.broadcast(total)).select("gold", "found", "n"), F.lit(1))  # one row
    s = scores.join(F.broadcast(total))
    return s.select("label", F.round(1 - (1 - F.col("accuracy")) / F.col("total"), 9).alias("accuracy"), *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"{BASE}, e AS (SELECT DISTINCT text_id, start_pos AS a, end_pos AS b FROM entity_spans WHERE entity_type = 'software'), k AS (SELECT e.text_id, count(*) AS g, count(h.term) AS f FROM e JOIN t USING (text_id) LEFT JOIN (SELECT DISTINCT text_id, start, start + length(term) AS stop, min(term) AS term FROM hits GROUP BY 1, 2, 3) h ON h.text_id = e.text_id AND h.start = e.a AND h.stop = e.b GROUP BY 1) SELECT count(*) AS instances, count(CASE WHEN g = f THEN 1 END) AS whole, round(count(CASE WHEN g = f THEN 1 END) / count(*), 9) AS instance_recall FROM k")
def instance_recall(t):
    """The share of paragraphs whose annotated names are all found."""
    e = _spans(t).where("entity_type = 'software'").select("text_id", F.col("start_pos").cast("bigint").alias("a"), F.col("end_pos").cast("bigint").alias("b")).distinct().join(_texts(t).select("text_id"), "text_id")
    h = _hits(t).select("text_id", F.col("start").cast("bigint").alias("a"), F.col("end").cast("bigint").alias("b")).distinct().withColumn("hit", F.lit(1))
    k = e.join(h, ["text_id", "a", "b"], "left").groupBy("text_id").agg((F.count(F.lit(1)) == F.count("hit")).alias("whole"))
    g = k.agg(F.count(F.lit(1)).alias("instances"), F.count(F.when(F.col("whole"), 1)).alias("whole"))
    return g.select("instances", "whole", F.round(F.col("whole") / F.col("instances"), 9).alias("instance_recall"))


@query(f"WITH {TEXTS} SELECT text_id FROM (SELECT text_id, id, row_number() OVER (PARTITION BY id ORDER BY para_no, text_id) AS n FROM t) WHERE n % 2 = 0")
def every_second_paragraph(t):
    return report.every_kth(_texts(t).select("text_id", "id", "para_no"), "id", ["para_no", "text_id"], 2).select("text_id")


@query("WITH x AS (SELECT DISTINCT text_id, id, para_no, section_head FROM texts WHERE text IS NOT NULL), h AS (SELECT id, min_by(section_head, {'p': para_no, 't': text_id}) AS title FROM x WHERE trim(section_head) <> '' AND id IS NOT NULL GROUP BY 1) SELECT text_id, coalesce(CASE WHEN trim(section_head) <> '' THEN section_head END, title) AS section_head FROM x LEFT JOIN h USING (id)")
def filled_headings(t):
    """An empty heading is that of the first paragraph of the article that has one."""
    x = t("texts").where("text is not null").select("text_id", "id", "para_no", "section_head").distinct()
    h = x.where("trim(section_head) <> '' and id is not null").groupBy("id").agg(F.min_by("section_head", F.struct("para_no", "text_id")).alias("title"))
    return report.missing_titles(x, h, "id", "section_head").select("text_id", "section_head")


@query(f"WITH {TEXTS}, m AS (SELECT id, min(doi) AS doi, min(pmcid) AS pmcid, min(split) AS split FROM id_map GROUP BY 1), j AS (SELECT text_id, t.id, doi, pmcid, split FROM t LEFT JOIN m ON m.id = t.id) SELECT text_id, CAST(json_merge_patch('{{}}', json_object('id', id, 'doi', CASE WHEN trim(doi) <> '' THEN doi END, 'pmc', CASE WHEN trim(pmcid) <> '' THEN pmcid END, 'split', CASE WHEN trim(split) <> '' THEN split END)) AS VARCHAR) AS json FROM j")
def metadata_json(t):
    """A paragraph's article data as JSON, without its blank fields."""
    m = t("id_map").groupBy("id").agg(*[F.min(c).alias(c) for c in ("doi", "pmcid", "split")])
    full = lambda c: F.when(F.trim(c) != "", F.col(c))
    return _texts(t).select("text_id", "id").join(m, "id", "left").select("text_id", F.to_json(F.struct("id", full("doi").alias("doi"), full("pmcid").alias("pmc"), full("split").alias("split"))).alias("json"))


WORDS = ("software", "package", "version", "script", "licence", "program")


@query(f"WITH {TEXTS}, w AS (SELECT text_id, unnest(regexp_extract_all(lower(text), '\\b({'|'.join(WORDS)})\\b')) AS word FROM t) SELECT text_id, word, count(*) AS n FROM w GROUP BY ALL")
def whitelisted_words(t):
    w = _texts(t).select("text_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\b({'|'.join(WORDS)})\b"), F.lit(0))).alias("word"))
    return w.groupBy("text_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TEXTS}, {SPANS} SELECT split_part(span_id, '-', 1) AS doc, count(*) AS spans, count(DISTINCT t.text_id) AS paragraphs FROM s JOIN t ON t.id = split_part(span_id, '-', 1) AND t.text_id = s.text_id GROUP BY 1")
def annotated_documents(t):
    """Annotations met with documents by the prefix of their ids."""
    s = _spans(t).select("span_id", "text_id", F.split_part("span_id", F.lit("-"), F.lit(1)).alias("id"))
    return s.join(_texts(t).select("text_id", "id"), ["text_id", "id"]).groupBy(F.col("id").alias("doc")).agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("text_id").alias("paragraphs"))


@query(f"WITH {SPANS} SELECT span_id, coalesce(lower(trim(raw_form)) IN (SELECT lower(publisher) FROM software_names WHERE publisher IS NOT NULL), false) AS known, raw_form IS NOT NULL AND regexp_matches(raw_form, '^[A-Z]') AND lower(raw_form) IN ('a', 'an', 'and', 'the', 'we', 'in', 'of', 'for', 'r') AS capital_stopword FROM s WHERE entity_type IN ('software', 'publisher') AND trim(raw_form) <> ''")
def property_values(t):
    """Values of the accepted kinds: known ones, and capitalised function words that aren't propagated."""
    known = t("software_names").where("publisher is not null").select(F.lower("publisher").alias("k")).distinct().withColumn("known", F.lit(True))
    s = _spans(t).where("entity_type in ('software', 'publisher') and trim(raw_form) <> ''").withColumn("k", F.lower(F.trim("raw_form")))
    stop = F.col("raw_form").rlike("^[A-Z]") & F.lower("raw_form").isin("a", "an", "and", "the", "we", "in", "of", "for", "r")
    return s.join(known, "k", "left").select("span_id", F.coalesce("known", F.lit(False)).alias("known"), stop.alias("capital_stopword"))


UNMATCHED = "um AS (SELECT span_id, t.id AS doc, text_id, raw_form FROM s JOIN t USING (text_id) WHERE raw_form IS NOT NULL AND NOT contains(text, raw_form))"


def _unmatched(t):
    return _spans(t).where("raw_form is not null").join(_texts(t).select("text_id", "text", F.col("id").alias("doc")), "text_id").where(~F.contains("text", "raw_form")).select("span_id", "doc", "text_id", "raw_form")


@query(f"WITH {TEXTS}, {SPANS}, {UNMATCHED} SELECT span_id, raw_form, doc || '/' || text_id AS path FROM um")
def unmatched_annotations(t):
    return _unmatched(t).select("span_id", "raw_form", F.concat_ws("/", "doc", F.col("text_id").cast("string")).alias("path")).where("doc is not null")


@query(f"WITH {TEXTS}, {SPANS}, {UNMATCHED}, f AS (SELECT * FROM t WHERE id NOT IN (SELECT doc FROM um WHERE doc IS NOT NULL)) SELECT 'with_unmatched' AS variant, id AS doc, text_id FROM t UNION ALL SELECT 'full', id, text_id FROM f UNION ALL SELECT 'positives', id, text_id FROM f WHERE text_id IN (SELECT text_id FROM s)")
def corpus_variants(t):
    return report.variants(_texts(t).select(F.col("id").alias("doc"), "text_id"), _spans(t), _unmatched(t), "text_id")


@query(f"""WITH {TEXTS}, {SPANS}, i AS (SELECT s.text_id, list_sort(list(DISTINCT {{'a': start_pos, 'e': -end_pos, 't': entity_type, 'i': span_id}})) AS l, any_value(text) AS text FROM s JOIN t USING (text_id) WHERE start_pos >= 0 AND start_pos < end_pos AND end_pos <= length(text) AND entity_type IS NOT NULL GROUP BY 1),
f AS (SELECT text_id, text, list_reduce(list_prepend({{'a': 0, 'e': 0, 't': '', 'i': ''}}, l), lambda acc, x: CASE WHEN x.a >= -acc.e THEN {{'a': 0, 'e': x.e, 't': acc.t || {_ESC.format('substr(text, 1 - acc.e, x.a + acc.e)')} || '<rs type="' || x.t || '" id="' || x.i || '">' || {_ESC.format('substr(text, x.a + 1, -x.e - x.a)')} || '</rs>', 'i': ''}} ELSE acc END) AS r FROM i)
SELECT t.text_id, '<p>' || CASE WHEN r IS NULL THEN {_ESC.format('t.text')} ELSE r.t || {_ESC.format('substr(t.text, 1 - r.e)')} END || '</p>' AS snippet FROM t LEFT JOIN f USING (text_id)""")
def annotated_snippets(t):
    """Every paragraph with its annotations in place; those without any are the negative snippets."""
    s = _spans(t).where("entity_type is not null").select("text_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.col("entity_type").alias("type"), F.col("span_id").alias("id"))
    return report.inline_markup(_texts(t).select("text_id", "text"), s, ["text_id"])


@query(f"WITH {SPANS} SELECT text_id, array_to_string(list(span_id ORDER BY start_pos ASC NULLS FIRST, end_pos ASC NULLS FIRST, span_id), ' ') AS spans FROM s GROUP BY 1")
def ordered_annotations(t):
    """The annotations of a text in order; those without a place come first."""
    o = F.array_sort(F.collect_list(F.struct(F.coalesce("start_pos", F.lit(-(1 << 31))).alias("a"), F.coalesce("end_pos", F.lit(-(1 << 31))).alias("b"), "span_id")))
    return _spans(t).groupBy("text_id").agg(F.array_join(F.transform(o, lambda x: x["span_id"]), " ").alias("spans"))


@query(f"WITH {TEXTS}, {SPANS}, p AS (SELECT text_id, bool_or(entity_type = 'software') AS y FROM s GROUP BY 1), n AS (SELECT t.text_id FROM t LEFT JOIN p USING (text_id) WHERE NOT coalesce(y, false)) SELECT text_id FROM n WHERE ('0x' || substr(md5(CAST(text_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < 0.5")
def sampled_negatives(t):
    """Half of the paragraphs without a name, drawn by hash."""
    p = _spans(t).where("entity_type = 'software'").select("text_id").distinct()
    n = _texts(t).select("text_id").join(p, "text_id", "left_anti")
    return n.where(corpus.hash_unit(F.col("text_id")) < 0.5)


@query(f"WITH {LABELLED}, x AS (SELECT text_id, pos, CASE label WHEN '<software>' THEN '<environment>' WHEN '<version>' THEN '<language>' ELSE label END AS label FROM lb), y AS (SELECT *, lag(label) OVER (PARTITION BY text_id ORDER BY pos) AS p FROM x) SELECT text_id, pos, CASE WHEN label <> '<other>' AND label IS DISTINCT FROM p THEN 'I-' || label ELSE label END AS label FROM y")
def type_labels(t):
    """Rows of type labels, the first of each run marked."""
    from lectern.operators import evaluate

    kind = F.when(F.col("label") == "<software>", "<environment>").when(F.col("label") == "<version>", "<language>").otherwise(F.col("label"))
    return evaluate.begin_labels(_labelled(t).withColumn("label", kind), ["text_id"]).select("text_id", "pos", F.col("iob").alias("label"))
