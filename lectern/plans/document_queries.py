"""Queries of refinement, alignment and value operators, each with its SQL.

Bindings beyond those of core_queries: URLs are the reference markers; version spans stand for languages where an operator needs a second
kind of span that may lie beside or inside a name, publisher spans for environments; names of publishers are the black list."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import normalize, values
from lectern.functions.tokens import DELIMITERS, PATTERN, count_tokens, tokenize
from lectern.operators import align, refine, spans
from lectern.plans.core_queries import SENT, SPANS, TEXTS, TOKENS, _spans, _texts, query
from lectern.plans.more_queries import QUERIES, SQL  # noqa: F401


def _n(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{PATTERN}'))"


def _sig(text: str) -> str:
    return f"regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]', '', 'g')"


MARKS = "".join(map(chr, DELIMITERS))
LONE = "instr(" + " || ".join(f"chr({c})" for c in DELIMITERS) + ", trim(raw_form)) > 0"
FEW = "(VALUES ('a'), ('an'), ('and'), ('as'), ('at'), ('by'), ('for'), ('from'), ('in'), ('of'), ('on'), ('or'), ('the'), ('to'), ('was'), ('were'), ('with'))"
STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "was", "were", "with")


@query(f"""WITH {TEXTS}, m AS (SELECT text_id, text, regexp_extract_all(text, '{refine.URL_IN_TEXT}') AS f, regexp_split_to_array(text, '{refine.URL_IN_TEXT}') AS b FROM t), u AS (SELECT text_id, text, f, b, unnest(generate_series(1, len(f))) AS i FROM m),
c AS (SELECT text_id, text, f[i] AS "match", length(array_to_string(b[1:i], '')) + length(array_to_string(f[1:i-1], '')) AS a FROM u)
SELECT text_id, "match", CAST(a AS BIGINT) AS start, CAST(a + length("match") AS BIGINT) AS "end", CAST({_n("left(text, a)")} AS BIGINT) AS first_token, CAST({_n('left(text, a + length("match"))')} - 1 AS BIGINT) AS last_token FROM c""")
def url_spans(t):
    """URLs in running text as spans of characters and of tokens."""
    u = refine.pattern_spans(_texts(t), ["text_id"], refine.URL_IN_TEXT).join(_texts(t).select("text_id", "text"), "text_id")
    return u.select("text_id", "match", "start", "end", count_tokens(F.expr("left(text, start)")).alias("first_token"), (count_tokens(F.expr("left(text, end)")) - 1).alias("last_token"))


@query(f"""WITH {SPANS}, p AS (SELECT DISTINCT lower(publisher) AS b FROM software_names WHERE publisher IS NOT NULL), k AS (SELECT span_id, entity_type, trim(raw_form) AS c, raw_form, {LONE} AS lone, regexp_full_match(trim(raw_form), '[0-9]+') AS num, CASE WHEN length(trim(raw_form)) = 1 THEN lower(trim(raw_form)) ELSE trim(raw_form) END IN (SELECT * FROM {FEW}) AS stop, lower(trim(raw_form)) IN (SELECT b FROM p) AS black FROM s WHERE raw_form IS NOT NULL),
m AS (SELECT DISTINCT a.span_id FROM s a JOIN s b ON a.text_id = b.text_id AND b.entity_type = 'url' AND a.entity_type <> 'url' AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos)
SELECT span_id, CASE WHEN entity_type = 'software' THEN NOT (lone OR stop OR num) AND NOT black WHEN entity_type = 'url' THEN NOT (lone OR stop OR num) AND replace(c, chr(10), '') <> '//' WHEN entity_type = 'version' THEN NOT lone WHEN entity_type = 'publisher' THEN NOT (lone OR stop OR num) AND NOT (starts_with(c, '-') AND contains(c, chr(10))) ELSE NOT (lone OR stop OR num) END AS valid, span_id IN (SELECT span_id FROM m) AS on_marker FROM k""")
def chunk_validity(t):
    s = _spans(t).where("raw_form is not null")
    c = F.trim("raw_form")
    black = t("software_names").where("publisher is not null").select(F.lower("publisher").alias("b")).distinct().withColumn("black", F.lit(True))
    stop = F.when(F.length(c) == 1, F.lower(c)).otherwise(c).isin(*STOPWORDS)
    marks = _spans(t).where("entity_type = 'url'").select("text_id", F.col("start_pos").alias("m0"), F.col("end_pos").alias("m1"))
    on = s.where("entity_type <> 'url'").join(marks, "text_id").where(spans.overlaps(F.col("start_pos"), F.col("end_pos"), F.col("m0"), F.col("m1"))).select("span_id").distinct().withColumn("on_marker", F.lit(True))
    j = s.withColumn("b", F.lower(c)).join(black, "b", "left").join(on, "span_id", "left")
    return j.select("span_id", refine.is_chunk(F.col("entity_type"), F.col("raw_form"), MARKS, stop, F.coalesce("black", F.lit(False))).alias("valid"), F.coalesce("on_marker", F.lit(False)).alias("on_marker"))


@query(f"""WITH {SPANS}, n AS (SELECT text_id, span_id AS id, start_pos AS a, end_pos AS b, raw_form AS raw FROM s WHERE entity_type = 'software' AND raw_form IS NOT NULL), y AS (SELECT text_id, span_id AS tid, start_pos AS a, end_pos AS b, raw_form AS raw, CASE entity_type WHEN 'version' THEN 'language' WHEN 'publisher' THEN 'environment' ELSE 'implicit' END AS type FROM s WHERE entity_type <> 'software' AND raw_form IS NOT NULL),
j AS (SELECT n.*, y.tid, y.a AS ta, y.b AS tb, y.raw AS traw, y.type, y.a = n.a AND y.b = n.b AS exact FROM n JOIN y ON n.text_id = y.text_id AND n.a < y.b AND y.a < n.b),
o AS (SELECT text_id, id, min({{'a': ta, 'i': tid, 'type': type}}) FILTER (WHERE type <> 'language') AS other, min({{'a': ta, 'i': tid, 'r': traw, 'l': starts_with(raw, traw)}}) FILTER (WHERE type = 'language' AND NOT exact AND (starts_with(raw, traw) OR ends_with(raw, traw))) AS cut, bool_or(type = 'language' AND exact) AS env FROM j GROUP BY ALL),
f AS (SELECT * FROM y WHERE tid NOT IN (SELECT tid FROM j)), d AS (SELECT n.text_id, n.id, n.a, f.tid, f.raw AS traw, CASE WHEN n.b <= f.a THEN f.a - n.b ELSE n.a - f.b END AS d FROM n JOIN f ON n.text_id = f.text_id AND f.type = 'language'),
w AS (SELECT text_id, tid, traw, min({{'d': d, 'a': a, 'id': id}}) AS m FROM d WHERE d >= 0 AND d < 20 GROUP BY ALL), near AS (SELECT text_id, m.id AS id, min({{'d': m.d, 'tid': tid, 'traw': traw}}) AS x FROM w GROUP BY ALL),
r AS (SELECT n.*, o.other, o.cut, o.env, near.x, CASE WHEN o.cut IS NULL THEN n.raw WHEN o.cut.l THEN ltrim(substr(n.raw, length(o.cut.r) + 1)) ELSE rtrim(left(n.raw, length(n.raw) - length(o.cut.r))) END AS rest FROM n LEFT JOIN o ON n.text_id = o.text_id AND n.id = o.id LEFT JOIN near ON n.text_id = near.text_id AND n.id = near.id)
SELECT text_id, id, CAST(CASE WHEN cut.l THEN a + length(raw) - length(rest) ELSE a END AS BIGINT) AS start, CAST(CASE WHEN NOT cut.l THEN b - (length(raw) - length(rest)) ELSE b END AS BIGINT) AS "end", rest AS raw, CASE WHEN coalesce(env, false) THEN 'environment' ELSE coalesce(other.type, 'software') END AS type, coalesce(cut.r, x.traw) AS language FROM r
UNION ALL SELECT text_id, tid, a, b, raw, type, NULL FROM f WHERE type = 'implicit'""")
def type_refinement(t):
    s = _spans(t).where("raw_form is not null")
    names = s.where("entity_type = 'software'").select("text_id", F.col("span_id").alias("id"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.col("raw_form").alias("raw"))
    kind = F.when(F.col("entity_type") == "version", "language").when(F.col("entity_type") == "publisher", "environment").otherwise("implicit")
    types = s.where("entity_type <> 'software'").select("text_id", F.col("span_id").alias("tid"), F.col("start_pos").alias("t0"), F.col("end_pos").alias("t1"), F.col("raw_form").alias("traw"), kind.alias("type"))
    return refine.refine_types(names, types, ["text_id"])


@query(f"""WITH {TEXTS}, {SPANS}, l AS (SELECT ltrim(corresp, '#') AS id, array_to_string(list_sort(list(DISTINCT raw_form)), ' ') AS refs FROM s WHERE entity_type = 'url' AND corresp IS NOT NULL AND raw_form IS NOT NULL GROUP BY 1), m AS (SELECT span_id, t.id AS doc, raw_form, text_id, start_pos, refs FROM s JOIN t USING (text_id) LEFT JOIN l ON l.id = s.span_id WHERE entity_type = 'software')
SELECT span_id, coalesce(refs, first_value(refs IGNORE NULLS) OVER (PARTITION BY doc, raw_form ORDER BY text_id, start_pos, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS refs FROM m""")
def copied_links(t):
    """References of a mention, or of the first mention of its name in the document that has some."""
    s = _spans(t)
    refs = s.where("entity_type = 'url' and corresp is not null and raw_form is not null").groupBy(F.ltrim(F.col("corresp"), F.lit("#")).alias("span_id")).agg(F.array_join(F.array_sort(F.collect_set("raw_form")), " ").alias("refs"))
    m = s.where("entity_type = 'software'").join(_texts(t).select("text_id", F.col("id").alias("doc")), "text_id").select("span_id", "doc", "raw_form", "text_id", "start_pos").join(refs, "span_id", "left")
    return refine.copied_refs(m, "doc", "raw_form", ["text_id", "start_pos", "span_id"], "refs").select("span_id", "refs")


@query(f"""WITH {TEXTS}, {SPANS}, c AS (SELECT text_id, span_id, start_pos AS a, end_pos AS b, '#b' || (CAST(regexp_extract(raw_form, '([0-9]{{1,9}})', 1) AS BIGINT) - 1) AS key FROM s WHERE entity_type = 'version' AND regexp_extract(raw_form, '([0-9]{{1,9}})', 1) <> ''), {SENT},
e AS (SELECT s.text_id, s.span_id, s.end_pos, min(se.b) AS upto FROM s JOIN se ON s.text_id = se.text_id AND se.a <= s.start_pos AND s.end_pos <= se.b WHERE entity_type = 'software' GROUP BY ALL),
g AS (SELECT e.span_id, e.end_pos, list_sort(list(DISTINCT {{'a': c.a, 'b': c.b, 'r': c.key}})) AS l FROM e JOIN c ON e.text_id = c.text_id AND c.a >= e.end_pos AND c.b <= e.upto GROUP BY ALL),
f AS (SELECT span_id, list_reduce(list_prepend([{{'a': -1, 'b': end_pos, 'r': ''}}], list_transform(l, lambda x: [x])), lambda acc, x: CASE WHEN x[1].a <= acc[len(acc)].b + 10 THEN list_concat(acc, x) ELSE acc END) AS kept FROM g)
SELECT span_id AS id, u.r AS ref FROM (SELECT span_id, unnest(kept) AS u FROM f) WHERE u.r <> ''""")
def callouts_by_key(t):
    """Numbered markers in a name's sentence, as keys of the bibliography, chained within ten characters."""
    s = _spans(t)
    units = spans.sentence_spans(_texts(t), ["text_id"])
    names = s.where("entity_type = 'software'").select("text_id", F.col("span_id").alias("id"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    inside = spans.containing(names, units, ["text_id"])
    marks = s.where("entity_type = 'version'").select("text_id", refine.callout_key(F.col("raw_form")).alias("ref"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).where("ref is not null")
    within = marks.join(inside.select("text_id", "id", "unit_end", F.col("end").alias("name_end")), "text_id").where("start >= name_end and end <= unit_end").select("text_id", "id", "ref", "start", "end").distinct()
    return spans.attach_callouts(inside.select("text_id", "id", "start", "end"), within, ["text_id", "id"], gap=10).select("id", "ref")


@query("SELECT span_id, rtrim(CASE WHEN cert > 0.5 THEN 'used,' ELSE '' END || CASE WHEN 1 - cert > 0.5 THEN 'created,' ELSE '' END || CASE WHEN abs(2 * cert - 1) > 0.5 THEN 'shared,' ELSE '' END, ',') AS classes FROM (SELECT DISTINCT span_id, cert FROM entity_spans WHERE cert IS NOT NULL)")
def context_classes(t):
    c = F.col("cert")
    return _spans(t).where("cert is not null").select("span_id", refine.context_classes(c, 1 - c, F.abs(2 * c - 1)).alias("classes")).distinct()


@query(f"WITH {TEXTS}, {SPANS}, p AS (SELECT text_id, bool_or(entity_type = 'url') AS u, max(1 - cert) AS c, max(abs(2 * cert - 1)) AS h FROM s GROUP BY 1) SELECT text_id FROM t JOIN p USING (text_id) WHERE u OR c >= 0.1 OR h >= 0.1")
def context_set(t):
    """Contexts worth labelling: with a URL, or possibly created or shared."""
    p = _spans(t).groupBy("text_id").agg(F.bool_or(F.col("entity_type") == "url").alias("u"), F.max(1 - F.col("cert")).alias("c"), F.max(F.abs(2 * F.col("cert") - 1)).alias("h"))
    return _texts(t).select("text_id").join(p.where("u or c >= 0.1 or h >= 0.1"), "text_id", "left_semi")


CONTEXT = f"x AS (SELECT span_id, lower(raw_form) AS text, used, cert, resp, {_sig('substr(text, greatest(start_pos - 10, 0) + 1, start_pos - greatest(start_pos - 10, 0))')} AS l, {_sig('substr(text, end_pos + 1, 10)')} AS r FROM s JOIN t USING (text_id) WHERE raw_form IS NOT NULL)"


@query(f"WITH {TEXTS}, {SPANS}, {CONTEXT} SELECT span_id, coalesce(used, first_value(used IGNORE NULLS) OVER w) AS used, coalesce(cert, first_value(cert IGNORE NULLS) OVER w) AS cert, coalesce(resp, first_value(resp IGNORE NULLS) OVER w) AS resp FROM x WINDOW w AS (PARTITION BY text, l, r ORDER BY span_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def transferred_usage(t):
    s = _spans(t).where("raw_form is not null").join(_texts(t).select("text_id", F.col("text").alias("body")), "text_id")
    left, right = align.side_signatures(F.col("body"), F.col("start_pos"), F.col("end_pos"))
    x = s.select("span_id", F.lower("raw_form").alias("text"), left.alias("left"), right.alias("right"), "used", "cert", "resp")
    return align.transferred(x, ["used", "cert", "resp"], "span_id").select("span_id", "used", "cert", "resp")


@query(f"WITH {TEXTS}, {SPANS} SELECT span_id, CAST(instr(lower(text), lower(raw_form)) - 1 AS BIGINT) AS place FROM s JOIN t USING (text_id) WHERE raw_form <> ''")
def fields_in_quotes(t):
    s = _spans(t).where("raw_form <> ''").join(_texts(t).select("text_id", "text"), "text_id")
    return s.select("span_id", align.field_in_quote(F.col("text"), F.col("raw_form")).alias("place"))


@query(f"""WITH {TEXTS}, {TOKENS}, {SPANS}, f AS (SELECT a.text_id, a.span_id AS id, a.entity_type AS label, regexp_extract_all(a.raw_form, '{PATTERN}') AS words, n.start_pos AS anchor FROM s a JOIN s n ON a.corresp = '#' || n.span_id AND a.text_id = n.text_id WHERE a.raw_form <> '' AND a.entity_type <> 'software'),
h AS (SELECT f.*, i - 1 AS pos, abs(i - 1 - {_n("left(text, anchor)")}) AS distance FROM f JOIN tp ON tp.text_id = f.text_id AND tokens[i:i+len(words)-1] = words JOIN t ON t.text_id = f.text_id), b AS (SELECT text_id, id, min({{'d': distance, 'p': pos}}) AS m FROM h WHERE distance < CASE label WHEN 'version' THEN 20 WHEN 'publisher' THEN 60 ELSE 100 END GROUP BY ALL)
SELECT text_id, id, CAST(m.p AS BIGINT) AS pos, CAST(m.d AS BIGINT) AS distance FROM b""")
def nearest_attributes(t):
    """Where in the document's tokens an annotated attribute stands: the occurrence nearest to its name."""
    s = _spans(t)
    name = s.select("text_id", F.concat(F.lit("#"), "span_id").alias("corresp"), F.col("start_pos").alias("anchor"))
    f = s.where("raw_form <> '' and entity_type <> 'software'").select("text_id", "corresp", F.col("span_id").alias("id"), F.col("entity_type").alias("label"), F.col("raw_form").alias("raw")).join(name, ["text_id", "corresp"])
    return align.nearest_occurrence(_texts(t), f, "text_id", {"version": 20, "publisher": 60, "url": 100})


@query(f"WITH {TEXTS}, {SPANS}, {SENT}, x AS (SELECT DISTINCT se.text_id, se.a FROM se JOIN s ON se.text_id = s.text_id AND se.a > start_pos AND se.a < end_pos), k AS (SELECT se.text_id, se.a, se.b, sum(CASE WHEN x.a IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY se.text_id ORDER BY se.a) AS island FROM se LEFT JOIN x ON se.text_id = x.text_id AND se.a = x.a) SELECT text_id, CAST(min(a) AS BIGINT) AS start, CAST(max(b) AS BIGINT) AS \"end\" FROM k GROUP BY text_id, island")
def merged_sentences(t):
    s = _spans(t).select("text_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    return align.merged_sentences(spans.sentence_spans(_texts(t), ["text_id"]).select("text_id", "start", "end"), s, ["text_id"])


@query()
def aligned_paragraphs(t):
    """Paragraphs of an article aligned with its paragraphs of the other parity; no SQL has the similarity."""
    x = _texts(t).select(F.col("id").alias("doc"), F.col("text_id").alias("id"), "text")
    names = _spans(t).select(F.col("text_id").alias("id"), F.col("raw_form").alias("name"))
    return align.aligned_paragraphs(x.where("id % 2 = 0"), x.where("id % 2 = 1"), "doc", names)


@query(f"""WITH {TEXTS}, {SPANS}, w AS (SELECT span_id, s.text_id, raw_form, {_sig("array_to_string(list_reverse(list_reverse(regexp_extract_all(left(text, start_pos), '" + PATTERN + "'))[1:10]), '')")} AS l, {_sig("array_to_string(list_slice(regexp_extract_all(substr(text, end_pos + 1), '" + PATTERN + "'), 1, 10), '')")} AS r FROM s JOIN t USING (text_id) WHERE raw_form IS NOT NULL AND start_pos >= 0)
SELECT a.span_id AS left_id, b.span_id AS right_id FROM w a JOIN w b ON a.text_id = b.text_id AND a.raw_form = b.raw_form AND a.span_id < b.span_id WHERE (ends_with(a.l, b.l) OR ends_with(b.l, a.l)) AND (starts_with(a.r, b.r) OR starts_with(b.r, a.r))""")
def quote_agreement(t):
    """Pairs of annotations of one text and writing whose ten tokens on either side agree."""
    s = _spans(t).where("raw_form is not null and start_pos >= 0").join(_texts(t).select("text_id", "text"), "text_id")
    before, behind = tokenize(F.expr("left(text, start_pos)")), tokenize(F.expr("substring(text, end_pos + 1)"))
    left = F.when(F.size(before) > 10, F.slice(before, -10, 10)).otherwise(before)
    w = s.select("span_id", "text_id", "raw_form", normalize.signature(F.array_join(left, "")).alias("l"), normalize.signature(F.array_join(F.slice(behind, 1, 10), "")).alias("r"))
    a, b = w.alias("a"), w.alias("b")
    j = a.join(b, (F.col("a.text_id") == F.col("b.text_id")) & (F.col("a.raw_form") == F.col("b.raw_form")) & (F.col("a.span_id") < F.col("b.span_id")))
    both = (F.endswith("a.l", "b.l") | F.endswith("b.l", "a.l")) & (F.startswith("a.r", "b.r") | F.startswith("b.r", "a.r"))
    return j.where(both).select(F.col("a.span_id").alias("left_id"), F.col("b.span_id").alias("right_id"))


@query(f"WITH {TEXTS}, x AS (SELECT text_id, id, para_no, section_head, CASE WHEN section_head IS NOT DISTINCT FROM lag(section_head) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st FROM (SELECT DISTINCT text_id, id, para_no, section_head FROM texts WHERE text IS NOT NULL) WINDOW w AS (PARTITION BY id ORDER BY para_no, text_id)), k AS (SELECT *, sum(st) OVER (PARTITION BY id ORDER BY para_no, text_id) AS sec FROM x) SELECT id, CAST(sec AS BIGINT) AS section, min(text_id) AS first_id, count(*) AS n FROM k WHERE id IS NOT NULL GROUP BY 1, 2")
def section_islands(t):
    """Paragraphs put together to sections: a new one begins where the heading changes."""
    x = t("texts").where("text is not null").select("text_id", "id", "para_no", "section_head").distinct()
    w = Window.partitionBy("id").orderBy("para_no", "text_id")
    new = F.when(F.col("section_head").eqNullSafe(F.lag("section_head").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    k = x.withColumn("st", new).withColumn("section", F.sum("st").over(w))
    return k.where("id is not null").groupBy("id", "section").agg(F.min("text_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {TEXTS}, {SPANS} SELECT span_id, {_sig('raw_form')} AS simple, trim(regexp_replace(replace(raw_form, chr(10), ' '), ' +', ' ', 'g')) AS component, regexp_replace(raw_form, '[^\\x{{9}}\\x{{A}}\\x{{D}}\\x{{20}}-\\x{{D7FF}}\\x{{E000}}-\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]', '', 'g') AS xml, array_to_string(list_transform(regexp_extract_all(raw_form, '{PATTERN}'), lambda x: x), '|') AS tokens, coalesce(lower(CAST(used AS VARCHAR)) IN ('1', 'true'), false) AS used, printf('%.1f', CAST(round(cert * 10) AS DOUBLE) / 10) AS certainty FROM s WHERE raw_form IS NOT NULL")
def field_values(t):
    s, c = _spans(t).where("raw_form is not null"), F.col("raw_form")
    tokens = F.array_join(values.retokenized(F.array(c)), "|")
    return s.select("span_id", normalize.signature(c).alias("simple"), values.component_form(c).alias("component"), values.valid_xml(c).alias("xml"), tokens.alias("tokens"), values.is_true(F.col("used").cast("string")).alias("used"), values.scaled_certainty(F.round(F.col("cert") * 10)).alias("certainty"))


@query(f"WITH {SPANS}, g AS (SELECT ltrim(corresp, '#') AS id, bool_or(entity_type = 'version') AS v, bool_or(entity_type = 'publisher') AS p, bool_or(entity_type = 'url') AS u FROM s WHERE corresp IS NOT NULL GROUP BY 1) SELECT span_id, CAST((raw_form IS NOT NULL)::INT + coalesce(p, false)::INT + coalesce(v, false)::INT + coalesce(u, false)::INT AS BIGINT) AS arity FROM s LEFT JOIN g ON g.id = s.span_id WHERE entity_type = 'software'")
def annotation_arity(t):
    s = _spans(t)
    has = lambda k: F.when(F.bool_or(F.col("entity_type") == k), 1)
    g = s.where("corresp is not null").groupBy(F.ltrim(F.col("corresp"), F.lit("#")).alias("span_id")).agg(has("version").alias("v"), has("publisher").alias("p"), has("url").alias("u"))
    m = s.where("entity_type = 'software'").select("span_id", "raw_form").join(g, "span_id", "left")
    return m.select("span_id", values.arity(F.col("raw_form"), F.col("p"), F.col("v"), F.lit(None), F.col("u")).alias("arity"))


@query("SELECT software_id, CASE WHEN starts_with(h, 'https://') OR port = '443' THEN 'https://' ELSE 'http://' END || regexp_replace(h, '^https?://', '') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || CASE WHEN contains(regexp_replace(h, '^https?://', ''), '/') THEN '' ELSE '/nerd' END AS url FROM (SELECT software_id, home_url AS h, ['', '80', '443', '8090'][software_id % 4 + 1] AS port FROM software_names WHERE home_url IS NOT NULL)")
def concept_urls(t):
    port = F.element_at(F.array(*map(F.lit, ("", "80", "443", "8090"))), (F.col("software_id") % 4 + 1).cast("int"))
    return t("software_names").where("home_url is not null").select("software_id", values.concept_url(F.col("home_url"), port).alias("url"))
