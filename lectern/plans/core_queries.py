"""Queries of the engine's own operators over the test tables, each with its SQL.

Bindings: texts are the segments of a document (its corpus key), software_names the dictionary, entity_spans the annotated spans,
usage_labels the annotators' verdicts, use_corrections the curator's list, id_map the map of keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import features, normalize
from lectern.functions.tokens import D, PATTERN, token_table, tokenize
from lectern.operators import corpus, entities, evaluate, match, spans
from lectern.session import cut_table, table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so that results compare by value."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _wide(f(lambda name: table(spark, sf_dir, name)))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _texts(t) -> DataFrame:
    return t("texts").where("text is not null").select("text_id", "id", "para_no", "text", "lang").distinct()


def _spans(t) -> DataFrame:
    return t("entity_spans").distinct()


TEXTS = "t AS (SELECT DISTINCT text_id, id, para_no, text, lang FROM texts WHERE text IS NOT NULL)"
TOKENS = f"tk AS (SELECT text_id, id, regexp_extract_all(text, '{PATTERN}') AS tokens FROM t), tp AS (SELECT text_id, id, tokens, unnest(generate_series(1, len(tokens))) AS i FROM tk)"
LEX = f"lex AS (SELECT term, words, words[1] AS first, len(words) AS n FROM (SELECT DISTINCT soft_name AS term, regexp_extract_all(soft_name, '{PATTERN}') AS words FROM software_names WHERE soft_name <> ''))"
HITS = """hits AS (SELECT text_id, id, term, i - 1 AS pos, n, CAST(length(array_to_string(tokens[1:i-1], '')) AS BIGINT) AS start FROM tp JOIN lex ON tokens[i] = first AND tokens[i:i+n-1] = words)"""
BASE = f"WITH {TEXTS}, {TOKENS}, {LEX}, {HITS}"
SPANS = "s AS (SELECT DISTINCT * FROM entity_spans)"
ANNOTATORS = [f"annotator{i}" for i in range(24)] + ["curator"]  # the rows of the fixed table


# tokens and features


@query(f"WITH {TEXTS}, {TOKENS} SELECT text_id, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_filter(tokens, lambda x: x <> ' ')) AS BIGINT) AS n_words, len(tokens) > 512 AS is_long FROM tk")
def token_counts(t):
    tok = tokenize(F.col("text"))
    return _texts(t).select("text_id", tok.alias("k")).select("text_id", F.size("k").alias("n_tokens"), F.size(F.filter("k", lambda x: x != " ")).alias("n_words"), (F.size("k") > 512).alias("is_long"))


@query(f"WITH {TEXTS}, {TOKENS}, o AS (SELECT text_id, i - 1 AS pos, tokens[i] AS token FROM tp) SELECT text_id, pos, token, CAST(sum(length(token)) OVER w - length(token) AS BIGINT) AS start, CAST(sum(length(token)) OVER w AS BIGINT) AS \"end\" FROM o WINDOW w AS (PARTITION BY text_id ORDER BY pos)")
def token_offsets(t):
    return token_table(_texts(t), keep=("text_id",))


def _runs_once(c: str) -> str:
    for x in "Xxd":
        c = f"regexp_replace({c}, '{x}+', '{x}', 'g')"
    return c


SHAPE = r"regexp_replace(regexp_replace(regexp_replace(t, '\p{Lu}', 'X', 'g'), '\p{Ll}', 'x', 'g'), '\p{Nd}', 'd', 'g')"


@query(rf"""WITH {TEXTS}, {TOKENS}, d AS (SELECT DISTINCT tokens[i] AS t FROM tp WHERE NOT regexp_full_match(tokens[i], '[\s\x{{85}}\p{{Z}}]+'))
SELECT t AS token, lower(t) AS lower, {", ".join(f"left(t, {i}) AS prefix{i}" for i in range(1, 6))}, {", ".join(f"right(t, {i}) AS suffix{i}" for i in range(1, 6))},
CASE WHEN regexp_matches(t, '\p{{Lu}}') AND NOT regexp_matches(t, '[^\p{{Lu}}\p{{M}}\p{{Nd}}]') THEN 'ALLCAP' WHEN regexp_matches(t, '^\p{{Lu}}') THEN 'INITCAP' ELSE 'NOCAPS' END AS caps,
CASE WHEN regexp_full_match(t, '\p{{Nd}}+') THEN 'ALLDIGIT' WHEN regexp_matches(t, '\p{{Nd}}') THEN 'CONTAINDIGIT' ELSE 'NODIGIT' END AS digits, length(t) = 1 AS single,
CASE WHEN t IN ('(', '[', '（') THEN 'OPENBRACKET' WHEN t IN (')', ']', '）') THEN 'ENDBRACKET' WHEN t = '.' THEN 'DOT' WHEN t = ',' THEN 'COMMA' WHEN t = '-' THEN 'HYPHEN' WHEN t IN ('"', '''', '`', '“', '”', '„', '‘', '’', '«', '»') THEN 'QUOTE' WHEN regexp_full_match(t, '[^\p{{L}}\p{{M}}\p{{N}}]+') THEN 'PUNCT' ELSE 'NOPUNCT' END AS punct,
regexp_replace(t, '\p{{Nd}}', '0', 'g') AS shadow, {SHAPE} AS shape, {_runs_once(SHAPE)} AS trimmed_shape FROM d""")
def token_features(t):
    """Of all tokens but white space, in any script."""
    d = _texts(t).select(F.explode_outer(tokenize(F.col("text"))).alias("t")).where("t is not null").where(~F.col("t").rlike(r"^[\s\x{85}\p{Z}]+$")).distinct()
    return d.select(*features.feature_row(F.col("t")))


@query(f"WITH {TEXTS}, {TOKENS}, o AS (SELECT text_id, i - 1 AS pos, tokens[i] AS token FROM tp) SELECT text_id, pos, token, " + ", ".join(f"lag(token, {k}) OVER w AS m{k}, lead(token, {k}) OVER w AS p{k}" for k in range(1, 5)) + ", concat_ws('|', lag(token) OVER w, token) AS bigram_left, concat_ws('|', token, lead(token) OVER w) AS bigram_right FROM o WINDOW w AS (PARTITION BY text_id ORDER BY pos)")
def context_window_features(t):
    tokens = _texts(t).select("text_id", F.posexplode_outer(tokenize(F.col("text"))).alias("pos", "token")).where("pos is not null")
    return features.context_window(tokens, ["text_id"])


# normalisation


def _forms(t, kind: str) -> DataFrame:
    return t("entity_spans").where(F.col("entity_type") == kind).select("raw_form").distinct()


def _sql_blanks(c: str, breaks: str = r"\n") -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '[{breaks}\\x{{85}}\\p{{Z}}]', ' ', 'g'), ' +', ' ', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


RAW = "r AS (SELECT DISTINCT raw_form FROM entity_spans WHERE entity_type = '{}')"
MARKS = normalize.FIELD_MARKS.replace("'", "''")
ADDRESSES = "[" + ", ".join("'" + a.replace("'", "''") + "'" for a in normalize.ADDRESSES) + "]"


def _golden(name: str, cases: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS field, '{k}' AS input, '{v}' AS expected" for k, v in cases.items())


@query(f"WITH {RAW.format('version')}, a AS (SELECT raw_form, regexp_replace(trim({_sql_blanks('raw_form')}, '()[]'), '{normalize.VERSION_HEAD}', '') AS x FROM r) SELECT raw_form, {_sql_blanks(f"trim(regexp_replace(x, '{normalize.VERSION_TAIL}', ''), '.')")} AS normalized FROM a")
def normalize_version(t):
    return _forms(t, "version").select("raw_form", normalize.version(F.col("raw_form")).alias("normalized"))


@query(f"WITH {RAW.format('publisher')}, a AS (SELECT raw_form, trim({_sql_blanks('raw_form', '\\n\\t')}, '{MARKS}') AS x FROM r), b AS (SELECT raw_form, x, regexp_extract(x, '{normalize.COMPANY}', 1) AS h FROM a) SELECT raw_form, trim(list_reduce(list_prepend(CASE WHEN h <> '' THEN h ELSE x END, {ADDRESSES}), lambda c, a: CASE WHEN ends_with(c, a) THEN replace(c, a, '') ELSE c END)) AS normalized FROM b")
def normalize_creator(t):
    return _forms(t, "publisher").select("raw_form", normalize.creator(F.col("raw_form")).alias("normalized"))


@query(f"WITH {RAW.format('url')}, a AS (SELECT raw_form, trim({_sql_blanks('raw_form')}, '{MARKS}') AS x FROM r), b AS (SELECT raw_form, x, regexp_extract(x, '{normalize.URL}', 1) AS f FROM a) SELECT raw_form, CASE WHEN f <> '' THEN replace(f, ' ', '') ELSE x END AS normalized FROM b")
def normalize_url(t):
    return _forms(t, "url").select("raw_form", normalize.url(F.col("raw_form")).alias("normalized"))


@query(f"""WITH {RAW.format('software')} SELECT raw_form, {_sql_blanks(f"trim({_sql_blanks('raw_form')}, '{MARKS}')")} AS normalized, lower(regexp_replace(coalesce(raw_form, ''), '[^a-zA-Z0-9]', '', 'g')) AS simple, lower(regexp_replace(coalesce(raw_form, ''), '[^a-zA-Z]', '', 'g')) AS letters, regexp_replace(raw_form, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g') AS words, substr(sha256(raw_form), 1, 10) AS key FROM r""")
def normalize_name(t):
    c = F.col("raw_form")
    return _forms(t, "software").select("raw_form", normalize.software_name(c).alias("normalized"), normalize.simplified(c).alias("simple"), normalize.simplified_letters(c).alias("letters"), normalize.split_camel(c).alias("words"), normalize.stable_key(c).alias("key"))


# fixed values: expected forms of the published test cases
GOLDEN = {
    "version": {"version 1.1": "1.1", "Version 5.0    ": "5.0", "1.31 version": "1.31", "v.9.3": "9.3", "v0.9.6": "0.9.6", "ver.12.0": "12.0", "ver.13 ": "13", "release  1.31": "1.31"},
    "url": {
        "(code available at http:// goddardlab.auckland.ac.nz/data-and-code/)": "http://goddardlab.auckland.ac.nz/data-and-code/",
        "(http://www.superarray.com/ pcr/arrayanalysis.php),": "http://www.superarray.com/pcr/arrayanalysis.php",
        "http:// biomoby.open-bio.org/CVS_CONTENT/moby-live/Java/docs/ Moses-generators.html": "http://biomoby.open-bio.org/CVS_CONTENT/moby-live/Java/docs/Moses-generators.html",
        "random.org": "random.org",
    },
    "creator": {"SPSS Inc., Chicago IL, USA": "SPSS Inc.", "(Bruker Corporation, Santa Barbara, CA, USA)": "Bruker Corporation", "IBM Corporation": "IBM Corporation", "STATA Corp LP. Package": "STATA Corp"},
}


@query(" UNION ALL ".join(_golden(k, v) for k, v in GOLDEN.items()))
def normalize_golden(t):
    """The published cases, normalised here; the SQL holds what is expected."""
    rows = [(k, x) for k, cases in GOLDEN.items() for x in cases]
    df = t("software_names").sparkSession.createDataFrame(rows, "field string, input string")
    c = F.col("input")
    form = F.when(F.col("field") == "version", normalize.version(c)).when(F.col("field") == "url", normalize.url(c)).otherwise(normalize.creator(c))
    return df.select("field", "input", form.alias("expected"))


@query(f"WITH {TEXTS}, g AS (SELECT regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS signature, count(*) AS n, min(text_id) AS first_id FROM t GROUP BY 1) SELECT md5(signature) AS signature, n, first_id FROM g WHERE n > 1")
def signature_copies(t):
    g = _texts(t).groupBy(F.md5(normalize.signature(F.col("text"))).alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min("text_id").alias("first_id"))
    return g.where("n > 1")


@query("SELECT id, doi, CASE WHEN doi LIKE '10.%' THEN 'doi' WHEN doi LIKE 'PMC%' THEN 'pmc' WHEN doi LIKE 'hal-%' THEN 'hal' WHEN lower(doi) LIKE 'arxiv%' THEN 'arxiv' ELSE 'unknown' END AS source, coalesce(CASE WHEN upper(doi) IN ('', 'NA', 'N/A', 'NONE', '-') THEN NULL ELSE doi END, CASE WHEN upper(pmid) IN ('', 'NA', 'N/A', 'NONE', '-') THEN NULL ELSE pmid END, CASE WHEN upper(pmcid) IN ('', 'NA', 'N/A', 'NONE', '-') THEN NULL ELSE pmcid END, substr(sha256(id), 1, 10)) AS lookup FROM (SELECT DISTINCT * FROM id_map)")
def id_lookup_chain(t):
    known = lambda c: F.when(~F.upper(c).isin("", "NA", "N/A", "NONE", "-"), F.col(c))
    m = t("id_map").distinct()
    return m.select("id", "doi", F.coalesce(normalize.source_guess(F.col("doi")), F.lit("unknown")).alias("source"), F.coalesce(known("doi"), known("pmid"), known("pmcid"), normalize.stable_key(F.col("id"))).alias("lookup"))


# dictionary, statistics, propagation


def _hits(t) -> DataFrame:
    return match.dictionary_hits(_texts(t), match.lexicon(t("software_names"), "soft_name"), ("text_id", "id"))


SENT = r"sp AS (SELECT text_id, regexp_extract_all(text, '[^.!?]*[.!?]+[ \n]*|[^.!?]+') AS p FROM t), sn AS (SELECT text_id, unnest(generate_series(1, len(p))) AS i, p FROM sp), se AS (SELECT text_id, length(array_to_string(p[1:i-1], '')) AS a, length(array_to_string(p[1:i], '')) AS b FROM sn)"


@query(f"{BASE}, tf AS (SELECT id, term, count(*) AS tf FROM hits GROUP BY ALL), {SENT} SELECT h.text_id, h.id, h.term, h.start, h.start + length(h.term) AS \"end\", tf, CAST(min(a) AS BIGINT) AS sentence_start, CAST(min(b) AS BIGINT) AS sentence_end FROM hits h JOIN tf USING (id, term) JOIN se ON se.text_id = h.text_id AND a <= h.start AND h.start + length(h.term) <= b GROUP BY ALL")
def dictionary_hits(t):
    hits = cut_table(_hits(t).select("text_id", "id", "term", "start", "end"))  # read for the places and for the counts
    units = spans.sentence_spans(_texts(t), ["text_id"])
    inside = spans.containing(hits, units, ["text_id"]).withColumnsRenamed({"unit_start": "sentence_start", "unit_end": "sentence_end"})
    return inside.join(match.term_frequency(hits, "id"), ["id", "term"])


@query(f"{BASE}, tf AS (SELECT id, term, count(*) AS tf FROM hits GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS n FROM t), df AS (SELECT term, count(DISTINCT id) AS df FROM tf GROUP BY 1) SELECT id, term, tf, df, round(ln(n / df), 6) AS idf, round(tf * ln(n / df), 6) AS tfidf FROM tf JOIN df USING (term), n")
def doc_term_tfidf(t):
    tf = cut_table(match.term_frequency(_hits(t), "id"))  # read for the counts and for the documents of each term
    n = _texts(t).select(F.countDistinct("id").alias("n_docs"))
    idf = match.inverse_frequency(tf, n, "id")
    return tf.join(idf, "term").select("id", "term", "tf", "df", F.round("idf", 6).alias("idf"), F.round(F.col("tf") * F.col("idf"), 6).alias("tfidf"))


@query(f"WITH {TEXTS}, {TOKENS}, w AS (SELECT text_id, tokens[i] AS token FROM tp WHERE regexp_full_match(tokens[i], '\\p{{L}}[\\p{{L}}\\p{{M}}]*')), n AS (SELECT token, count(DISTINCT text_id) AS df FROM w GROUP BY 1), stop AS (SELECT token FROM n WHERE lower(token) = token ORDER BY df DESC, token LIMIT 200) SELECT token, df FROM n WHERE NOT (CASE WHEN length(token) = 1 THEN lower(token) ELSE token END) IN (SELECT token FROM stop) AND token <> 'R'")
def stopword_filtered_terms(t):
    n = _texts(t).select("text_id", F.explode_outer(tokenize(F.col("text"))).alias("token")).where(F.col("token").rlike(r"^\p{L}[\p{L}\p{M}]*$")).groupBy("token").agg(F.countDistinct("text_id").alias("df"))
    stop = n.where(F.lower("token") == F.col("token")).orderBy(F.desc("df"), "token").limit(200).select(F.col("token").alias("k"))  # a top-k list is the feature
    k = F.when(F.length("token") == 1, F.lower("token")).otherwise(F.col("token"))
    return n.withColumn("k", k).join(F.broadcast(stop), "k", "left_anti").where("token <> 'R'").select("token", "df")


def _known_names(t) -> DataFrame:
    """id, term: the names annotated in each document, as they stand there and normalised."""
    s = _spans(t).where("entity_type = 'software'").join(_texts(t).select("text_id", "id"), "text_id")
    forms = F.array("raw_form", normalize.software_name(F.col("raw_form")))
    return s.select("id", F.explode(forms).alias("term")).where("term <> ''").distinct()


FOLD = """g AS (SELECT id, text_id, list_sort(list(DISTINCT {'a': a, 'e': -b, 'term': term})) AS l FROM free GROUP BY 1, 2),
f AS (SELECT id, text_id, list_reduce(list_prepend([{'a': -1, 'b': -1, 'term': ''}], list_transform(l, lambda x: [{'a': x.a, 'b': -x.e, 'term': x.term}])), lambda acc, x: CASE WHEN x[1].a >= acc[len(acc)].b THEN list_concat(acc, x) ELSE acc END) AS kept FROM g)"""


@query(f"""WITH {TEXTS}, {TOKENS}, n0 AS (SELECT t.id, raw_form FROM (SELECT DISTINCT * FROM entity_spans) e JOIN t USING (text_id) WHERE entity_type = 'software'), known AS (SELECT DISTINCT id, raw_form AS term FROM n0 WHERE raw_form <> '' UNION SELECT DISTINCT id, {_sql_blanks(f"trim({_sql_blanks('raw_form')}, '{MARKS}')")} AS term FROM n0 WHERE {_sql_blanks(f"trim({_sql_blanks('raw_form')}, '{MARKS}')")} <> ''),
lex AS (SELECT term, words, words[1] AS first, len(words) AS n FROM (SELECT DISTINCT term, regexp_extract_all(term, '{PATTERN}') AS words FROM known)), {HITS}, df AS (SELECT term, count(DISTINCT id) AS df FROM hits GROUP BY 1), nd AS (SELECT count(DISTINCT id) AS n FROM t),
own AS (SELECT h.* FROM hits h JOIN known USING (id, term)), tf AS (SELECT id, term, count(*) AS tf FROM own GROUP BY 1, 2), busy AS (SELECT DISTINCT text_id, start_pos, end_pos FROM entity_spans WHERE entity_type = 'software'),
free AS (SELECT h.id, h.text_id, h.term, h.start AS a, h.start + length(h.term) AS b FROM own h JOIN tf USING (id, term) JOIN df USING (term), nd WHERE (tf * ln(nd.n / df) <= 0 OR tf * ln(nd.n / df) > 0.001) AND (length(h.term) > 1 OR h.term = 'R') AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.text_id = h.text_id AND h.start < b.end_pos AND b.start_pos < h.start + length(h.term))),
{FOLD} SELECT id, text_id, CAST(u.a AS BIGINT) AS start, CAST(u.b AS BIGINT) AS "end", u.term AS term FROM (SELECT id, text_id, unnest(kept) AS u FROM f) WHERE u.a >= 0""")
def propagated_hits(t):
    """All names annotated in a document, and their normal forms, over the whole document; gated by tf x idf."""
    texts, known = _texts(t), _known_names(t)
    hits = cut_table(match.dictionary_hits(texts, match.lexicon(known, "term"), ("id", "text_id")).select("id", "text_id", "term", F.col("start").cast("int"), F.col("end").cast("int")))
    idf = match.inverse_frequency(match.term_frequency(hits, "id"), texts.select(F.countDistinct("id").alias("n_docs")), "id")
    taken = _spans(t).where("entity_type = 'software'").select("text_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).distinct()
    return match.propagate(hits, known, taken, "id", "text_id", idf)


@query(f"""{BASE}, s AS (SELECT text_id, term, CAST(start AS INT) AS a, CAST(start + length(term) AS INT) AS b FROM hits), g AS (SELECT text_id, list_sort(list({{'a': a, 'e': -b, 'term': term}})) AS l FROM s GROUP BY 1),
f AS (SELECT text_id, list_reduce(list_prepend([{{'a': -1, 'b': -1, 'term': ''}}], list_transform(l, lambda x: [{{'a': x.a, 'b': -x.e, 'term': x.term}}])), lambda acc, x: CASE WHEN x[1].a >= acc[len(acc)].b THEN list_concat(acc, x) ELSE acc END) AS kept FROM g)
SELECT text_id, CAST(u.a AS BIGINT) AS start, CAST(u.b AS BIGINT) AS "end", u.term AS term FROM (SELECT text_id, unnest(kept) AS u FROM f) WHERE u.a >= 0""")
def nonoverlap_hits(t):
    return match.non_overlapping(_hits(t).select("text_id", "term", F.col("start").cast("int"), F.col("end").cast("int")), ["text_id"], extra=("term",))


# spans and entities

CHUNK = f"{SPANS}, c AS (SELECT text_id, span_id, CASE WHEN entity_type = 'software' THEN 'name' ELSE entity_type END AS role, start_pos AS a, end_pos AS b FROM s)"


@query(f"""WITH {CHUNK}, n AS (SELECT *, last_value(CASE WHEN role = 'name' THEN {{'id': span_id, 'a': a, 'b': b}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, first_value(CASE WHEN role = 'name' THEN {{'id': span_id, 'a': a, 'b': b}} END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM c WINDOW w AS (PARTITION BY text_id ORDER BY a, b, span_id)),
d AS (SELECT text_id, span_id, role, a, CASE WHEN prev IS NOT NULL AND (next IS NULL OR a - prev.b <= 2 * (next.a - b)) THEN prev.id ELSE next.id END AS name_id, CASE WHEN prev IS NOT NULL AND (next IS NULL OR a - prev.b <= 2 * (next.a - b)) THEN a - prev.b ELSE next.a - b END AS distance FROM n WHERE role <> 'name')
SELECT text_id, span_id AS id, role, name_id, CAST(distance AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY text_id, name_id, role ORDER BY distance, a, span_id) AS rn FROM d WHERE name_id IS NOT NULL) WHERE rn = 1""")
def attribute_grouping(t):
    c = _spans(t).select("text_id", F.col("span_id").alias("id"), F.when(F.col("entity_type") == "software", "name").otherwise(F.col("entity_type")).alias("role"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    return spans.attach_nearest(c, ["text_id"])


@query(f"""WITH {SPANS}, e AS (SELECT text_id, span_id, end_pos FROM s WHERE entity_type = 'software'), k AS (SELECT text_id, start_pos AS a, end_pos AS b, span_id AS ref FROM s WHERE entity_type <> 'software'),
g AS (SELECT e.text_id, e.span_id, e.end_pos, list_sort(list(DISTINCT {{'a': a, 'b': b, 'r': ref}})) AS l FROM e JOIN k ON e.text_id = k.text_id AND a >= end_pos GROUP BY ALL),
f AS (SELECT text_id, span_id, list_reduce(list_prepend([{{'a': -1, 'b': end_pos, 'r': ''}}], list_transform(l, lambda x: [x])), lambda acc, x: CASE WHEN x[1].a <= acc[len(acc)].b + 5 THEN list_concat(acc, x) ELSE acc END) AS kept FROM g)
SELECT text_id, span_id AS id, u.r AS ref FROM (SELECT text_id, span_id, unnest(kept) AS u FROM f) WHERE u.r <> ''""")
def callout_attach(t):
    s = _spans(t)
    names = s.where("entity_type = 'software'").select("text_id", F.col("span_id").alias("id"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    refs = s.where("entity_type <> 'software'").select("text_id", F.col("span_id").alias("ref"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    return spans.attach_callouts(names, refs, ["text_id"])


@query(f"WITH {TEXTS}, {SPANS}, {SENT} SELECT s.span_id, CAST(min(a) AS BIGINT) AS unit_start, CAST(min(b) AS BIGINT) AS unit_end, CAST(start_pos - min(a) AS BIGINT) AS rebased FROM s JOIN se ON s.text_id = se.text_id AND a <= start_pos AND end_pos <= b GROUP BY span_id, start_pos")
def sentence_context(t):
    s = _spans(t).select("text_id", "span_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    j = spans.containing(s, spans.sentence_spans(_texts(t), ["text_id"]), ["text_id"])
    return j.select("span_id", "unit_start", "unit_end", (F.col("start") - F.col("unit_start")).alias("rebased"))


@query(f"WITH {SPANS}, z AS (SELECT text_id, start_pos AS z0, end_pos + 20 AS z1 FROM s WHERE entity_type = 'url') SELECT span_id, EXISTS (SELECT 1 FROM z WHERE z.text_id = s.text_id AND start_pos < z1 AND z0 < end_pos) AS in_zone FROM s WHERE entity_type = 'software'")
def zone_flag(t):
    s = _spans(t)
    names = s.where("entity_type = 'software'").select("text_id", "span_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    zones = s.where("entity_type = 'url'").select("text_id", F.col("start_pos").alias("start"), (F.col("end_pos") + 20).alias("end"))
    return spans.in_zone(names, zones, ["text_id"]).select("span_id", "in_zone")


MENTIONS = f"{TEXTS}, {SPANS}, m AS (SELECT span_id, t.id AS doc, raw_form, lower(regexp_replace(coalesce(raw_form, ''), '[^a-zA-Z0-9]', '', 'g')) AS norm, used, cert FROM s JOIN t USING (text_id) WHERE entity_type = 'software')"


def _mentions(t) -> DataFrame:
    m = _spans(t).where("entity_type = 'software'").join(_texts(t).select("text_id", F.col("id").alias("doc")), "text_id")
    return m.select(F.col("span_id").alias("id"), "doc", "raw_form", normalize.simplified(F.col("raw_form")).alias("norm"), "used", F.col("cert").alias("used_score"))


@query(f"WITH {MENTIONS}, k AS (SELECT span_id, doc, used, cert, unnest(['r:' || raw_form, 'n:' || norm]) AS key FROM m), g AS (SELECT doc, key, bool_or(used) AS u, max(cert) AS c FROM k WHERE key IS NOT NULL GROUP BY ALL) SELECT span_id AS id, bool_or(u) AS doc_used, max(c) AS doc_used_score FROM k JOIN g USING (doc, key) GROUP BY 1")
def doc_context_attributes(t):
    return entities.document_attributes(_mentions(t), "doc", ["raw_form", "norm"], ["used"])


@query(f"WITH {MENTIONS} SELECT span_id AS id, doc, norm, coalesce(used, first_value(used IGNORE NULLS) OVER w) AS used, coalesce(cert, first_value(cert IGNORE NULLS) OVER w) AS used_score FROM m WINDOW w AS (PARTITION BY doc, norm ORDER BY span_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def merge_attributes(t):
    return entities.copy_first(_mentions(t), ["doc", "norm"], ["used", "used_score"], ["id"]).select("id", "doc", "norm", "used", "used_score")


@query("SELECT span_id AS id, cert > 0.5 AND cert > 0.4 AS value, CASE WHEN cert > 0.4 THEN cert ELSE CAST(0.6 AS DOUBLE) END AS score FROM (SELECT DISTINCT * FROM entity_spans) WHERE cert IS NOT NULL")
def binary_scores(t):
    value, score = entities.binary_class(F.col("cert"), F.lit(0.4).cast("double"))
    return _spans(t).where("cert is not null").select(F.col("span_id").alias("id"), value.alias("value"), score.alias("score"))


@query("""WITH k(id, props) AS (VALUES (1, MAP {'P31': ['Q1'], 'P348': ['x']}), (2, MAP {'P31': ['Q7397']}), (3, MAP {'P856': ['https://github.com/a']}), (4, MAP {'P856': ['https://a.example']}), (5, MAP {'P1056': ['Q7397']}), (6, MAP {}))
SELECT id, CASE WHEN list_has_any(coalesce(props['P31'], []), ['Q7397']) OR list_has_any(coalesce(props['P279'], []), ['Q7397']) OR map_contains(props, 'P348') OR len(list_filter(coalesce(props['P856'], []), lambda u: u LIKE '%github%' OR u LIKE '%apache%' OR u LIKE '%stanford.edu%')) > 0 OR list_has_any(coalesce(props['P1056'], []), ['Q7397']) OR cardinality(props) = 0 THEN true ELSE false END AS keep FROM k""")
def kb_keep_rule(t):
    rows = [(1, {"P31": ["Q1"], "P348": ["x"]}), (2, {"P31": ["Q7397"]}), (3, {"P856": ["https://github.com/a"]}), (4, {"P856": ["https://a.example"]}), (5, {"P1056": ["Q7397"]}), (6, {})]
    df = t("software_names").sparkSession.createDataFrame(rows, "id int, props map<string, array<string>>")
    return df.select("id", entities.kb_keep(F.col("props"), F.array(F.lit("Q7397"))).alias("keep"))


@query(f"WITH {TEXTS}, {SPANS}, h AS (SELECT DISTINCT t.id AS doc, raw_form AS name FROM s JOIN t USING (text_id) WHERE raw_form LIKE '%-%') SELECT DISTINCT a.doc, a.name FROM h a JOIN h b ON a.doc = b.doc AND a.name <> b.name AND contains(b.name, a.name) WHERE a.name LIKE '%-'")
def hyphen_fragments(t):
    m = _spans(t).join(_texts(t).select("text_id", F.col("id").alias("doc")), "text_id")
    return entities.hyphen_fragments(m, "doc", "raw_form")


# corpus


@query(f"WITH {TEXTS}, {SPANS} SELECT entity_type, raw_form, t.id AS doc, count(*) AS n, any_value({_sql_blanks(f"trim({_sql_blanks('raw_form')}, '{MARKS}')")}) AS normalized FROM s JOIN t USING (text_id) GROUP BY 1, 2, 3")
def mention_docs(t):
    """The documents of every value of every field, one a row, and the value's normal form."""
    m = _spans(t).join(_texts(t).select("text_id", F.col("id").alias("doc")), "text_id")
    return m.groupBy("entity_type", "raw_form", "doc").agg(F.count(F.lit(1)).alias("n")).withColumn("normalized", normalize.software_name(F.col("raw_form")))


@query("SELECT coalesce(lang, '-') AS article_set, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1")
def docs_per_set(t):
    return t("documents").groupBy(F.coalesce("lang", F.lit("-")).alias("article_set")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query(f"WITH {TEXTS}, {SPANS}, j AS (SELECT entity_type, substr(text, start_pos + 1, end_pos - start_pos) = raw_form AS exact, contains(lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')), lower(regexp_replace(raw_form, '[^a-zA-Z0-9]', '', 'g'))) AS present FROM s JOIN t USING (text_id) WHERE raw_form IS NOT NULL) SELECT coalesce(entity_type, 'all') AS field, count(*) AS total, CAST(sum(CASE WHEN exact THEN 0 ELSE 1 END) AS BIGINT) AS misplaced, CAST(sum(CASE WHEN present THEN 0 ELSE 1 END) AS BIGINT) AS unmatched, round(100.0 * sum(CASE WHEN present THEN 0 ELSE 1 END) / count(*), 4) AS percent FROM j GROUP BY ROLLUP (entity_type)")
def unmatched_rates(t):
    j = _spans(t).where("raw_form is not null").join(_texts(t).select("text_id", "text"), "text_id")
    exact = F.expr("substring(text, start_pos + 1, end_pos - start_pos) = raw_form")
    present = normalize.simplified(F.col("text")).contains(normalize.simplified(F.col("raw_form")))
    g = j.select("entity_type", (~exact).cast("int").alias("x"), (~present).cast("int").alias("u")).rollup("entity_type").agg(F.count(F.lit(1)).alias("total"), F.sum("x").alias("misplaced"), F.sum("u").alias("unmatched"))
    return g.select(F.coalesce("entity_type", F.lit("all")).alias("field"), "total", "misplaced", "unmatched", F.round(100.0 * F.col("unmatched") / F.col("total"), 4).alias("percent"))


VOTES = "v AS (SELECT DISTINCT span_id AS item, lower(replace(replace(trim(resp), '#', ''), ' ', '')) AS who, CASE WHEN lower(trim(used)) IN ('true', '1', 'yes', 't') THEN 'yes' WHEN lower(trim(used)) IN ('false', '0', 'no', 'f') THEN 'no' END AS value FROM usage_labels)"


def _votes(t) -> DataFrame:
    u = F.lower(F.trim("used"))
    value = F.when(u.isin("true", "1", "yes", "t"), "yes").when(u.isin("false", "0", "no", "f"), "no")
    who = F.lower(F.replace(F.replace(F.trim("resp"), F.lit("#"), F.lit("")), F.lit(" "), F.lit("")))
    return t("usage_labels").select(F.col("span_id").alias("item"), who.alias("who"), value.alias("value")).distinct()


def _per_document(t) -> DataFrame:
    """doc, who, n: verdicts of each annotator on each document."""
    at = _spans(t).select(F.col("span_id").alias("item"), "text_id").distinct().join(_texts(t).select("text_id", F.col("id").alias("doc")), "text_id")
    return _votes(t).join(at, "item").groupBy("doc", "who").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VOTES}, p AS (SELECT 'used' AS field, CASE WHEN a.value = b.value THEN 1 ELSE 0 END AS same FROM v a JOIN v b ON a.item = b.item AND a.who < b.who WHERE a.value IS NOT NULL AND b.value IS NOT NULL), g AS (SELECT field, sum(same) AS k, count(*) AS n FROM p GROUP BY 1) SELECT field, CAST(k AS BIGINT) AS agreements, n AS samples, round(k / n, 9) AS rate, round(sqrt(k / n * (1 - k / n)) / n, 9) AS std_error_ref, round(sqrt(k / n * (1 - k / n)) / sqrt(n), 9) AS std_error, round(k / n - 1.96 * sqrt(k / n * (1 - k / n)) / sqrt(n), 9) AS low, round(k / n + 1.96 * sqrt(k / n * (1 - k / n)) / sqrt(n), 9) AS high FROM g")
def annotator_agreement(t):
    a = corpus.agreement(_votes(t).where("value is not null").withColumn("field", F.lit("used")), "item", "who", "field", "value")
    return a.select("field", "agreements", "samples", *[F.round(c, 9).alias(c) for c in ("rate", "std_error_ref", "std_error", "low", "high")])


@query(f"WITH {TEXTS}, {VOTES}, d AS (SELECT t.id AS doc, who, count(*) AS n FROM v JOIN (SELECT DISTINCT span_id, text_id FROM entity_spans) e ON e.span_id = v.item JOIN t USING (text_id) GROUP BY ALL) SELECT doc, who, n FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, who) AS r FROM d) WHERE r = 1")
def most_productive(t):
    d = _per_document(t)
    best = d.groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("m"), "who", "n")).alias("b"))
    return best.select("doc", "b.who", "b.n")


@query(f"WITH {TEXTS}, {VOTES}, d AS (SELECT t.id AS doc, who, count(*) AS n FROM v JOIN (SELECT DISTINCT span_id, text_id FROM entity_spans) e ON e.span_id = v.item JOIN t USING (text_id) GROUP BY ALL) SELECT CAST(sum(m) AS BIGINT) AS largest_run FROM (SELECT doc, max(n) AS m FROM d GROUP BY 1)")
def largest_run(t):
    return corpus.largest_run(_per_document(t), "doc", "n")


@query("SELECT span_id, " + ", ".join(f"max_by(used, {{'a': labelled_at, 'b': label_id}}) FILTER (WHERE used IS NOT NULL AND lower(replace(replace(resp, '#', ''), ' ', '')) = '{name}') AS \"{name}\"" for name in ANNOTATORS) + " FROM usage_labels GROUP BY 1")
def pivot_codes(t):
    """The last given code of every annotator of the fixed annotators table."""
    name = lambda c: F.lower(F.replace(F.replace(c, F.lit("#"), F.lit("")), F.lit(" "), F.lit("")))
    names = sorted(r[0] for r in t("annotators").where("resp is not null").select(name("resp")).distinct().collect())  # 25 rows
    rows = t("usage_labels").withColumn("who", F.when(F.col("used").isNotNull(), name("resp")))
    return corpus.pivot_last(rows, "span_id", "who", "used", ["labelled_at", "label_id"], names)


@query("SELECT lower(raw_form) AS text, array_to_string(list_sort(list(DISTINCT entity_type)), ',') AS types, count(*) AS n FROM (SELECT DISTINCT * FROM entity_spans) WHERE raw_form IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity_type) > 1")
def ambiguous_terms(t):
    """Raw forms, of any characters, that are annotated as several types."""
    g = _spans(t).where("raw_form is not null").groupBy(F.lower("raw_form").alias("text")).agg(F.collect_set("entity_type").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.where("size(s) > 1").select("text", F.array_join(F.array_sort("s"), ",").alias("types"), "n")


@query(f"WITH {TEXTS}, {SPANS}, c AS (SELECT t.id, count(*) AS n FROM s JOIN t USING (text_id) GROUP BY 1), b AS (SELECT n, count(*) AS m FROM c GROUP BY 1), u AS (SELECT n, sum(m) OVER (ORDER BY n) / sum(m) OVER () AS upto FROM b) SELECT c.id, c.n, CAST(least(floor(upto * 5), 4) AS BIGINT) AS band, CAST('0x' || substr(md5(c.id), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 AS held_out FROM c JOIN u USING (n)")
def holdout_split(t):
    c = _spans(t).join(_texts(t).select("text_id", "id"), "text_id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return corpus.stratified_holdout(c, "id", "n")


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.25")
def hashed_sample(t):
    return t("documents").where(corpus.hash_unit(F.col("doc_id")) < 0.25).select("doc_id")


@query("SELECT text_id, s FROM (SELECT text_id, CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS BIGINT) AS s FROM (SELECT DISTINCT text_id, text FROM texts WHERE text IS NOT NULL)) ORDER BY s DESC, text_id LIMIT 500")
def active_selection(t):
    s = _texts(t).select("text_id", (F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))).alias("s"))
    return corpus.select_negatives(s, "text_id", "s", 500)


@query("WITH u AS (SELECT DISTINCT id, resp, used FROM use_corrections), f AS (SELECT id, max(upper(used)) AS fixed FROM u GROUP BY 1), s AS (SELECT DISTINCT span_id, used FROM entity_spans WHERE entity_type = 'software') SELECT s.span_id AS id, CASE WHEN fixed IS NULL THEN 'kept' ELSE 'corrected' END AS state, coalesce(fixed, upper(CAST(s.used AS VARCHAR))) AS used FROM s LEFT JOIN f ON f.id = s.span_id UNION ALL SELECT f.id, 'unused', fixed FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.span_id = f.id)")
def usage_corrections(t):
    fixes = t("use_corrections").groupBy(F.col("id").alias("span_id")).agg(F.max(F.upper("used")).alias("fixed"))
    s = _spans(t).where("entity_type = 'software'").select("span_id", "used").distinct()
    done, unused = corpus.corrections(s, fixes, "span_id")
    done = done.select(F.col("span_id").alias("id"), F.when(F.col("fixed").isNull(), "kept").otherwise("corrected").alias("state"), F.coalesce("fixed", F.upper(F.col("used").cast("string"))).alias("used"))
    return done.unionByName(unused.select(F.col("span_id").alias("id"), F.lit("unused").alias("state"), F.col("fixed").alias("used")))


@query(f"WITH {TEXTS}, g AS (SELECT text_id, id, lang, md5(lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g'))) AS sig FROM t), tr AS (SELECT DISTINCT id FROM id_map WHERE split = 'train') SELECT text_id, sig FROM g WHERE NOT id IN (SELECT id FROM tr) AND NOT EXISTS (SELECT 1 FROM g b WHERE b.sig = g.sig AND b.id IN (SELECT id FROM tr))")
def novel_paragraphs(t):
    g = _texts(t).select("text_id", "id", F.md5(normalize.simplified(F.col("text"))).alias("sig"))
    train = t("id_map").where("split = 'train'").select("id").distinct()
    return corpus.novel(g.join(train, "id", "left_anti"), g.join(train, "id", "left_semi"), ["sig"]).select("text_id", "sig")


@query(f"WITH {TEXTS}, w AS (SELECT text_id, id, para_no, lag(text, 1) OVER w AS p1, lag(text, 2) OVER w AS p2, lead(text, 1) OVER w AS n1, lead(text, 2) OVER w AS n2 FROM t WINDOW w AS (PARTITION BY id ORDER BY para_no)) SELECT text_id, md5(p1) AS prev1, CASE WHEN len(regexp_extract_all(trim(p1), '\\s+')) + 1 < 100 THEN md5(p2) END AS prev2, md5(n1) AS next1, CASE WHEN len(regexp_extract_all(trim(n1), '\\s+')) + 1 < 100 THEN md5(n2) END AS next2 FROM w")
def neighbour_context(t):
    n = corpus.neighbours(_texts(t), "id", "para_no", "text")
    return n.select("text_id", *[F.md5(c).alias(c) for c in ("prev1", "prev2", "next1", "next2")])


LABELLED = f"{TEXTS}, {TOKENS}, {LEX}, lb AS (SELECT text_id, i - 1 AS pos, CASE WHEN tokens[i] IN (SELECT unnest(words) FROM lex) AND length(tokens[i]) > 1 THEN '<software>' WHEN regexp_full_match(tokens[i], '[0-9]+') THEN '<version>' ELSE '<other>' END AS label FROM tp)"


def _labelled(t) -> DataFrame:
    words = match.lexicon(t("software_names"), "soft_name").select(F.explode("words").alias("token")).where("length(token) > 1").distinct().withColumn("known", F.lit(True))
    tok = _texts(t).select("text_id", F.posexplode_outer(tokenize(F.col("text"))).alias("pos", "token")).where("pos is not null")
    label = F.when(F.col("known"), "<software>").when(F.col("token").rlike("^[0-9]+$"), "<version>").otherwise("<other>")
    return tok.join(match.small(words), "token", "left").select("text_id", "pos", label.alias("label"))


@query(f"WITH {LABELLED}, a AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY text_id ORDER BY pos) THEN 1 ELSE 0 END AS st FROM lb), c AS (SELECT *, sum(st) OVER (PARTITION BY text_id ORDER BY pos) AS k FROM a) SELECT text_id, label, min(pos) AS first, max(pos) AS last FROM c WHERE label <> '<other>' GROUP BY text_id, k, label")
def iob_chunks(t):
    return evaluate.chunks(evaluate.begin_labels(_labelled(t), ["text_id"]), ["text_id"])


@query(f"{BASE}, f AS (SELECT DISTINCT text_id, start AS a, start + length(term) AS b, lang FROM hits JOIN t USING (text_id)), g AS (SELECT DISTINCT e.text_id, start_pos AS a, end_pos AS b, lang FROM entity_spans e JOIN t USING (text_id) WHERE entity_type = 'software'), j AS (SELECT coalesce(f.lang, g.lang, '-') AS lang, g.text_id AS g, f.text_id AS f FROM f FULL JOIN g ON f.text_id = g.text_id AND f.a = g.a AND f.b = g.b), s AS (SELECT lang, count(g) AS e, count(f) AS p, sum(CASE WHEN g IS NOT NULL AND f IS NOT NULL THEN 1 ELSE 0 END) AS c FROM j GROUP BY 1) SELECT lang, e AS expected, p AS predicted, CAST(c AS BIGINT) AS correct, round(c / nullif(p, 0), 6) AS precision, round(c / nullif(e, 0), 6) AS recall, CASE WHEN c > 0 THEN round(2 * c / (e + p), 6) END AS f1 FROM s")
def field_prf(t):
    lang = _texts(t).select("text_id", F.coalesce("lang", F.lit("-")).alias("lang"))
    gold = _spans(t).where("entity_type = 'software'").select("text_id", F.col("start_pos").cast("long").alias("a"), F.col("end_pos").cast("long").alias("b")).join(lang, "text_id")
    found = _hits(t).select("text_id", F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b")).join(lang, "text_id")
    r = evaluate.prf(gold, found, ["text_id", "a", "b", "lang"], "lang")
    return r.select("lang", "expected", "predicted", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("WITH a AS (SELECT DISTINCT soft_name AS name FROM software_names), b AS (SELECT DISTINCT raw_form AS name FROM entity_spans WHERE entity_type = 'software' AND raw_form IS NOT NULL) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def set_ops(t):
    a, b = t("software_names").select(F.col("soft_name").alias("name")).distinct(), _spans(t).where("entity_type = 'software' and raw_form is not null").select(F.col("raw_form").alias("name")).distinct()
    ops = {"union": a.union(b).distinct(), "except": b.subtract(a), "intersect": a.intersect(b), "union_all": a.unionAll(b)}
    out = None
    for name, df in ops.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionAll(row)
    return out


@query("SELECT doc_id, upper(md5(text)) AS md5, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def doc_md5(t):
    return t("documents").where("text is not null").select("doc_id", F.upper(F.md5("text")).alias("md5"), F.octet_length("text").alias("bytes"))


@query(f"WITH {TEXTS}, {SPANS} SELECT t.id, count(*) AS mentions, count(used) AS judged, CAST(sum(CASE WHEN entity_type = 'version' THEN 1 ELSE 0 END) AS BIGINT) AS versions, CAST(sum(CASE WHEN entity_type = 'publisher' THEN 1 ELSE 0 END) AS BIGINT) AS publishers, CAST(sum(CASE WHEN entity_type = 'url' THEN 1 ELSE 0 END) AS BIGINT) AS urls FROM s JOIN t USING (text_id) GROUP BY 1")
def linking_summary(t):
    m = _spans(t).join(_texts(t).select("text_id", "id"), "text_id")
    n = lambda k: F.sum((F.col("entity_type") == k).cast("int"))
    return m.groupBy("id").agg(F.count(F.lit(1)).alias("mentions"), F.count("used").alias("judged"), n("version").alias("versions"), n("publisher").alias("publishers"), n("url").alias("urls"))


@query(f"WITH {TEXTS}, {TOKENS} SELECT coalesce(lang, '-') AS lang, count(*) AS paragraphs, count(DISTINCT t.id) AS documents, CAST(sum(len(tokens)) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars FROM t JOIN tk USING (text_id) GROUP BY 1")
def corpus_statistics(t):
    x = _texts(t).select(F.coalesce("lang", F.lit("-")).alias("lang"), "id", F.size(tokenize(F.col("text"))).alias("k"), F.length("text").alias("c"))
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("paragraphs"), F.countDistinct("id").alias("documents"), F.sum("k").alias("tokens"), F.sum("c").alias("chars"))


@query(f"{BASE} SELECT h.text_id, h.term, h.start FROM hits h WHERE length(term) > 2 AND NOT EXISTS (SELECT 1 FROM entity_spans e WHERE e.text_id = h.text_id AND h.start < e.end_pos AND e.start_pos < h.start + length(h.term))")
def unannotated_occurrences(t):
    h = _hits(t).where("length(term) > 2").select("text_id", "term", "start", "end")
    e = _spans(t).select(F.col("text_id").alias("tid"), "start_pos", "end_pos")
    return h.join(e, (F.col("text_id") == F.col("tid")) & (F.col("start") < F.col("end_pos")) & (F.col("start_pos") < F.col("end")), "left_anti").select("text_id", "term", "start")
