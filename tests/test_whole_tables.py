"""Queries over all values, against expected values or a brute force, on small tables of odd ones."""

import json
import re
import unicodedata

import pytest

import lectern.plans.more_queries as core
from lectern.functions.tokens import PATTERN

FORMS = {
    "version": {"v.\u00a010.1.18": "10.1.18", "release\u202f1.8.9": "1.8.9", "１１.６": "１１.６", "（v2）": "（v2）", "Version 2.0": "2.0", "": "", None: None},
    "publisher": {"Ephronic\u00a0Ltd., Bonn": "Ephronic Ltd.", "Agência Norte": "Agência Norte", "Zürich AG, Genève": "Zürich AG, Genève", "Яндекс": "Яндекс", "SPSS Inc., Chicago": "SPSS Inc.", "Inc株": "Inc", "Foo incorporated of X": "Foo incorporated", "Bar, Armonk, NY, USA": "Bar"},
    "url": {"(https://quorstat.ехample/ a)": "https://quorstat", "https://fenstat.ｅｘ\u3000/b": "https://fenstat", "例え.example": "例え.example", "random.org": "random.org", "see ftp://ftp.x.example/a b": "ftp://ftp.x.example/ab", "http ://a.example/x": "http://a.example/x"},
    "software": {"«Étude»": "«Étude»", "(Λάμδα,)": "Λάμδα", "Éco\u3000Stat.": "Éco Stat", "ΠlyΣtat": "ΠlyΣtat", "Excel": "Excel", "“Foo’": "Foo", "{Foo}:'": "{Foo}:'"},
}
MORE = [("t1", "É1", "software"), ("t1", "é1", "version"), ("t1", "日本", "software"), ("t1", "日本", "publisher"), ("t1", "Excel", "url")]
TEXTS = [("t1", "a", 0, "Élan ÀÉ ab12 ١٢ «naïve» 日本 — x.\nПоиск iOS АБ٣", "fr"), ("t2", "a", 1, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    rows = [("t1", f, k) for k, forms in FORMS.items() for f in forms] + MORE
    spans = [(t, f"s{i}", k, f, i, i + 1) for i, (t, f, k) in enumerate(rows)]
    spark.createDataFrame(spans, "text_id string, span_id string, entity_type string, raw_form string, start_pos int, end_pos int").write.parquet(f"{d}/entity_spans.parquet")
    spark.createDataFrame(TEXTS, "text_id string, id string, para_no int, text string, lang string").write.parquet(f"{d}/texts.parquet")
    return str(d), spans


@pytest.mark.parametrize("name, kind", [("version", "version"), ("creator", "publisher"), ("url", "url"), ("name", "software")])
def test_all_raw_forms_are_normalised(spark, tables, name, kind):
    got = {r.raw_form: r for r in core.QUERIES[f"normalize_{name}"](spark, tables[0]).collect()}
    assert set(got) == {f for _, _, k, f, _, _ in tables[1] if k == kind}
    assert {f: got[f].normalized for f in FORMS[kind]} == FORMS[kind]
    if kind == "software":
        assert got["ΠlyΣtat"].words == "Πly Σtat" and got["ΠlyΣtat"].simple == "lytat" and got["日本"].simple == ""


def test_all_tokens_have_features(spark, tables):
    got = {r.token: r for r in core.QUERIES["token_features"](spark, tables[0]).collect()}
    pattern = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), PATTERN)
    assert set(got) == {t for t in (m[0] for m in re.finditer(pattern, TEXTS[0][3])) if t.strip()}
    kinds = {"Lu": "X", "Ll": "x", "Nd": "d"}
    for t, r in got.items():
        assert r["shape"] == "".join(kinds.get(unicodedata.category(c), c) for c in t) and r["lower"] == t.lower() and r.prefix2 == t[:2] and r.suffix3 == t[-3:]
    assert {t: (got[t].caps, got[t].digits, got[t].punct) for t in ("Élan", "ÀÉ", "Поиск", "АБ٣", "١٢", "«", "—", "日本", "iOS")} == {
        "Élan": ("INITCAP", "NODIGIT", "NOPUNCT"), "ÀÉ": ("ALLCAP", "NODIGIT", "NOPUNCT"), "Поиск": ("INITCAP", "NODIGIT", "NOPUNCT"), "АБ٣": ("ALLCAP", "CONTAINDIGIT", "NOPUNCT"),
        "١٢": ("NOCAPS", "ALLDIGIT", "NOPUNCT"), "«": ("NOCAPS", "NODIGIT", "QUOTE"), "—": ("NOCAPS", "NODIGIT", "PUNCT"), "日本": ("NOCAPS", "NODIGIT", "NOPUNCT"), "iOS": ("NOCAPS", "NODIGIT", "NOPUNCT"),
    }


def test_ambiguous_terms_and_json_of_all_spans(spark, tables):
    by = {}
    for _, _, k, f, _, _ in tables[1]:
        if f is not None:
            by.setdefault(f.lower(), []).append(k)
    want = {(f, ",".join(sorted(set(k))), len(k)) for f, k in by.items() if len(set(k)) > 1}
    assert {tuple(r) for r in core.QUERIES["ambiguous_terms"](spark, tables[0]).collect()} == want and len(want) == 3
    got = {r.span_id: json.loads(r.json) for r in core.QUERIES["mention_json_all"](spark, tables[0]).collect()}
    name = lambda f, a, b: {"offsetStart": a, "offsetEnd": b} | ({} if f is None else {"rawForm": f})
    assert got == {s: {"software-type": k, "software-name": name(f, a, b)} for _, s, k, f, a, b in tables[1]}


def test_every_annotated_name_is_propagated(spark, tmp_path):
    """Names outside the dictionary, and normal forms, in all texts of their document; a brute force over the same tables."""
    text = {("a1", "a"): "We ran Ξenostat and (Quor). R too.", ("a2", "a"): "Ξenostat, then Quor; Ξenostat R x.", ("b1", "b"): "Ξenostat was not annotated here, Quor Tools was.", ("b2", "b"): "Quor Tools and Quor", ("c1", "c"): "Nothing."}
    marks = [("a1", "Ξenostat"), ("a1", "(Quor)"), ("a1", "R"), ("a2", "x"), ("b1", "Quor Tools"), ("c1", None)]
    spans = [(t, f"s{i}", "software", f, *((b := next(v for k, v in text.items() if k[0] == t).index(f)), b + len(f))) if f else (t, f"s{i}", "software", None, 0, 1) for i, (t, f) in enumerate(marks)]
    spark.createDataFrame(spans, "text_id string, span_id string, entity_type string, raw_form string, start_pos int, end_pos int").write.parquet(f"{tmp_path}/entity_spans.parquet")
    spark.createDataFrame([(k, d, 0, v, "en") for (k, d), v in text.items()], "text_id string, id string, para_no int, text string, lang string").write.parquet(f"{tmp_path}/texts.parquet")
    got = {tuple(r[c] for c in ("id", "text_id", "start", "end", "term")) for r in core.QUERIES["propagated_hits"](spark, str(tmp_path)).collect()}
    assert got == {("a", "a2", 0, 8, "Ξenostat"), ("a", "a2", 15, 19, "Quor"), ("a", "a2", 21, 29, "Ξenostat"), ("a", "a2", 30, 31, "R"), ("b", "b2", 0, 10, "Quor Tools")}


def test_frequent_names_pass_the_gate_by_real_weights(spark, tmp_path):
    """ln(N / df) is 0.00033 here, so two mentions weigh too little and four weigh enough."""
    texts = [(f"t{i}", f"d{i}", 0, "Cmn", "en") for i in range(2999)] + [("one", "d0", 1, "Cmn", "en"), *[(f"two{k}", "d1", k + 1, "Cmn", "en") for k in range(3)], ("none", "last", 0, "x", "en")]
    spark.createDataFrame(texts, "text_id string, id string, para_no int, text string, lang string").write.parquet(f"{tmp_path}/texts.parquet")
    spans = [(t, t, "software", "Cmn", 0, 3) for t in ("t0", "t1", "t2")] + [("t2", "x", "software", "Cmn", 0, 3)]
    spark.createDataFrame(spans, "text_id string, span_id string, entity_type string, raw_form string, start_pos int, end_pos int").write.parquet(f"{tmp_path}/entity_spans.parquet")
    got = {r.text_id for r in core.QUERIES["propagated_hits"](spark, str(tmp_path)).collect()}
    assert got == {"two0", "two1", "two2"}


def test_codes_of_all_annotators(spark, tmp_path):
    labels = [(i, f"s{i % 3}", [" #ANNOTATOR", "annotator", "#annotator"][i % 3] + str(i % 5), [None, "true", "no"][i % 7 % 3], i * 37 % 11) for i in range(60)] + [(99, "s9", "annotator1", None, 1)]
    spark.createDataFrame([(f"annotator{i}",) for i in range(6)] + [("curator",)], "resp string").write.parquet(f"{tmp_path}/annotators.parquet")
    spark.createDataFrame(labels, "label_id bigint, span_id string, resp string, used string, labelled_at int").write.parquet(f"{tmp_path}/usage_labels.parquet")
    want = {s: {} for _, s, *_ in labels}
    for i, s, who, used, at in sorted(labels, key=lambda x: (x[4], x[0])):
        if used is not None:
            want[s][who.strip(" #").lower()] = used
    got = {r.span_id: {k: v for k, v in r.asDict().items() if k != "span_id"} for r in core.QUERIES["pivot_codes"](spark, str(tmp_path)).collect()}
    assert got == {s: {k: w.get(k) for k in [f"annotator{i}" for i in range(6)] + ["curator"]} for s, w in want.items()}
