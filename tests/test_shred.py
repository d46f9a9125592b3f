import json

import pytest

from lectern.operators.shred import _Pairs, entity_tables, load_wrapped, other_tables, parse_deep, shred_json, span_places


def brute(record_id, payload):
    """Spans by plain recursion over dictionaries."""
    v = payload
    while isinstance(v, str):
        try:
            v = json.loads(v.strip("﻿\x00 \t\r\n"))
        except ValueError:
            return []
    out = []
    aslist = lambda x: [x] if isinstance(x, dict) else x if isinstance(x, list) else []
    key = lambda s: s.lower().replace("_", "")
    docs = []
    for i, r in enumerate(aslist(v)):
        if not isinstance(r, dict):
            continue
        inner = [x for k, x in r.items() if key(k) == "documents" and isinstance(x, (dict, list))]
        docs += [(j, d) for j, d in enumerate(aslist(inner[0])) if isinstance(d, dict)] if inner else [(i, r)]
    for doc_no, d in docs:
        for name, ps in d.items():
            if key(name) not in ("abstract", "bodytext", "texts"):
                continue
            for para_no, p in enumerate(aslist(ps)):
                for kind, ss in (p or {}).items():
                    if key(kind) in ("entityspans", "refspans"):
                        for span_no, s in enumerate(aslist(ss)):
                            if isinstance(s, dict):
                                out.append((record_id, doc_no, {"bodytext": "body_text"}.get(key(name), key(name)), para_no, key(kind)[:-5], span_no))
    return out


PLAIN = {"id": "a", "abstract": None, "body_text": [None, {"text": "x", "entitySpans": [None, {"rawForm": "S", "start": 1, "end": 2, "attributes": {"version": {"start": 3}}}], "Ref_Spans": {"ref_id": "b1"}}]}
MANY = {"documents": [{"id": "b", "texts": {"text": "t", "entity_spans": [{"used": True, "cert": "0.5"}]}}, None, {"id": "c", "texts": [{"text": "u", "entity_spans": {"rawForm": "Q"}}]}]}


def test_cases(spark):
    rows = [
        (1, json.dumps(PLAIN)),
        (2, json.dumps(MANY)),
        (3, json.dumps(json.dumps(PLAIN))),
        (4, "﻿" + json.dumps(MANY)),
        (5, json.dumps([PLAIN, PLAIN])),
        (6, json.dumps(PLAIN)[:-9]),
        (7, None),
        (8, ""),
        (9, "[]"),
        (2, json.dumps(MANY)),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id bigint, payload string, node string")
    nodes = shred_json(df)
    got = sorted(map(tuple, span_places(nodes).collect()))
    want = sorted({x for r in rows if r[1] is not None for x in brute(*r)})
    assert got == want and len(got) > 8
    tables = entity_tables(nodes)
    spans = {(r.record_id, r.raw_form): r for r in tables["entity_spans"].collect()}
    assert (spans[1, "S"].start, spans[1, "S"].end) == (1, 2)
    assert tables["documents"].where("id = 'c'").count() == 2
    paragraphs = {(r.record_id, r.node) for r in tables["paragraphs"].collect()}
    assert all((r.record_id, r.parent_node) in paragraphs for r in tables["ref_spans"].collect())


def test_empty_and_two_lists_of_one_name(spark):
    empty = spark.createDataFrame([], "record_id bigint, payload string")
    assert span_places(shred_json(empty)).count() == 0
    twice = '{"texts": [{"entity_spans": [{"a": 1}, {"a": 2}], "Entity_Spans": [{"a": 3}]}]}'
    df = spark.createDataFrame([(1, twice)], "record_id bigint, payload string")
    assert sorted(r.span_no for r in span_places(shred_json(df)).collect()) == [0, 1, 2]
    assert load_wrapped("nonsense") is None


def test_nesting_of_any_depth(spark):
    deep = '{"id": "a", "x": ' + "[" * 100_000 + '{"k": "\\u00e9\\n"}' + "]" * 100_000 + ', "texts": [{"text": "t", "entity_spans": [{"rawForm": "S"}]}]}'
    df = spark.createDataFrame([(1, deep), (2, deep[:-1])], "record_id bigint, payload string")
    nodes = shred_json(df)
    assert nodes.count() > 100_000 and [tuple(r) for r in span_places(nodes).collect()] == [(1, 0, "texts", 0, "entity", 0)]
    for good in ('[1, -2.5e3, true, null, "a\\"b", {}, [], {"a": {"b": [0]}}]', '"x"', "7"):
        assert plain(parse_deep(good)) == json.loads(good)
    for bad in ("[1,]", '{"a" 1}', "{1: 2}", "[1 2]", "[", "]", "", '{"a": 1,}', "[1}", "nope", '["a"', "1 2", '{"a":}'):
        with pytest.raises(ValueError):
            parse_deep(bad)


def plain(v):
    if isinstance(v, _Pairs):
        return {k: plain(x) for k, x in v}
    return [plain(x) for x in v] if isinstance(v, list) else v


def test_nothing_is_left_out_of_the_tables(spark):
    payload = {"id": "a", "other": {"p": 1}, "texts": [{"text": "t", "class_attributes": {"used": {"value": True, "score": 0.5}}, "entity_spans": [{"rawForm": "S", "attributes": [[{"version": "2"}]]}]}]}
    nodes = shred_json(spark.createDataFrame([(1, json.dumps(payload))], "record_id bigint, payload string"))
    tables = entity_tables(nodes) | other_tables(nodes)
    where = {r.node: r for n in ("documents", "paragraphs", "entity_spans", "objects") for r in tables[n].collect()}
    values = tables["values"].collect()
    assert sorted(v.value for v in values) == sorted(["a", "1", "t", "true", "0.5", "S", "2"]) and all(v.parent_node in where for v in values)
    objects = {r.label: r for r in tables["objects"].collect()}
    assert set(objects) == {"other", "class_attributes", "used", ""} and objects[""].parent_node == tables["entity_spans"].first().node
