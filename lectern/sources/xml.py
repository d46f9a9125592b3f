"""XML sources: paragraphs with callouts, bibliographies, inline annotations, metadata, lossy JSON.

Mixed content needs a parser that keeps text and children in order, so these run in Arrow batches over whole documents.
Defined results: null and ill-formed XML give no rows; namespaces are ignored; nested elements keep document order."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.tokens import PATTERN

_doctype = re.compile(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?>")
ID = "{http://www.w3.org/XML/1998/namespace}id"


def tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def parse(xml: str | None) -> ET.Element | None:
    if not xml:
        return None
    try:
        return ET.fromstring(_doctype.sub("", xml).strip().encode())
    except ET.ParseError:
        return None


def within(root: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if tag(e) in names)


def pieces(e: ET.Element) -> Iterator[tuple[str, ET.Element | None]]:
    """(text, child it belongs to) in document order; a child's text is taken whole."""
    if e.text:
        yield e.text, None
    for child in e:
        yield "".join(child.itertext()), child
        if child.tail:
            yield child.tail, None


def paragraph(e: ET.Element) -> tuple[str, str, list[tuple]]:
    """(text with references blanked to equal length, original text, callouts as label, start, end, target)."""
    blank, original, callouts, at = [], [], [], 0
    for text, child in pieces(e):
        kind = child.get("type", "") if child is not None and tag(child) == "ref" else None
        if kind is not None and kind not in ("uri", "url"):
            blank.append(" " * len(text))
            if kind == "bibr":
                callouts.append((text, at, at + len(text), (child.get("target") or "").lstrip("#")))
        else:
            blank.append(text)
        original.append(text)
        at += len(text)
    return "".join(blank), "".join(original), callouts


def _rows(df: DataFrame, doc: str, xml: str, make: Callable, schema: str) -> DataFrame:
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, x in zip(pdf["d"], pdf["x"]):
                root = parse(x)
                if root is not None:
                    rows += [(d, *r) for r in make(root)]
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    kind = dict(df.dtypes)[doc]
    return df.select(F.col(doc).alias("d"), F.col(xml).alias("x")).mapInPandas(run, f"doc_id {kind}, {schema}")


def tei_paragraphs(df: DataFrame, doc: str = "doc_id", xml: str = "xml") -> DataFrame:
    """Every paragraph in document order with a running global offset."""

    def make(root: ET.Element) -> Iterator[tuple]:
        at = 0
        for no, p in enumerate(within(root, "p")):
            blank, original, callouts = paragraph(p)
            yield no, blank, original, at, [{"label": a, "start": b, "end": c, "target": t} for a, b, c, t in callouts]
            at += len(blank)

    return _rows(df, doc, xml, make, "para_no int, text string, original string, global_offset int, callouts array<struct<label:string,start:int,end:int,target:string>>")


def tei_bibliography(df: DataFrame, doc: str = "doc_id", xml: str = "xml") -> DataFrame:
    """One row per biblStruct; ref_key is the document order."""

    def text(e: ET.Element | None) -> str | None:
        t = " ".join("".join(e.itertext()).split()) if e is not None else ""
        return t or None

    def make(root: ET.Element) -> Iterator[tuple]:
        for key, b in enumerate(within(root, "biblStruct")):
            titles = {(t.get("level") or ""): text(t) for t in within(b, "title")}
            ids = {(i.get("type") or "").lower(): text(i) for i in within(b, "idno")}
            scope = {}
            for s in within(b, "biblScope"):
                unit = s.get("unit") or s.get("type") or ""
                if unit in ("page", "pp"):
                    first, last = s.get("from"), s.get("to")
                    whole = text(s)
                    if whole and not first:
                        first, _, last = (x.strip() or None for x in whole.partition("-"))
                    scope["from"], scope["to"] = first or scope.get("from"), last or scope.get("to")
                else:
                    scope[unit] = text(s)
            date = next(within(b, "date"), None)
            when = (date.get("when") if date is not None else None) or text(date)
            year = re.search(r"\d{4}", when or "")
            authors = []
            for a in within(b, "author"):
                parts = [text(x) for n in ("forename", "surname") for x in within(a, n)]
                authors.append(" ".join(filter(None, parts)) or text(a))
            yield (
                key, b.get(ID), titles.get("a") or titles.get("m"), titles.get("j"), ids.get("doi"), ids.get("pmid"), ids.get("pmcid"), ids.get("issn"), int(year.group()) if year else None,
                scope.get("from"), scope.get("to"), scope.get("volume") or scope.get("vol"), scope.get("issue"), text(next(within(b, "publisher"), None)), [a for a in authors if a],
            )

    return _rows(df, doc, xml, make, "ref_key int, xml_id string, title string, journal string, doi string, pmid string, pmcid string, issn string, year int, begin_page string, end_page string, volume string, issue string, publisher string, authors array<string>")


def article_metadata(df: DataFrame, doc: str = "doc_id", xml: str = "xml") -> DataFrame:
    """title (three places, first filled one), doi (must look like one), authors joined by commas."""

    def make(root: ET.Element) -> Iterator[tuple]:
        head = next(within(root, "teiHeader"), root)
        titles = [" ".join("".join(t.itertext()).split()) for t in within(head, "title")]
        main = [" ".join("".join(t.itertext()).split()) for t in within(head, "title") if t.get("type") == "main"]
        doi = next((x for x in (("".join(i.itertext())).strip() for i in within(head, "idno")) if x.startswith("10.") or "doi.org" in x), None)
        authors = []
        for a in within(head, "author"):
            names = [("".join(x.itertext())).strip() for x in within(a, "forename", "surname")]
            if names:
                authors.append(" ".join(names))
        yield next(filter(None, [*main, *titles]), None), doi, ", ".join(authors) or None

    return _rows(df, doc, xml, make, "title string, doi string, authors string")


def inline_annotations(df: DataFrame, doc: str = "doc_id", xml: str = "xml", cleaned: bool = False, unit: str = "p", inclusive: bool = False) -> DataFrame:
    """Text of each paragraph (or other unit, as s for sentences) and its rs elements: para_no, text, spans (type, start, end, raw, id, corresp,
    attributes). Ends are exclusive, or name the last character if ``inclusive``."""

    def make(root: ET.Element) -> Iterator[tuple]:
        for no, p in enumerate(within(root, unit)):
            text, spans = [], []
            at = 0
            for t, child in pieces(p):
                t = re.sub(r"\s+", " ", t) if cleaned else t
                if child is not None and tag(child) == "rs":
                    kind = {"publisher": "creator"}.get(child.get("type", ""), child.get("type", ""))
                    spans.append({"type": kind, "start": at, "end": at + len(t) - inclusive, "raw": t, "id": child.get(ID), "corresp": child.get("corresp"), "attributes": {k.rsplit("}", 1)[-1]: v for k, v in child.attrib.items()}})
                text.append(t)
                at += len(t)
            yield no, "".join(text), spans

    return _rows(df, doc, xml, make, "para_no int, text string, spans array<struct<type:string,start:int,end:int,raw:string,id:string,corresp:string,attributes:map<string,string>>>")


def lossy_json(df: DataFrame, doc: str = "doc_id", xml: str = "xml") -> DataFrame:
    """The paragraph-level JSON form: abstract and body_text with reference and entity spans; lists of references are left out."""

    def one(p: ET.Element, section: str | None) -> dict:
        out: dict = {"section": section} if section else {}
        refs, entities, parts, at = [], [], [], 0
        for t, child in pieces(p):
            if child is not None and tag(child) == "ref":
                refs.append({"type": child.get("type"), "ref_id": (child.get("target") or "").lstrip("#") or None, "start": at, "end": at + len(t), "text": t})
            elif child is not None and tag(child) == "rs":
                span = {"type": child.get("type"), "start": at, "end": at + len(t), "rawForm": t, "id": child.get(ID), "resp": child.get("resp"), "used": child.get("used"), "cert": child.get("cert")}
                entities.append({k: v for k, v in span.items() if v is not None})
            parts.append(t)
            at += len(t)
        return out | {"text": "".join(parts), "ref_spans": [{k: v for k, v in r.items() if v is not None} for r in refs], "entity_spans": entities}

    def make(root: ET.Element) -> Iterator[tuple]:
        doc_: dict = {"level": "paragraph", "abstract": [], "body_text": []}

        def walk(e: ET.Element, abstract: bool, section: str | None) -> None:
            for child in e:
                name = tag(child)
                if name == "listBibl":
                    continue
                if name == "head":
                    section = "".join(child.itertext()).strip() or None
                elif name in ("p", "note", "figDesc"):
                    doc_["abstract" if abstract else "body_text"].append(one(child, section))
                else:
                    walk(child, abstract or name == "abstract", section)

        walk(root, False, None)
        yield (json.dumps(doc_, ensure_ascii=False),)

    return _rows(df, doc, xml, make, "payload string")


def text_chunks(df: DataFrame, doc: str = "doc_id", xml: str = "xml") -> DataFrame:
    """Squeezed text of every paragraph."""
    p = tei_paragraphs(df, doc, xml)
    return p.select("doc_id", "para_no", F.trim(F.regexp_replace("original", r"\s+", " ")).alias("text")).where("text <> ''")


def labelled_tokens(df: DataFrame, doc: str = "doc_id", xml: str = "xml", unit: str = "p") -> DataFrame:
    """para_no, pos, token, label of a labelled collection: rs elements give I-<type> and <type>, all else <other>; line and page breaks
    (lb, pb) are the tokens +L+ and +PAGE+ with a null label."""
    pattern = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", PATTERN))

    def walk(e: ET.Element, label: str) -> Iterator[tuple[str, str | None]]:
        name = tag(e)
        if name in ("lb", "pb"):
            yield {"lb": "+L+", "pb": "+PAGE+"}[name], None
        own = e.get("type") or label if name == "rs" else label
        if e.text:
            yield e.text, own
        for child in e:
            yield from walk(child, own)
            if child.tail:
                yield child.tail, own

    def make(root: ET.Element) -> Iterator[tuple]:
        for no, p in enumerate(within(root, unit)):
            pos, before = 0, "other"
            for text, label in walk(p, "other"):
                for token in [text] if label is None else pattern.findall(text):
                    begins = label is not None and label != "other" and label != before
                    yield no, pos, token, None if label is None else f"{'I-' if begins else ''}<{label}>"
                    pos, before = pos + 1, before if label is None else label

    return _rows(df, doc, xml, make, "para_no int, pos int, token string, label string")


def annotators(df: DataFrame, doc: str = "doc_id", xml: str = "xml") -> DataFrame:
    """no, id, name of the annotators in the order of their respStmt; a statement without an id is named by its place."""

    def make(root: ET.Element) -> Iterator[tuple]:
        for no, r in enumerate(within(root, "respStmt")):
            name = next((" ".join("".join(x.itertext()).split()) for x in within(r, "name", "persName")), None)
            yield no, r.get(ID) or next((x.get(ID) for x in r.iter() if x.get(ID)), f"annotator{no}"), name

    return _rows(df, doc, xml, make, "no int, id string, name string")


def relevant_text(df: DataFrame, doc: str = "doc_id", xml: str = "xml") -> DataFrame:
    """no, kind, text, n_ref of what is read for mentions: paragraphs of abstract and body, foot notes, figure descriptions and headings; the
    text is without references, whose characters are counted."""
    kinds = {"p": "paragraph", "note": "note", "figDesc": "figure", "head": "heading"}

    def make(root: ET.Element) -> Iterator[tuple]:
        no = 0
        for part in within(root, "abstract", "body"):
            for e in within(part, *kinds):
                if tag(e) == "note" and e.get("place") != "foot":
                    continue
                kept = [t for t, child in pieces(e) if child is None or tag(child) != "ref"]
                refs = sum(len(t) for t, child in pieces(e) if child is not None and tag(child) == "ref")
                yield no, "abstract" if tag(part) == "abstract" else kinds[tag(e)], "".join(kept), refs
                no += 1

    return _rows(df, doc, xml, make, "no int, kind string, text string, n_ref int")
