"""Sentence units in many languages, with unsupervised statistics per language.

One pass over the texts emits possible boundaries with their context and counts of word types with and without a final period; all
else is joins and aggregates over that table. Log-likelihood ratios turn the counts into abbreviations (a type that has its period more
often than chance), sentence starters (a capitalised type that follows boundaries more often than capitalised types do) and
collocations (an abbreviation, initial or number with its period and the next word that follow each other more often than either does
elsewhere). Boundaries
that a mark alone decides never meet the learned tables; the others are joined to them, classified, and zipped into spans.

A text without a language gets the one whose word types it shares (by likelihood, from the texts that have one); which characters it is
written in decides how its boundaries are sought. Quotations and brackets are paired over the whole text. A heading is a line, or several
that follow each other, that stands before at least three different continuations.

Defined results: null texts and texts of white space have no sentences; repeated rows count once; of several texts under one id one is
taken; a text without a boundary is one sentence; offsets count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.confusables import skeleton
from lectern.session import cut_table

OPEN = "([{（［【「『“„«‹〈《‘‚"
CLOSE = ")]}）］】」』”“»›〉》’'\""
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "“": "”", "„": "“", "«": "»", "‹": "›", "〈": "〉", "《": "》"}
END = ".!?。！？।؟。؟"
SURE = "!?！？。।؟"
_token = re.compile(r"\S+")
_core = re.compile(rf"^(.*?)([{re.escape(END)}…]+)([{re.escape(CLOSE)}]*)$", re.S)
_cjk_end = re.compile(rf"(?:[。！？]|[!?](?![\w/=&#]))+[{re.escape(CLOSE)}]*")
_glued = re.compile(r"(?:[^\W\d_]{2}|[)\]])[.!?](?=[^\W\d_a-z][^\W\d_A-Z])")
_thai_gap = re.compile(r"(?<=[฀-๿])(\s+)(?=[฀-๿])")


_marked = re.compile(rf"(?<!\S)[^\s{re.escape(END)}…]*[{re.escape(END)}…]\S*")
_quotes = re.compile(f"[{re.escape(''.join(PAIRS) + ''.join(PAIRS.values()) + chr(34) + '”')}]")
_scripts = [(name, re.compile(x)) for name, x in (("ja", "[぀-ヿ]"), ("zh", "[㐀-鿿]"), ("th", "[฀-๿]"))]
CASELESS = ("zh", "ja", "th", "ar", "hi")
#: least log-likelihood ratios of starters and of collocations (chances of one in twenty and one in a thousand)
LEAST_STARTER, LEAST_COLLOCATION = 3.84, 10.83


def manner(text: str, lang: str | None) -> str:
    """How boundaries are sought: zh and ja (marks without spaces), th (spaces), or '' (words)."""
    if lang:
        return lang if lang in ("zh", "ja", "th") else ""
    return next((name for name, script in _scripts if len(script.findall(text)) > 0.15 * len(text)), "")


def inside(text: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets that close, outermost ones; one pass, each kind of mark with a stack of its own."""
    open_: dict = {c: [] for c in PAIRS}
    ends, straight = {}, -1
    n = len(text)
    for m in _quotes.finditer(text):
        i, c = m.start(), m.group()
        if c == '"':
            if straight >= 0 and not (i + 1 < n and text[i + 1].isalnum()):
                ends[straight], straight = i, -1
            elif (i == 0 or not text[i - 1].isalnum()) and i + 1 < n and not text[i + 1].isspace():
                straight = i
            continue
        for o in CLOSES.get(c, ()):
            if open_[o]:
                ends[open_[o].pop()] = i
                break
        else:
            if c in PAIRS and not (c == "“" and i and text[i - 1].isalnum() and text[i - 1] < "⺀"):
                open_[c].append(i)
    out, last = [], -1
    for i in sorted(ends):
        if i > last:
            last = ends[i]
            out.append((i, last))
    return out


CLOSES: dict = {}
for _o, _c in PAIRS.items():
    CLOSES.setdefault(_c, []).append(_o)
CLOSES["”"] = ["“", "„"]


def word_type(core: str) -> str:
    """A token's type: look-alikes folded, lower case, numbers as ##."""
    t = skeleton(core.strip(OPEN + CLOSE + ",;:¡¿")).lower()
    return re.sub(r"^\d+([.,]\d+)*$", "##", t)


def case_of(token: str) -> str:
    t = token.lstrip(OPEN + "¡¿'\"—–-")
    c = t[:1]
    if c.isdigit():
        return "ref" if token[0] in "([" else "digit"
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    return "other" if c.isalpha() else "mark"


def next_type(token: str) -> str:
    """The type of a following word; an initial keeps its period, so that it is not the word of one letter."""
    t = word_type(token)
    return t if len(t) == 2 and t[1] == "." else t.rstrip(".!?")


def after(text: str, at: int) -> int:
    """The next place that isn't white space."""
    m = _token.search(text, at)
    return m.start() if m else len(text)


def candidates(text: str, lang: str) -> list[tuple]:
    """(end, next start, kind, token type, next type, next case) of possible boundaries, in order. lang: see manner."""
    out: list[tuple] = []
    spans = inside(text)
    at = [a for a, _ in spans]

    def region(p: int):
        k = bisect_right(at, p) - 1
        return spans[k] if k >= 0 and spans[k][0] < p < spans[k][1] else None

    if lang in ("zh", "ja"):
        for m in _cjk_end.finditer(text):
            r = region(m.start())
            if r is None or (m.end() > r[1] and text[m.end() : m.end() + 1].isspace() and "\n" in text[m.end() : m.end() + 2]):
                out.append((m.end(), after(text, m.end()), "sure", "", "", "other"))
        return out
    if lang == "th":
        out = [(m.start(), m.end(), "sure", "", "", "other") for m in _thai_gap.finditer(text) if region(m.start()) is None]
    for m in _marked.finditer(text):
        w, skip = m.group(), 0
        nxt = _token.search(text, m.end())
        if nxt is None:
            break
        if "." in w[1:-1] or "!" in w or "?" in w:
            for g in _glued.finditer(w):
                if "://" not in w and region(m.start() + g.start()) is None:
                    rest, skip = w[g.end() :], g.end()
                    out.append((m.start() + g.end(), m.start() + g.end(), "glued", "", next_type(rest), case_of(rest)))
        c = _core.match(w)
        if not c:
            continue
        core, marks, _ = c.groups()
        p = m.start() + len(core)
        core = core[skip:] or core
        r = region(p)
        kind = "sure" if any(x in SURE for x in marks) else "period"
        if r is not None:
            if m.end() <= r[1]:
                continue
            kind = "quote"
        if kind == "period" and core.strip(OPEN) == "" and len(marks) > 1 or "…" in marks or "..." in marks:
            kind = "ellipsis" if r is None else kind
        t = word_type(core)
        if kind == "period":
            bare = core.strip(OPEN)
            if len(bare) == 1 and bare.isupper():
                kind = "initial"
            elif t == "##":
                kind = "number"
            elif bare[-1:] in (")", "]", "”", "»", '"', "’", "“", "%") or re.match(r"^(https?:|www\.)", bare):
                kind = "sure"
            elif t == "":
                kind = "ellipsis"
        following = nxt.group()
        out.append((m.end(), nxt.start(), kind, t, next_type(following), case_of(following)))
    return out


def line_key(line: str) -> str:
    return " ".join(skeleton(line).lower().split())


def head_lines(text: str) -> list[tuple[int, int, int, int, str, str, str]]:
    """(end before, start, end, next, key, what follows, its case) of lines, and of several joined, that stand where a heading could."""
    if "\n" not in text:
        return []
    out, lines = [], []
    for m in re.finditer(r"[^\n]*(?:\n|$)", text):
        if m.group():
            lines.append((m.start(), m.start() + len(m.group().rstrip("\n")), m.group().endswith("\n")))
    clear = True
    for k, (a, b, _) in enumerate(lines):
        alone = False
        if clear:
            for j in range(k, len(lines) - 1):
                e = lines[j][1]
                body = text[a:e].strip()
                if not body or not lines[j][2] or body[-1] in END + ",;:" + CLOSE:
                    break
                lead = len(text[a:e]) - len(text[a:e].lstrip())
                nxt = after(text, lines[j + 1][0])
                case = case_of(_token.match(text, nxt).group()) if nxt < len(text) else "mark"
                out.append((len(text[:a].rstrip()), a + lead, a + lead + len(body), nxt, line_key(body), line_key(text[nxt : nxt + 40]), case))
                alone = alone or (j == k and case != "lower")
        body = text[a:b].strip()
        clear = not body or body[-1] in END or (body[-1] in CLOSE and len(body) > 1 and body[-2] in END) or alone
    return out


class Types(dict):
    """What a raw token counts as: its type, whether a period ends it, and its type as a capitalised word."""

    def __missing__(self, w: str) -> tuple:
        if len(self) > 200_000:
            self.clear()
        m = _core.match(w)
        first = w.lstrip(OPEN + "¡¿\"")
        upper = word_type(first.rstrip(".,;:!?")) if first[:1].isupper() else None
        out = self[w] = (word_type(m.group(1) if m else w), "." if m and m.group(2)[0] == "." else "", upper)
        return out


FOUND = "id {t}, lang string, kind string, prev int, start int, end int, next int, tok string, nxt string, case string, n bigint"


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kinds: whole (a text), head, the boundaries' kinds, and counts: type (by id where the language is unknown) and upper."""
    types = Types()
    for pdf in batches:
        rows, count = [], {}
        for i, text, lang in zip(pdf["id"], pdf["text"], pdf["lang"]):
            how = manner(text, lang)
            lang = lang or how or None
            rows.append((i, lang, "whole", 0, len(text) - len(text.lstrip()), len(text.rstrip()), 0, "", "", "", 1))
            rows += [(i, lang, "head", p, a, b, n, key, follows, case, 1) for p, a, b, n, key, follows, case in head_lines(text)]
            rows += [(i, lang, kind, 0, 0, end, nxt, t, n, case, 1) for end, nxt, kind, t, n, case in candidates(text, how)]
            if not how:
                count.setdefault((lang, None if lang else i), Counter()).update(text.split())
        for (lang, i), raw in count.items():
            own: Counter = Counter()
            for w, n in raw.items():
                t, dot, upper = types[w]
                own["type", t, dot] += n
                if upper is not None:
                    own["upper", upper, ""] += n
            rows += [(i, lang, kind, 0, 0, 0, 0, t, "", dot, n) for (kind, t, dot), n in own.items()]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])


def with_language(found: DataFrame) -> DataFrame:
    """found with a language everywhere: that of the texts whose word types are likeliest, or 'und'."""
    types = found.where("kind = 'type' and tok not in ('', '##')")
    profile = types.where("lang is not null").groupBy("lang", "tok").agg(F.sum("n").alias("c"))
    size = profile.groupBy("lang").agg(F.sum("c").alias("all"))
    own = types.where("lang is null").select("id", "tok").distinct()
    hit = own.join(profile, "tok").join(F.broadcast(size), "lang")  # one row a language
    scored = hit.groupBy("id", "lang").agg(F.sum(F.log1p(2 * F.col("c"))).alias("s"), F.max(F.log(2 * F.col("all") + 1)).alias("l"))
    n = own.groupBy("id").agg(F.count(F.lit(1)).alias("words"))
    likely = scored.join(n, "id").groupBy("id").agg(F.max_by("lang", F.struct(F.col("s") - F.col("words") * F.col("l"), "lang")).alias("guess"))
    likely = cut_table(likely)
    rest = found.where("lang is null").join(likely, "id", "left").withColumn("lang", F.coalesce("guess", F.lit("und"))).drop("guess")
    return found.where("lang is not null").unionByName(rest.select(*found.columns))


def ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Log-likelihood ratio of two shares k1 / n1 and k2 / n2 against one common share."""

    def ll(k: Column, n: Column, p: Column) -> Column:
        low = F.lit(1e-12)
        return k * F.log(F.greatest(p, low)) + (n - k) * F.log(F.greatest(1 - p, low))

    p = (k1 + k2) / (n1 + n2)
    one = lambda k, n: k / F.greatest(n, F.lit(1))
    return 2 * (ll(k1, n1, one(k1, n1)) + ll(k2, n2, one(k2, n2)) - ll(k1, n1, p) - ll(k2, n2, p))


class Model:
    """abbreviations(lang, tok, start_share), starters(lang, nxt), collocations(lang, tok, nxt), heads(lang, tok); written tables."""

    def __init__(self, found: DataFrame):
        """All is learned from one written table of counts."""
        found = cut_table(found.where("kind not in ('whole', 'glued', 'quote', 'ellipsis')").groupBy("lang", "kind", "tok", "nxt", "case").agg(F.sum("n").alias("n")))
        n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
        types = found.where("kind = 'type'").groupBy("lang", "tok").agg(n(F.col("case") == ".").alias("w"), F.sum("n").alias("c"))
        totals = types.groupBy("lang").agg(F.sum("w").alias("periods"), F.sum("c").alias("all"))
        p1 = F.greatest(F.col("periods") / F.col("all"), F.lit(1e-9))
        o = F.col("c") - F.col("w")
        llr = -2 * ((F.col("w") * F.log(p1) + o * F.log(1 - p1)) - (F.col("w") * F.log(F.lit(0.99)) + o * F.log(F.lit(0.01))))
        inner = F.length("tok") - F.length(F.replace("tok", F.lit("."), F.lit("")))
        letters = F.greatest(F.length("tok") - inner, F.lit(1))
        score = llr * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -o)
        # a type seen without its period now and then is still an abbreviation if that is rare
        often = F.col("w") > 0.9 * F.col("c")
        rare_score = llr * F.exp(-letters.cast("double")) * (inner + 1)
        abbr = types.where("tok <> '' and tok <> '##' and w > 0").join(F.broadcast(totals), "lang")  # one row a language
        abbr = cut_table(abbr.where((F.when(often, rare_score).otherwise(score) >= 0.3) & F.col("tok").rlike(r"\p{L}")).select("lang", "tok"))
        upper = found.where("kind = 'upper'").groupBy("lang", F.col("tok").alias("nxt")).agg(F.sum("n").alias("total"))
        pairs = found.where("kind in ('period', 'initial', 'number', 'sure') and nxt <> ''")
        after_period = pairs.where("kind in ('period', 'initial')")

        def begin(abbreviated: DataFrame) -> DataFrame:
            plain = pairs.where("kind = 'period' and case = 'upper'").join(abbreviated.select("lang", "tok"), ["lang", "tok"], "left_anti")
            sure = pairs.where("kind = 'sure' and case = 'upper'")
            begins = plain.select("lang", "nxt", "n").unionByName(sure.select("lang", "nxt", "n")).groupBy("lang", "nxt").agg(F.sum("n").alias("begins"))
            j = upper.join(begins, ["lang", "nxt"], "left").fillna({"begins": 0}).withColumn("begins", F.least("begins", "total"))
            j = j.join(F.broadcast(j.groupBy("lang").agg(F.sum("begins").alias("b"), F.sum("total").alias("t"))), "lang")  # one row a language
            others = (F.col("b") - F.col("begins"), F.col("t") - F.col("total"))
            more = F.col("begins") * F.col("t") > F.col("b") * F.col("total")
            return j.where((F.col("nxt") != "") & more & (ratio(F.col("begins"), F.col("total"), *others) >= LEAST_STARTER)).select("lang", "nxt")

        def followers(starters: DataFrame) -> DataFrame:
            j = after_period.join(starters.withColumn("s", F.lit(1)), ["lang", "nxt"], "left")
            return j.groupBy("lang", "tok").agg((n((F.col("s") == 1) & (F.col("case") == "upper")) / F.sum("n")).alias("start_share"))

        # what only sentence starters follow ends sentences, however rare it is elsewhere; both lists are learned twice
        first = cut_table(abbr.join(followers(cut_table(begin(abbr))), ["lang", "tok"], "left").where("coalesce(start_share, 0) < 0.85").select("lang", "tok"))
        self.starters = cut_table(begin(first))
        self.abbreviations = cut_table(abbr.join(followers(self.starters), ["lang", "tok"], "left").where("coalesce(start_share, 0) < 0.85").select("lang", "tok", "start_share"))
        followed = pairs.where("kind <> 'sure' and case = 'upper'")
        ab = followed.groupBy("lang", "tok", "nxt").agg(F.sum("n").alias("k"))
        a, b, t = (ab.groupBy(*keys).agg(F.sum("k").alias(name)) for keys, name in ((["lang", "tok"], "ka"), (["lang", "nxt"], "kb"), (["lang"], "kt")))
        j = ab.where("k > 1").join(a, ["lang", "tok"]).join(b, ["lang", "nxt"]).join(F.broadcast(t), "lang").join(self.starters, ["lang", "nxt"], "left_anti").join(upper, ["lang", "nxt"])
        k, ka, kb, kt = (F.col(x) for x in ("k", "ka", "kb", "kt"))
        self.collocations = cut_table(j.where((k * kt > ka * kb) & (k > 0.3 * F.col("total")) & (ratio(k, ka, kb - k, kt - ka) >= LEAST_COLLOCATION)).select("lang", "tok", "nxt"))
        lines = found.where("kind = 'head'").groupBy("lang", "tok", "nxt").agg(F.bool_or(F.col("case") != "lower").alias("up"), F.sum("n").alias("n"))
        lines = lines.groupBy("lang", "tok").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"), F.sum(F.when(F.col("up"), F.col("n")).otherwise(0)).alias("u"))
        self.heads = cut_table(lines.where("m >= 3 and u >= 0.75 * all").select("lang", "tok"))


def prepare(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    known = F.lower(F.trim(lang_col))
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.when(known.rlike("^[a-z]{2}$"), known).alias("lang"))
    return src.where(F.col("text").rlike(r"\S"))


def classify(found: DataFrame, m: Model) -> DataFrame:
    """id, end, next of accepted boundaries."""
    yes = F.lit(True)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    upper, lower = F.col("case") == "upper", F.col("case") == "lower"
    caseless = F.col("lang").isin(*CASELESS)
    boundaries = found.where("kind not in ('whole', 'head', 'type', 'upper')")
    sure = boundaries.where("kind = 'sure'").select("id", "end", "next")
    open_ = boundaries.where("kind <> 'sure'").where((F.col("kind").isin("number", "period")) | upper)
    j = open_.join(m.abbreviations.withColumn("abbr", yes), ["lang", "tok"], "left").join(m.starters.withColumn("starts", yes), ["lang", "nxt"], "left")
    j = j.join(m.collocations.withColumn("tied", yes), ["lang", "tok", "nxt"], "left")
    begins = flag("starts") | (F.coalesce(F.col("start_share"), F.lit(0.0)) > 0.5)
    ok = (
        F.when(F.col("kind").isin("quote", "glued", "ellipsis"), upper & flag("starts"))
        .when(flag("tied") & (flag("abbr") | F.col("kind").isin("initial", "number")), False)
        .when(F.col("kind") == "initial", upper & begins)
        .when(F.col("kind") == "number", upper | (F.col("case") == "mark") | caseless)
        .when(flag("abbr"), upper & begins)
        .otherwise((F.col("case") != "ref") & ~(lower & (F.length("tok") == 1)))
    )
    heads = found.where("kind = 'head' and case <> 'lower'").join(m.heads, ["lang", "tok"], "left_semi")
    around = F.explode(F.array(F.struct(F.col("prev").alias("end"), F.col("start").alias("next")), F.struct("end", "next"))).alias("x")
    return sure.unionByName(j.where(ok).select("id", "end", "next")).unionByName(heads.select("id", around).select("id", "x.*"))


def assemble(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """id, start_pos, end_pos from the wholes and the accepted boundaries; a text's boundaries are few."""
    whole = found.where("kind = 'whole'").groupBy("id").agg(F.max(F.struct("end", "start")).alias("w")).select("id", F.col("w.start").alias("first"), F.col("w.end").alias("last"))
    cuts = accepted.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("end", "next"))).alias("cuts"))
    j = whole.join(cuts, "id", "left").withColumn("cuts", F.filter(F.coalesce("cuts", F.expr("cast(array() as array<struct<end:int,next:int>>)")), lambda x: (x["end"] > F.col("first")) & (x["next"] < F.col("last"))))
    starts, stops = F.concat(F.array("first"), F.col("cuts.next")), F.concat(F.col("cuts.end"), F.array("last"))
    spans = j.select("id", F.explode(F.arrays_zip(starts.alias("a"), stops.alias("b"))).alias("s")).select("id", F.col("s.a").alias("start_pos"), F.col("s.b").alias("end_pos"))
    return spans.where("start_pos < end_pos")


def sentences(df: DataFrame, id_col: str = "text_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, start_pos, end_pos of every sentence of every text."""
    texts = prepare(df, id_col, text_col, lang_col).dropDuplicates(["id"])
    raw = cut_table(texts.mapInPandas(_found, FOUND.format(t=dict(texts.dtypes)["id"])))
    found = with_language(raw)
    return assemble(found, classify(found, Model(found))).withColumnRenamed("id", id_col)
