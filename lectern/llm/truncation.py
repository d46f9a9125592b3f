"""Text cut off by field limits.

A vocabulary of all words of the corpus is kept as a trie in a table: every prefix with the number of words' occurrences that run
through it and that end there. A value whose final token runs on in the trie but hardly ever ends there stopped inside a word.
Length evidence: at one source one exact length is many times as frequent as the lengths around it. Both kinds of evidence decide by
themselves, whatever the end of the text looks like, except where a closing mark stands. What they leave open (cuts between words at no
fixed length) is read from the last line: a sentence without its closing mark is cut; lines that need none (headings, lists, table
rows, links, references, Thai) are complete.

Defined results: null and empty texts are no case; white space at the end doesn't count; repeated rows count once; texts, lines and words
of any length are read whole; a mark of a cut on a line of its own belongs to the line before; a text that is nothing but such a mark
is no case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.match import small
from lectern.session import cut_table

# fixed values: what is put after a cut, and titles that stand before names
MARKERS = r"(?:\s*(?:\[\s*(?:truncated|cut|more|\.\.\.|…|gekürzt|tronqué)\s*\]|\((?:truncated|cut|more|continued)\)|<(?:truncated|cut|more)>|…|\.\.\.+|\bread more\b|\[\+\d+ chars\]))+\s*$"
TITLES = frozenset("dr prof mr mrs ms mme mlle hr fr sr sra dra д-р проф fig tab abb nr no".split())
END = ".!?。！？।؟"
QUOTES = {'"': '"', "”": "“„", "“": "„", "»": "«", "」": "「", "』": "『", "’": "‘"}
_marker = re.compile(MARKERS, re.I)
_url = re.compile(r"^\S*(?:https?://|www\.)\S+$")
_word_char = re.compile(r"[\ẁ-ͯऀ-෿]")
_reference = re.compile(r"^\s*(?:\[\d+\]|\d+\.|•|-)\s*.*(?:\(?(?:19|20)\d\d\)?|doi|10\.\d{4})", re.I)
_unspaced = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")  # scripts whose words the vocabulary can't tell
_thai = re.compile(r"[฀-๿]$")


def _inner_quote(body: str) -> bool:
    """Whether the closing quote at the end closes a quotation that began inside its sentence."""
    opens = QUOTES[body[-1]]
    at = max(body.rfind(o, 0, len(body) - 1) for o in opens)
    if at < 0:
        return True
    before = body[:at].rstrip()
    return bool(before) and before[-1] not in END and before[-1] != "\n"


def _mark(body: str):
    """The match of what was put after a cut, at the end of body."""
    return _marker.search(body) if body[-1:] in "]>…)" or body.endswith(("...", "more", "More", "MORE")) else None


def _last_word(body: str) -> str:
    i = len(body)
    while i and _word_char.match(body[i - 1]):
        i -= 1
    return body[i:]


def tail_kind(text: str) -> tuple[str, str, str]:
    """(kind, final token, last line) of the end of a text; kind 'cut' and 'whole' are final, others need the corpus."""
    body = text.rstrip()
    if not body:
        return "whole", "", ""
    m = _mark(body)
    marked = bool(m) and m.start() > 0
    if marked:
        body = body[: m.start()].rstrip()
    if not body:
        return "whole", "", ""
    if body[-1] == "�":
        return "cut", "", ""
    line = body.rsplit("\n", 1)[-1].strip()
    last = body[-1]
    w = _last_word(body)
    token = w.lower() if not _unspaced.search(w) else ""
    if last in END:
        if last != ".":
            return "whole", "", ""
        final = line.split()[-1][:-1].lstrip("([{«„“\"'").lower() if line.split() else ""
        if final.endswith("."):
            return ("cut" if final.strip(".") == "" else "abbreviation"), final, line
        if re.fullmatch(r"[\d.,]*\d", final):
            return "number", final, line
        original = line.split()[-1][:-1] if line.split() else ""
        if (len(original) == 1 and original.isupper()) or final in TITLES:
            return "cut", final, line
        return "abbreviation", final, line
    if last in QUOTES and len(body) > 1 and body[-2] in END:
        return ("cut" if _inner_quote(body) else "whole"), "", line
    if last in ")]" and len(body) > 1 and body[-2] in END and not re.search(r"[(\[][^()\[\]]*$", body[:-2]):
        return "whole", "", line
    if marked:
        return "cut", token, line
    if "\t" in body.rsplit("\n", 1)[-1]:
        return "row", token, line
    if _url.match(line):
        return "link", token, line
    if line.count(";") >= 2 or re.match(r"^[^\s.:]{4,16}\s?[:\-–—]\s\S[^.!?]*;", line):
        return ("cut" if last in ",;:-–" else "list"), token, line
    if _reference.match(line):
        return ("cut" if last in ",;:" else "reference"), token, line
    if _thai.search(body):
        return "thai", body.split()[-1][-5:], line
    if last in ",;:–—(-":
        return "cut", token, line
    return "open", token, line


def tails(docs: DataFrame) -> DataFrame:
    """doc_id, source, n, kind, token, line (a digest): of the last line that isn't empty, and the one before if that is only a mark of a cut."""

    def tail(lines) -> str:
        last = lines[-1]
        m = _mark(last)
        return "\n" + (f"{lines[0]}\n{last}" if m and m.start() == 0 and len(lines) > 1 else last)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [tail_kind(tail(x)) for x in pdf["lines"]]
            digest = [hashlib.md5(k[2].encode()).hexdigest() for k in kinds]
            yield pdf[["doc_id", "source", "n"]].assign(kind=[k[0] for k in kinds], token=[k[1] for k in kinds], line=digest, start=[k[2] if k[0] == "open" else None for k in kinds])

    blank = F.lit(" \n\r\t\x0b\x0c\u0085\u00a0\u2028\u2029\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
    body = docs.select("doc_id", "source", F.length("text").alias("n"), F.rtrim("text", blank).alias("body")).withColumn("last", F.substring_index("body", "\n", -1))
    before = F.substring_index(F.rtrim(F.left("body", F.length("body") - F.length("last")), blank), "\n", -1)
    ends = body.where("body <> ''").select("doc_id", "source", "n", F.when(before != "", F.array(before, "last")).otherwise(F.array("last")).alias("lines"))
    return ends.mapInPandas(run, "doc_id bigint, source string, n int, kind string, token string, line string, start string")


def words(docs: DataFrame) -> DataFrame:
    """word, n over all texts."""
    return docs.select(F.explode_outer(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}_]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def trie(vocabulary: DataFrame, prefixes: DataFrame, head: int = 4) -> DataFrame:
    """The trie's nodes that are asked for: token, ends (words that end there), runs_on (words that run through).

    Nodes of fewer than ``head`` characters are made of all words; deeper ones only of words that begin like one that is asked for."""
    asked = prefixes.select("token").distinct()
    deep = vocabulary.where(F.length("word") >= head).withColumn("h", F.left("word", F.lit(head)))
    deep = deep.join(asked.where(F.length("token") >= head).select(F.left("token", F.lit(head)).alias("h")).distinct(), "h", "left_semi")
    nodes = None
    for words_, low, high in ((vocabulary, F.lit(1), F.least(F.length("word"), F.lit(head - 1))), (deep, F.lit(head), F.length("word"))):
        node = words_.select("n", "word", F.explode(F.sequence(low, high)).alias("k"))
        node = node.select(F.expr("left(word, k)").alias("token"), F.when(F.col("k") == F.length("word"), F.col("n")).alias("e"), F.when(F.col("k") < F.length("word"), F.col("n")).alias("r"))
        nodes = node if nodes is None else nodes.unionByName(node)
    counted = nodes.groupBy("token").agg(F.coalesce(F.sum("e"), F.lit(0)).alias("ends"), F.coalesce(F.sum("r"), F.lit(0)).alias("runs_on"))
    return counted.join(asked, "token", "left_semi")


def limits(t: DataFrame, least: int = 4, sigmas: float = 6.0, around: int = 20) -> DataFrame:
    """source, n of exact lengths that are frequent beyond chance."""
    n = t.groupBy("source", "n").agg(F.count(F.lit(1)).alias("m"))
    near = F.sum("m").over(Window.partitionBy("source").orderBy("n").rangeBetween(-around, around)) - F.col("m")
    mean = F.col("near") / (2 * around)
    return n.withColumn("near", near).where((F.col("m") >= least) & (F.col("m") >= mean + sigmas * F.sqrt(mean + 1))).select("source", "n")


def _begins(c: str) -> Column:
    """The beginnings of a line, of 1, 4 and 16 characters."""
    return F.filter(F.array(*[F.when(F.length(c) >= k, F.left(c, F.lit(k))) for k in (1, 4, 16)]), lambda x: x.isNotNull())


def headings(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """line, heading: of the last lines asked for (line, a digest, and start, itself), whether each is a heading rather than the start of a
    line that was cut.

    A heading stands in at least two surroundings (copies of one text are one) and text follows it at least as often as it ends a
    text, or else no other line begins with it."""
    own = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = docs.select(own.alias("l")).select(F.explode(F.expr("transform(l, (x, i) -> named_struct('line', x, 'before', xxhash64(get(l, if(i > 0, i - 1, 1))), 'last', i = size(l) - 1))")).alias("x"))
    at = at.select("x.*")
    places = at.select(F.md5("line").alias("line"), "before", "last").join(lines.select("line"), "line", "left_semi").distinct()
    n = places.groupBy("line").agg(F.countDistinct("before").alias("seen"), F.sum((~F.col("last")).cast("int")).alias("followed"), F.sum(F.col("last").cast("int")).alias("ends"))
    n = cut_table(n.where("seen >= 2"))
    doubtful = cut_table(n.where("followed < ends").join(lines, "line").select("line", "start", F.element_at(_begins("start"), -1).alias("c")))
    others = at.where("not last").select(F.col("line").alias("whole"), F.explode(_begins("line")).alias("c"))
    begun = others.join(small(doubtful), "c").where("startswith(whole, start) and whole <> start").select("line").distinct()
    return n.join(begun.withColumn("begun", F.lit(True)), "line", "left").select("line", F.col("begun").isNull().alias("heading"))


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id, source, kind, at_limit, in_word, cut: every document with a text and whether it was cut."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").where(F.length(F.trim("text")) > 0)
    t = cut_table(tails(docs).dropDuplicates(["doc_id"]))
    open_ = t.where("kind in ('open', 'list', 'link', 'row', 'reference')")
    tokens = open_.where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("own"))
    nodes = trie(words(docs), tokens).join(tokens, "token").select("token", F.greatest(F.col("ends") - F.col("own"), F.lit(0)).alias("ends"), "runs_on")
    lines = open_.where("kind = 'open'").groupBy("line").agg(F.first("start").alias("start"))
    heads = headings(docs, lines)
    asked = t.where("kind = 'abbreviation'").select("token").distinct()
    follow = docs.select(F.explode_outer(F.regexp_extract_all("text", F.lit(r"([\p{L}.\-]{1,14}\.\s+[^\s])"), 1)).alias("x"))
    follow = follow.select(F.lower(F.regexp_extract("x", r"^(.*)\.\s+\S$", 1)).alias("token"), F.regexp_extract("x", r"(\S)$", 1).alias("c"))
    follow = follow.join(asked, "token", "left_semi").groupBy("token").agg(F.sum(F.col("c").rlike(r"[\p{Ll}\p{Nd}(\[&,]").cast("int")).alias("mid"), F.count(F.lit(1)).alias("times"))
    suffix = docs.where(F.col("text").rlike(r"[\x{0E00}-\x{0E7F}]")).select(F.explode_outer(F.split("text", r"\s+")).alias("chunk")).select(F.right("chunk", F.lit(5)).alias("token"))
    suffix = suffix.join(t.where("kind = 'thai'").select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("chunks"))
    j = (
        t.join(nodes, "token", "left")
        .join(heads, "line", "left")
        .join(follow, "token", "left")
        .join(suffix, "token", "left")
        .join(limits(t).withColumn("at_limit", F.lit(True)), ["source", "n"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    at_limit = F.coalesce("at_limit", F.lit(False))
    in_word = (F.col("token") != "") & (zero("runs_on") > 0) & (zero("ends") * 20 < zero("runs_on"))
    heading = F.coalesce("heading", F.lit(False))
    verdict = (
        F.when(F.col("kind") == "cut", True)
        .when(F.col("kind") == "whole", False)
        .when(F.col("kind") == "abbreviation", (zero("times") >= 3) & (zero("mid") >= 0.9 * zero("times")))
        .when(F.col("kind") == "number", at_limit)
        .when(F.col("kind") == "thai", at_limit | (zero("chunks") < 2))
        .when(in_word | at_limit, True)
        .otherwise((F.col("kind") == "open") & ~heading)
    )
    return j.select("doc_id", "source", "kind", at_limit.alias("at_limit"), in_word.alias("in_word"), verdict.alias("cut"))


def report(flags: DataFrame) -> DataFrame:
    """source, n_documents, n_cut, share, n_at_limit."""
    s = flags.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.sum((F.col("cut") & F.col("at_limit")).cast("int")).alias("n_at_limit"))
    return s.withColumn("share", F.col("n_cut") / F.col("n_documents"))
