"""Evaluation passages inside training text, by template canonicalisation.

Texts become streams of letters and digits: look-alike characters to one form, case, spacing, punctuation and line breaks dropped,
and numbers, units and names replaced by typed placeholders. Windows of these templates, thinned to the minima of a rolling hash,
are joined by hash: the items' windows are a table that is as small as the held-out set (checked: at most ``max_windows`` a block,
further items go in further blocks, each against all documents), so the corpus is read in place and never shuffled.
Windows that meet on one diagonal are chained; a pair with enough of them is aligned on the real text, where numbers and names are
themselves again. Then the slots of the passage, numbers and names by their shape, are compared in the aligned words: a passage with
``min_slots`` of them of which fewer than ``min_equal`` agree is no copy. Pairs that agree in the template only are aligned as templates
and reported as re-parameterised if every value is replaced by one value wherever it stands.

An item's windows have the length of its own script; a document is searched for the windows of both lengths, whatever its script is,
so a passage is found in a document mostly of another script too. Only documents without a character of the scripts without spaces
are not searched for the short windows, and only if no item could reach its least count of windows without such characters.

Defined results: null and empty texts hold nothing; repeated rows count once; a document of any length is read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.confusables import skeleton

_number = re.compile(r"\d[\d.,]*")
_unit = re.compile(r"(?<=\d)\s*(?:mm|cm|km|kg|mg|ml|µm|%|°\s?[CF]|hours?|Hz|kHz|MB|GB)(?![A-Za-z])")
_name = re.compile(r"\b[A-Za-z]*[a-z][A-Z][A-Za-z0-9]*\b")  # inner capitals; words in capitals may be any words
_drop = re.compile(r"[\W_]+")
_part = re.compile(r"\d+|[^\W\d_]+|[.!?。！？।؟]")
_dense = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")

K, K_DENSE, WINDOW = 16, 6, 8


def plain_stream(text: str) -> str:
    return _drop.sub("", skeleton(text).lower())


def template_stream(text: str) -> str:
    t = skeleton(text)
    if t.isupper():
        t = t.lower()
    t = _number.sub("0", _unit.sub("u", _name.sub("1", t)))
    return _drop.sub("", t.lower())


def is_dense(stream: str) -> bool:
    """Scripts without spaces take shorter windows."""
    return len(_dense.findall(stream)) > 0.3 * len(stream)


def _rolling(stream: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all windows of k characters, built from halves."""
    base, out, have = 0x100000001B3, None, 0
    part, size = stream, 1
    while True:
        if k & size:
            n = len(stream) - have - size + 1
            out = part[:n] if out is None else out[: n] * np.uint64(pow(base, size, 1 << 64)) + part[have : have + n]
            have += size
        if have == k:
            return out
        part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2


def _extreme(x: np.ndarray, w: int, pick) -> np.ndarray:
    """Sliding minimum or maximum over w (a power of two) values."""
    step = 1
    while step < w:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def window_minima(stream: np.ndarray, k: int, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the minima of each w rolling hashes of k characters."""
    n = len(stream) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _rolling(stream, k)
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    if n <= w:
        at = np.array([int(h.argmin())])
    else:
        pad = np.zeros(w - 1, np.uint64)
        lows = np.concatenate([pad, _extreme(h, w, np.minimum), pad])
        at = np.flatnonzero(_extreme(lows, w, np.maximum) == h)
    return at, h[at]


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Items:
    """The window table of a block of items."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.plain = [plain_stream(r[1]) for r in rows]
        self.tables = {}
        self.spaced = np.zeros(len(rows), np.int64)  # windows of dense items without a dense character
        templates = [template_stream(r[1]) for r in rows]
        self.length = [len(t) for t in templates]
        self.count = np.zeros(len(rows), np.int64)
        for dense, k in ((False, K), (True, K_DENSE)):
            hs, its, ats = [], [], []
            for i, t in enumerate(templates):
                if is_dense(t) == dense:
                    at, h = window_minima(_codes(t), k)
                    self.count[i] = len(at)
                    self.spaced[i] = sum(not _dense.search(t[a : a + k]) for a in at) if dense else 0
                    hs.append(h), its.append(np.full(len(at), i)), ats.append(at)
            h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
            order = np.argsort(h, kind="stable")
            cat = lambda x: (np.concatenate(x) if x else np.empty(0, np.int64))[order]  # noqa: E731, B023
            self.tables[dense] = (h[order], cat(its), cat(ats))
        self.grams = [self._grams(p) for p in self.plain]
        self.template_grams = [self._grams(t) for t in templates]
        self.slots = [slot_places(r[1]) for r in rows]

    @staticmethod
    def _grams(plain: str) -> tuple[int, dict]:
        g = 3 if is_dense(plain) else 8
        at = defaultdict(list)
        for i in range(len(plain) - g + 1):
            at[plain[i : i + g]].append(i)
        return g, dict(at)


def chain(item_at: np.ndarray, doc_at: np.ndarray, pair: np.ndarray, need: np.ndarray, band: int = 96) -> list[tuple[int, int, int, int]]:
    """(pair, distinct item windows, first and last doc place) of diagonal bands with at least need[pair's row] windows.

    pair: one number per item and document; need: the least count, row by row."""
    diagonal = doc_at - item_at + (1 << 27)
    out = []
    for shift in (0, band // 2):
        key = pair * (1 << 24) + (diagonal + shift) // band
        order = np.lexsort((item_at, key))
        k, a, d = key[order], item_at[order], doc_at[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1])]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        n = np.add.reduceat(new.astype(np.int64), starts)
        keep = n >= need[order][starts]
        lo, hi = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
        out += list(zip(pair[order][starts][keep].tolist(), n[keep].tolist(), lo[keep].tolist(), hi[keep].tolist()))
    return out


def passage(gram: int, grams: dict, doc: str, cost: float = 2.5, gap: int = 45) -> tuple[int, int, int, int]:
    """The best local alignment of an item with a doc stream as (item start, item end, doc start, doc end).

    Runs of shared grams are chained over gaps; a gap costs ``cost`` a character, so about three quarters of a passage must be equal
    and it grows through single other words but not through other sentences."""
    open_, blocks = {}, []
    for j in range(len(doc) - gram + 1):
        now = {}
        for i in grams.get(doc[j : j + gram], ()):
            b = open_.get(i - 1)
            if b is None:
                b = [i, j, gram]
                blocks.append(b)
            else:
                b[2] += 1
            now[i] = b
        open_ = now
    best, top = [], (0.0, 0, 0, 0, 0)
    for i, j, n in blocks:
        score, i0, j0 = float(n), i, j
        for s, pi0, pj0, pi, pj in reversed(best):
            gi, gj = i - pi, j - pj
            if gj > 4 * gap and gj > 400:
                break
            if -gram < gi <= gap and -gram < gj <= gap:
                v = s + n + min(gi, gj, 0) - cost * max(gi, gj, 0) * 0.5
                if v > score:
                    score, i0, j0 = v, pi0, pj0
        best.append((score, i0, j0, i + n, j + n))
        if score > top[0]:
            top = best[-1]
    return top[1], top[3], top[2], top[4]


def slot_places(text: str) -> list[tuple[int, int]]:
    """Start and end in the plain stream of the slots of a text: numbers, and names by their shape."""
    t = skeleton(text)
    out, at, begins, capitals = [], 0, True, t.isupper()
    for m in _part.finditer(t):
        word = m.group()
        if word in ".!?。！？।؟":
            begins = True
            continue
        n = len(word.lower())
        if word[0].isdigit() or _name.fullmatch(word) or (word[0].isupper() and not begins and not capitals):
            out.append((at, at + n))
        at, begins = at + n, False
    return out


def slots(item: str, places: list[tuple[int, int]], doc: str) -> tuple[int, float, bool]:
    """Number of slots of an item's passage, share of them that stand equal in the doc's, and whether the others are replaced consistently:
    one value by one value wherever it stands. item, doc: plain streams."""
    blocks = SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks()
    equal, other, consistent = 0, {}, True
    for start, end in places:
        lo = [b + start - a for a, b, n in blocks if a <= start <= a + n]
        hi = [b + end - a for a, b, n in blocks if a <= end <= a + n]
        value = doc[lo[0] : hi[-1]] if lo and hi and lo[0] <= hi[-1] else None
        equal += value == item[start:end]
        consistent &= value is not None and other.setdefault(item[start:end], value) == value
    return len(places), equal / len(places) if places else 1.0, consistent


OUT = "item_id {t}, doc_id bigint, coverage double, template_share double, slots_equal double, consistent boolean, kind string"


def scan(items: Items, min_cover: float, min_share: float, min_slots: int, min_equal: float):
    least = np.maximum(1, np.ceil(min_share * items.count))
    anywhere = bool((items.spaced >= least).any())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for start in range(0, len(pdf), 128):
                part = pdf.iloc[start : start + 128]
                texts = list(part["text"])
                templates = [template_stream(t) for t in texts]
                dense = [anywhere or bool(_dense.search(t)) for t in templates]
                for kind, k in ((False, K), (True, K_DENSE)):
                    table, its, ats = items.tables[kind]
                    own = [r for r, t in enumerate(templates) if len(t) >= k and (dense[r] or not kind)]
                    if not own or not len(table):
                        continue
                    # one stream; each document ends with k characters found nowhere else, so no window spans two
                    lengths = np.array([len(templates[r]) + k for r in own])
                    base = np.r_[0, np.cumsum(lengths)[:-1]]
                    at, h = window_minima(_codes("".join(templates[r] + "\x00" * k for r in own)), k)
                    lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
                    hit = np.flatnonzero(hi > lo)
                    if not len(hit):
                        continue
                    times = (hi - lo)[hit]
                    pos = np.repeat(at[hit], times)
                    entry = np.repeat(lo[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    which = np.searchsorted(base, pos, "right") - 1
                    it, n_items = its[entry], len(items.ids)
                    need = least[it]
                    seen, plains = {}, {}
                    for pair, n, x, y in chain(ats[entry], pos - base[which], which * n_items + it, need):
                        w, i = divmod(pair, n_items)
                        r = own[w]
                        plain = plains.get(r)
                        if plain is None:
                            plain = plains[r] = plain_stream(texts[r])
                        scale = len(plain) / max(1, len(templates[r]))
                        size = len(items.plain[i])
                        f, t = int(max(0, x * scale - 200 - 0.7 * size)), int(y * scale + 200 + 0.7 * size)
                        i0, i1, d0, d1 = passage(*items.grams[i], plain[f:t])
                        cover, copy = (i1 - i0) / max(1, size), True
                        if cover < min_cover:
                            # no copy of the words: perhaps one of the template, with other values in its slots
                            size, copy = items.length[i], False
                            tf, tt = max(0, int(x - 200 - 0.7 * size)), int(y + 200 + 0.7 * size)
                            t0, t1, u0, u1 = passage(*items.template_grams[i], templates[r][tf:tt])
                            cover, back = (t1 - t0) / max(1, size), len(items.plain[i]) / max(1, size)
                            i0, i1, d0, d1, f = int(t0 * back), int(t1 * back), int((tf + u0) * scale), int((tf + u1) * scale), 0
                        if cover < min_cover or (copy, cover) <= seen.get((r, i), ((False, 0.0),))[0]:
                            continue
                        places = [(x - i0, y - i0) for x, y in items.slots[i] if x >= i0 and y <= i1]
                        n_slots, equal, consistent = slots(items.plain[i][i0:i1], places, plain[f + d0 : f + d1])
                        same = copy and not (n_slots >= min_slots and equal < min_equal)
                        if same or (consistent and n_slots):
                            seen[r, i] = ((copy, cover), cover, n / items.count[i], equal, consistent, "copy" if same else "reparameterised")
                    rows += [(items.ids[i], part["doc_id"].iloc[r], *v[1:]) for (r, i), v in seen.items()]
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "coverage", "template_share", "slots_equal", "consistent", "kind"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", min_cover: float = 0.4, min_share: float = 0.12, max_windows: int = 2_000_000, min_slots: int = 4, min_equal: float = 0.4) -> DataFrame:
    """item_id, doc_id, coverage (of the item by one passage), template_share, slots_equal, consistent, kind (copy or reparameterised)."""
    wanted = items.select(item_col, text_col).where(F.length(F.trim(text_col)) > 0).dropDuplicates([item_col])
    corpus = docs.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    schema = OUT.format(t=dict(items.dtypes)[item_col])
    out = None
    block: list[tuple] = []
    size = 0
    blocks = []
    for row in wanted.toLocalIterator():  # the held-out set, in blocks of bounded size
        block.append((row[0], row[1]))
        size += len(row[1])
        if size > max_windows:
            blocks.append(block)
            block, size = [], 0
    for b in [*blocks, block]:
        found = corpus.mapInPandas(scan(Items(b), min_cover, min_share, min_slots, min_equal), schema) if b or out is None else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    best = F.max(F.struct((F.col("kind") == "copy").alias("copy"), "coverage", "template_share", "slots_equal", "consistent", "kind")).alias("m")
    return out.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", *[F.col(f"m.{c}") for c in ("coverage", "template_share", "slots_equal", "consistent", "kind")])
