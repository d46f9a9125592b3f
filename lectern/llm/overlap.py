"""Same or near-same records across splits, by winnowing fingerprints.

Texts become sequences of words (characters in Chinese, Japanese and Thai) without case, punctuation, spacing and look-alike
characters. Exact copies collapse to classes, numbered and kept as one table; everything after works on one representative of a
class. Of each window of rolling hashes over five words the minimum is kept, in the order of rarity: a count sketch, filled from all
texts, puts common phrases last. Fingerprints of evaluation classes are joined to those of training classes; a bitmap of the former
keeps back what has no partner, and what is common in spite of all is spread over cells of lengths and places, which only meet where
both allow an alignment through the seed, and over as many salts as its count asks for. A fingerprint carries its class's length and
counts of its words, from which follows, inside the join, how many words at least are without a partner: pairs that can't reach
``share`` end there, or when their words are counted in full, and no other pair does. The seeds of a pair are chained in order on both
sides, the chain is extended by alignment between and around its seeds, and where that falls short the texts are aligned in full
(longest common subsequence). Every other pair with one seed is aligned, so all that is reported is exact, and what can be missed is
only a pair without a single seed.

Two texts that share a run of window + k - 1 words always meet. Texts of a few sentences, of which one word in five may differ and leave
no run of five, are also fingerprinted by two words (three characters) in windows of three, so that a common run of four words
suffices. Which lists a text is in follows from its length with a margin of ``share`` on both sides, so two texts whose lengths allow
an overlap always have a list in common.

Defined results: null texts and texts without words meet nothing; repeated rows count once; an id with several splits counts in
each; an id with several texts is a record with each of them; texts shorter than five words have one fingerprint; texts of any length
are read whole; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.confusables import skeleton
from lectern.llm.keys import corpus_key, doi_key
from lectern.llm.leakage import _rolling
from lectern.session import cut_table

_word = re.compile(r"[^\W_]+")
_dense = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
DENSE_LANGS = ("zh", "ja", "th")
K, K_DENSE, WINDOW = 5, 10, 8
SHORT, SHORT_DENSE, K_SHORT, K_SHORT_DENSE, WINDOW_SHORT = 32, 60, 2, 3, 3
#: buckets of the sketch, as a power of two: one for each class of texts within these bounds (a byte each)
SKETCH_BITS = (18, 24)
#: a fingerprint is spread once so many classes hold it, as a power of two: over cells, and in them over one salt for each so many times CELLS
SALT_BITS, CELLS = 12, 16
#: bits of the map of evaluation fingerprints, as a power of two: a few hundred for each class within these bounds
MARK_BITS = (18, 27)
#: counts of a class's words: so many times 64 counters up to seven
GROUPS = 2


def units(text: str, lang: str | None) -> list[str]:
    """The words of a text, or its characters."""
    t = skeleton(text).lower()
    words = _word.findall(t)
    dense = lang in DENSE_LANGS if lang else len(_dense.findall(t)) > 0.3 * len(t)
    return list("".join(words)) if dense else words


def common(a, b) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for w in b:
        u = v & at.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Hashes(dict):
    """64-bit hashes of words, kept for the next time they occur."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _words(norm: str, dense: int) -> list[str]:
    return list(norm) if dense else norm.split(" ")


class Batch:
    """The words of many texts as one array of hashes: n words of each text, from ``start`` on."""

    def __init__(self, norms, dense, known: Hashes):
        words = [list(map(known.__getitem__, _words(x, d))) for x, d in zip(norms, dense)]
        self.dense = np.asarray(dense, np.int64)
        self.n = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.hashes = np.array([h for w in words for h in w], np.uint64)

    def maps(self) -> tuple[np.ndarray, ...]:
        """Counts of each text's words by hash, in GROUPS x 64 counters: a bit of each counter from one on, from two on and so on to seven.
        A bit set in one text's maps only stands for at least one word without a partner."""
        n, size = len(self.n), 64 * GROUPS
        at = np.repeat(np.arange(n), self.n) * size + (self.hashes % np.uint64(size)).astype(np.int64)
        count = np.bincount(at, minlength=n * size).reshape(n, size)
        return tuple(x for i in range(1, 8) for x in np.packbits(count >= i, axis=1, bitorder="little").view("<i8").T)

    def lists(self, share: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(k, window, texts) of the list of longer and that of short texts, by kind; texts shorter than k words go by all they have."""
        for short in (False, True):
            for d in (0, 1):
                border = SHORT_DENSE if d else SHORT
                mine = (self.dense == d) & (self.n > 0) & ((self.n <= border / share) if short else (self.n >= border * share))
                k0 = (K_SHORT_DENSE if d else K_SHORT) if short else K_DENSE if d else K
                for k in range(1, k0 + 1):
                    at = np.flatnonzero(mine & ((self.n >= k0) if k == k0 else (self.n == k)))
                    if len(at):
                        yield k, WINDOW_SHORT if short else WINDOW, at

    def grams(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of k words of the texts ``at``, one text after the other; the number of runs of each and the place of each."""
        m = self.n[at] - k + 1
        place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        h = _rolling(self.hashes + np.uint64(k), k)[np.repeat(self.start[at], m) + place]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29)), m, place


def minima(order: np.ndarray, m: np.ndarray, place: np.ndarray, w: int) -> np.ndarray:
    """Which runs are the least of a window of w, or of all where there are fewer. order: runs of all texts; m: their numbers by text."""
    wide = np.cumsum(m + w - 1) - (m + w - 1)
    at = np.repeat(wide, m) + place
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    x = np.full(int((m + w - 1).sum()) + w - 1, top)
    x[at] = order
    low = x[: len(x) - w + 1].copy()
    for i in range(1, w):
        np.minimum(low, x[i : len(x) - w + 1 + i], out=low)
    windows = np.zeros(len(low) + w - 1, np.uint64)  # 0 where no window begins
    begins = place <= np.repeat(np.maximum(m - w, 0), m)
    windows[at[begins] + w - 1] = low[at[begins]]
    best = windows[w - 1 :].copy()
    for i in range(1, w):
        np.maximum(best, windows[w - 1 - i : len(windows) - i], out=best)
    return best[at] == order


FORMS = "row bigint, key string, cls binary, dense int, norm string"


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for row, key, text, lang in zip(pdf["row"], pdf["key"], pdf["text"], pdf["lang"]):
            w = units(text, lang)
            if w:
                dense = int(len(w) > 1 and max(map(len, w)) == 1)
                norm = ("" if dense else " ").join(w)
                rows.append((row, key, xxhash.xxh3_128_digest(norm) + bytes([dense]), dense, norm))
        yield pd.DataFrame(rows, columns=["row", "key", "cls", "dense", "norm"])


def _sketch(share: float, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, known = np.zeros(1 << bits, np.int64), Hashes()
        for pdf in batches:
            texts = Batch(pdf["norm"], pdf["dense"], known)
            for k, _, at in texts.lists(share):
                total += np.bincount((texts.grams(k, at)[0] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    return run


def rarity(classes: DataFrame, share: float, n_classes: int) -> np.ndarray:
    """log2 of the counts of fingerprints by bucket: one byte each; their number follows that of the classes within SKETCH_BITS."""
    bits = min(max(math.ceil(math.log2(n_classes + 1)), SKETCH_BITS[0]), SKETCH_BITS[1])
    n = classes.select("norm", "dense").mapInPandas(_sketch(share, bits), "bucket int, n bigint").groupBy("bucket").agg(F.ceil(F.log2(F.sum("n") + 1)).cast("int").alias("n"))
    return _filled(n, np.zeros(1 << bits, np.uint8))


def _filled(cells: DataFrame, out: np.ndarray) -> np.ndarray:
    """cells: bucket, n (32 bits at most). Sent in blocks of 4,096 buckets."""
    code = F.collect_list((F.col("bucket") % 4096).cast("bigint") * (1 << 32) + F.col("n"))
    for row in cells.groupBy((F.col("bucket") / 4096).cast("int").alias("b")).agg(code.alias("x")).toLocalIterator():
        x = np.array(row.x)
        out[row.b * 4096 + (x >> 32)] = x & 0xFFFFFFFF
    return out


def winnow(texts: Batch, level: np.ndarray, share: float) -> pd.DataFrame:
    """text, pos, fp, level of the rarest fingerprint of each window; ties by hash, then the first place."""
    shift, parts = np.uint64(64 - (len(level).bit_length() - 1)), []
    for k, w, at in texts.lists(share):
        h, m, place = texts.grams(k, at)
        own = level[(h >> shift).astype(np.int64)]
        keep = minima((own.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)), m, place, w)
        parts.append(pd.DataFrame({"text": np.repeat(at, m)[keep], "pos": place[keep], "fp": h[keep].astype(np.int64), "level": own[keep]}))
    return pd.concat(parts).drop_duplicates(["text", "fp"]) if parts else pd.DataFrame({"text": [], "pos": [], "fp": [], "level": []}, dtype="int64")


def _marks(level, share: float, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, known = np.zeros(1 << bits, bool), Hashes()
        for pdf in batches:
            fp = winnow(Batch(pdf["norm"], pdf["dense"], known), level.value, share)["fp"].to_numpy(np.int64)
            seen[fp.view(np.uint64) >> np.uint64(64 - bits)] = True
        words = np.packbits(seen, bitorder="little").view("<u4")
        at = np.flatnonzero(words)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": words[at].astype(np.int64)})

    return run


def marks(held: DataFrame, level, share: float, n_held: int) -> np.ndarray:
    """A bit for each fingerprint of evaluation classes, by its first bits, in words of 32; a fingerprint without one has no partner."""
    bits = min(max(math.ceil(math.log2(256 * n_held + 1)), MARK_BITS[0]), MARK_BITS[1])
    n = held.select("norm", "dense").mapInPandas(_marks(level, share, bits), "bucket int, n bigint").groupBy("bucket").agg(F.bit_or("n").alias("n"))
    return _filled(n, np.zeros(1 << bits - 5, np.uint32))


def marked(fp: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = fp.view(np.uint64) >> np.uint64(64 - (len(words).bit_length() + 4))
    return words[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1) > 0


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which number, of all numbers from first to last."""
    n = last - first + 1
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]


def cells(pos: np.ndarray, size: np.ndarray, share: float, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprint, and its cell: lengths within a factor of ``share``, places within the words that may be left over. With every,
    all cells that hold a fingerprint with which a text of this length may be aligned through this place."""
    by, ahead = -math.log(share), 1 - share
    length = lambda x: np.floor(np.log(x) / by).astype(np.int64)
    i, q = _spans(length(size * share * (1 - 1e-9)), length(size / share * (1 + 1e-9))) if every else (np.arange(len(pos)), length(size))
    most = ahead * np.exp((q + 1) * by) * (1 + 1e-9)  # words left over in the longest text of these
    width = np.ceil(most).astype(np.int64)
    p = pos[i].astype(np.int64)
    if every:
        j, slot = _spans(np.maximum(p - np.ceil(ahead * size[i] + 1e-6).astype(np.int64), 0) // width, (p + width) // width)
        i, q = i[j], q[j]
    else:
        slot = p // width
    return i, (q + 128) << 48 | slot << 16  # q is below 0 for the shortest


PRINTS = "fp bigint, salt bigint, c bigint, pos int, size int, " + ", ".join(f"{x}{i} bigint" for x in "xyz" for i in range(GROUPS))


def _prints(level, share: float, every_salt: bool, partners=None):
    """Fingerprints of classes that may have partners, in one cell and at one salt each, or repeated for all where they may meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for pdf in batches:
            texts = Batch(pdf["norm"], pdf["dense"], known)
            if not len(texts.n):
                continue
            p, c = winnow(texts, level.value, share), pdf["c"].to_numpy()
            if partners is not None:
                p = p[marked(p["fp"].to_numpy(np.int64), partners.value)]
            t, pos, high = p["text"].to_numpy(np.int64), p["pos"].to_numpy(np.int64), np.maximum(p["level"].to_numpy(np.int64) - SALT_BITS, 0)
            few, many = np.flatnonzero(high == 0), np.flatnonzero(high > 0)
            i, cell = cells(pos[many], texts.n[t[many]], share, every_salt)
            i, cell = np.concatenate([few, many[i]]), np.concatenate([np.zeros(len(few), np.int64), cell])
            salts = np.maximum((1 << high[i]) // CELLS, 1)
            if every_salt:
                j, salt = _spans(np.zeros(len(i), np.int64), salts - 1)
                i, cell = i[j], cell[j]
            else:
                salt = c[t[i]] % salts
            t, m = t[i], np.array(texts.maps()).reshape(7, GROUPS, -1)
            bits = {"x": m[3], "y": (m[1] ^ m[3]) | m[5], "z": (m[0] ^ m[1]) | (m[2] ^ m[3]) | (m[4] ^ m[5]) | m[6]}
            out = {"fp": p["fp"].to_numpy()[i], "salt": cell + salt, "c": c[t], "pos": pos[i].astype(np.int32), "size": texts.n[t].astype(np.int32)}
            yield pd.DataFrame(out | {f"{x}{k}": bits[x][k][t] for x in bits for k in range(GROUPS)})

    return run


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of seeds that rises on both sides."""
    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    ends, at, back = [], [], []  # of chains of each length: the least last place, its seed; the seed before each
    for i, (_, y) in enumerate(seeds):
        k = bisect_left(ends, y)
        back.append(at[k - 1] if k else -1)
        ends[k : k + 1], at[k : k + 1] = [y], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def extended(a: list[str], b: list[str], anchors: list[tuple[int, int]]) -> int:
    """Words in common order along a chain: each seed is run on while words agree, what lies between is aligned."""
    total, x, y = 0, 0, 0
    for i, j in [*anchors, (len(a), len(b))]:
        if i < x or j < y:  # inside the run of an earlier seed
            continue
        total += common(a[x:i], b[y:j])
        x, y = i, j
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y, total = x + 1, y + 1, total + 1
    return total


def _aligned(share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b, na, nb, d, seeds in zip(pdf["a"], pdf["b"], pdf["norm_a"], pdf["norm_b"], pdf["dense"], pdf["seeds"]):
                wa, wb = _words(na, d), _words(nb, d)
                longer = max(len(wa), len(wb))
                if (Counter(wa) & Counter(wb)).total() < share * longer - 1e-9:
                    continue
                n = extended(wa, wb, chain([(s >> 32, s & 0xFFFFFFFF) for s in seeds.tolist()]))
                if n < share * longer - 1e-9:
                    n = common(wa, wb)
                if n >= share * longer - 1e-9:
                    rows.append((a, b, n / longer))
            yield pd.DataFrame(rows, columns=["a", "b", "coverage"])

    return run


def alone(s: str, t: str) -> Column:
    """Words of one side, at least, that have no partner on the other: see Batch.maps, of which a counter's three binary digits are sent."""

    def maps(side: str) -> list[Column]:
        out = []
        for i in range(GROUPS):
            x, y, z = (F.col(f"{d}{i}_{side}") for d in "xyz")
            out += [x.bitwiseOR(y).bitwiseOR(z), x.bitwiseOR(y), x.bitwiseOR(y.bitwiseAND(z)), x, x.bitwiseAND(y.bitwiseOR(z)), x.bitwiseAND(y), x.bitwiseAND(y).bitwiseAND(z)]
        return out

    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in zip(maps(s), maps(t))])


def seeds(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """a (evaluation), b (training), seeds (places on both sides, in one number) of the pairs that lengths and words allow."""
    side = lambda p, s: p.select("fp", "salt", *[F.col(x).alias(f"{x}_{s}") for x in p.columns if x not in ("fp", "salt")])
    longer = F.greatest("size_a", "size_b")
    through = F.least("pos_a", "pos_b") + F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    need = share * longer - 1e-6
    j = side(a, "a").join(side(b, "b"), ["fp", "salt"])
    j = j.where((F.least("size_a", "size_b") >= need) & (through >= need) & (F.col("c_a") != F.col("c_b")) & (F.col("size_a") - alone("a", "b") >= need))
    return j.groupBy(F.col("c_a").alias("a"), F.col("c_b").alias("b")).agg(F.collect_list(F.shiftleft(F.col("pos_a").cast("bigint"), 32) + F.col("pos_b")).alias("seeds"))


def near_classes(classes: DataFrame, share: float = 0.8) -> DataFrame:
    """a (holds evaluation rows), b (holds training rows), coverage. classes: c, norm, dense, train, held; a written table."""
    level = classes.sparkSession.sparkContext.broadcast(rarity(classes, share, classes.count()))  # at most 2^24 bytes
    held = classes.where("held")
    partners = classes.sparkSession.sparkContext.broadcast(marks(held, level, share, held.count()))  # at most 2^27 bits
    prints = lambda f, every, known: classes.where(f).select("c", "norm", "dense").mapInPandas(_prints(level, share, every, known), PRINTS)
    text = lambda s, f: classes.where(f).select(F.col("c").alias(s), F.col("norm").alias(f"norm_{s}"), *([F.col("dense")] if s == "a" else []))
    both = seeds(prints("held", True, None), prints("train", False, partners), share).join(text("b", "train"), "b").join(text("a", "held"), "a")
    return both.select("a", "b", "norm_a", "norm_b", "dense", "seeds").mapInPandas(_aligned(share), "a bigint, b bigint, coverage double")


def splits_of(id_map: DataFrame) -> DataFrame:
    """key, held: false for train, true for valid and test; split."""
    s = id_map.select(corpus_key(F.col("id")).alias("key"), F.lower(F.trim("split")).alias("split"), "origin").where("key is not null and split in ('train', 'valid', 'test')")
    return s.select("key", "split", "origin", (F.col("split") != "train").alias("held")).distinct()


def text_links(texts: DataFrame, id_map: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """members (row, c, train, held) of classes of equal texts, and links (a, b, coverage) between an evaluation and another training class."""
    src = texts.select(F.col("text_id").cast("bigint").alias("row"), corpus_key(F.col("id")).alias("key"), "text", F.lower(F.trim("lang")).alias("lang")).where("text is not null and key is not null and row is not null")
    forms = cut_table(src.mapInPandas(_forms, FORMS))
    side = splits_of(id_map).groupBy("key").agg(F.bool_or("held").alias("held"), F.bool_or(~F.col("held")).alias("train"))
    rows = forms.select("row", "key", "cls").distinct().join(side, "key").groupBy("row", "cls").agg(F.bool_or("train").alias("train"), F.bool_or("held").alias("held"))
    found = rows.groupBy("cls").agg(F.min("row").alias("row"), F.bool_or("train").alias("train"), F.bool_or("held").alias("held"))
    numbered = cut_table(found.withColumn("c", F.monotonically_increasing_id()))  # written, so the numbers stay
    members = cut_table(rows.select("row", "cls", "train", "held").join(numbered.select("cls", "c"), "cls").drop("cls"))
    first = forms.select("row", "cls", "dense", "norm").dropDuplicates(["row", "cls"])
    classes = cut_table(first.join(numbered, ["row", "cls"]).select("c", "norm", "dense", "train", "held"))
    return members, near_classes(classes, share)


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """held_id, train_id, coverage of all rows of linked and of equal classes."""
    same = members.groupBy("c").agg(F.bool_or("held").alias("h"), F.bool_or("train").alias("t")).where("h and t")
    all_links = links.unionByName(same.select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("coverage")))
    held = members.where("held").select(F.col("row").alias("held_id"), F.col("c").alias("a"))
    train = members.where("train").select(F.col("row").alias("train_id"), F.col("c").alias("b"))
    return all_links.join(held, "a").join(train, "b").where("held_id <> train_id").select("held_id", "train_id", "coverage").distinct()


def text_overlaps(texts: DataFrame, id_map: DataFrame, share: float = 0.8) -> DataFrame:
    """held_id, train_id, coverage of texts that overlap across splits."""
    return expanded(*text_links(texts, id_map, share))


def doi_members(documents: DataFrame, id_map: DataFrame) -> DataFrame:
    """row, c (the DOI), train, held."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("row"), corpus_key(F.col("id")).alias("key"), doi_key(F.col("doi")).alias("c")).where("c is not null and row is not null").distinct()
    sided = docs.join(splits_of(id_map).select("key", "held").distinct(), "key")
    return sided.groupBy("row", "c").agg(F.bool_or(~F.col("held")).alias("train"), F.bool_or("held").alias("held"))


def doi_overlaps(documents: DataFrame, id_map: DataFrame) -> DataFrame:
    """held_id, train_id of documents with the same DOI across splits."""
    m = doi_members(documents, id_map)
    held, train = m.where("held").select(F.col("row").alias("held_id"), "c"), m.where("train").select(F.col("row").alias("train_id"), "c")
    return held.join(train, "c").where("held_id <> train_id").select("held_id", "train_id").distinct()


def ordered(pairs: DataFrame, kind: str) -> DataFrame:
    lo: Column = F.least("held_id", "train_id")
    return pairs.select(F.lit(kind).alias("row_kind"), lo.alias("first_id"), F.greatest("held_id", "train_id").alias("second_id")).distinct()


def records(members: DataFrame, links: DataFrame | None, kind: str) -> DataFrame:
    """row_kind, row, n_links, coverage (the greatest) of every evaluation record that overlaps with training; from the sizes of
    classes, so copies are never multiplied out."""
    train = F.col("train").cast("bigint")
    size = members.groupBy("c").agg(F.sum(train).alias("n"))
    own = members.where("held").join(size, "c").select("row", (F.col("n") - train).alias("n"), F.lit(1.0).alias("coverage"))
    if links is not None:
        near = links.join(size.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.sum("n").alias("n"), F.max("coverage").alias("coverage"))
        own = own.unionByName(members.where("held").join(near, F.col("c") == F.col("a")).select("row", "n", "coverage"))
    g = own.where("n > 0").groupBy("row").agg(F.sum("n").alias("n_links"), F.max("coverage").alias("coverage"))
    return g.select(F.lit(kind).alias("row_kind"), "row", "n_links", "coverage")


def report(found: DataFrame, rows: DataFrame, id_map: DataFrame) -> DataFrame:
    """row_kind, split, source, n_records, n_pairs, mean_coverage of evaluation rows that overlap. found: see records. rows: row, key, source."""
    own = found.join(rows, "row").join(splits_of(id_map).where("held").select("key", "split"), "key").select("row_kind", "row", "split", "source", "n_links", "coverage").distinct()
    return own.groupBy("row_kind", "split", "source").agg(F.countDistinct("row").alias("n_records"), F.sum("n_links").alias("n_pairs"), F.avg("coverage").alias("mean_coverage"))
