import random

import numpy as np

from lectern.llm.overlap import chain, common, doi_overlaps, expanded, extended, ordered, records, report, text_links, text_overlaps, units, winnow, Batch, Hashes, minima


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], p + 1 if x == y else max(d[j], d[j - 1])
    return d[-1]


def corpus(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(120)]
    rows = []
    for i in range(260):
        if rows and r.random() < 0.35:
            base = r.choice(rows)[2].split()
            rate = r.choice([0, 0.05, 0.1, 0.15, 0.3])
            t = " ".join(r.choice(words) if r.random() < rate else w.upper() if r.random() < 0.1 else w + r.choice(["", ",", ""]) for w in base)
        else:
            t = " ".join(r.choice(words) for _ in range(r.choice([1, 3, 12, 40, 70])))
        rows.append((i, f"{i % 90:010x}", t, "en"))
    ids = [(f"{k:010x}", r.choice(["train", "train", "test", "valid", None]), "o") for k in range(90)]
    return rows, ids


def test_against_brute_force(spark):
    rows, ids = corpus()
    texts = spark.createDataFrame([(*r, 0) for r in [*rows, rows[3], (900, None, "x", "en"), (901, "0" * 10, None, "en"), (902, "0" * 10, "...", None)]], "text_id bigint, id string, text string, lang string, c int")
    id_map = spark.createDataFrame([*ids, ids[0]], "id string, split string, origin string")
    split = {k: s for k, s, _ in ids}
    want = set()
    for i, a, s, _ in rows:
        for j, b, t, _ in rows:
            if split[a] in ("test", "valid") and split[b] == "train" and i != j:
                x, y = units(s, "en"), units(t, "en")
                if lcs(x, y) >= 0.8 * max(len(x), len(y)):
                    want.add((min(i, j), max(i, j)))
    members, links = text_links(texts, id_map)
    pairs = expanded(members, links)
    got = {(r.first_id, r.second_id) for r in ordered(pairs, "text").collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 20
    each = {r.row: r for r in records(members, links, "text").collect()}
    by = {}
    for r in pairs.collect():
        by.setdefault(r.held_id, []).append(r.coverage)
    assert {k: (len(v), max(v)) for k, v in by.items()} == {k: (r.n_links, r.coverage) for k, r in each.items()}
    source = texts.selectExpr("text_id as row", "id as key", "'s' as source").distinct()
    assert sum(r.n_pairs for r in report(records(members, links, "text"), source, id_map).collect()) == sum(r.n_links for r in each.values())
    assert text_overlaps(texts.where("text_id < 0"), id_map).count() == 0


def test_doi(spark):
    docs = spark.createDataFrame([(1, "a", "10.99000/X.1"), (2, "b", "https://doi.org/10.99000/x.1."), (3, "c", "NA"), (4, "b", None)], "doc_id bigint, id string, doi string")
    ids = spark.createDataFrame([("a", "train", "o"), ("b", "test", "o"), ("c", "valid", "o")], "id string, split string, origin string")
    assert [tuple(r) for r in doi_overlaps(docs, ids).collect()] == [(2, 1)]


def test_parts():
    r = random.Random(3)
    for _ in range(50):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, 40))] for _ in range(2))
        assert common(a, b) == lcs(a, b)
    assert units("Ｐly-Stat, 的 é", "en") == ["ply", "stat", "的", "e"] and units("雨。 が", "ja") == ["雨", "か"]
    p = winnow(Batch(["a b c", "a"], [0, 0], Hashes()), np.zeros(1 << 20, np.uint8), 0.8)
    assert p["text"].tolist() == [1, 0] and len(winnow(Batch([], [], Hashes()), np.zeros(1 << 18, np.uint8), 0.8)) == 0
    for _ in range(50):
        texts = [[r.randrange(9) + 1 for _ in range(r.randint(1, 30))] for _ in range(4)]
        w = r.randint(1, 8)
        want = []
        for t in texts:
            lows = [min(t[i : i + w]) for i in range(max(1, len(t) - w + 1))]
            want += [any(low == x and i <= j < i + w for i, low in enumerate(lows)) for j, x in enumerate(t)]
        m = np.array([len(t) for t in texts])
        got = minima(np.array(sum(texts, []), np.uint64), m, np.concatenate([np.arange(n) for n in m]), w)
        assert got.tolist() == want


def test_chains_and_word_maps():
    r = random.Random(5)
    for _ in range(200):
        a = [r.randrange(30) for _ in range(r.randint(1, 40))]
        b = [x if r.random() < 0.85 else r.randrange(30) for x in a]
        anchors = [(i, i) for i in range(len(a)) if a[i] == b[i] and r.random() < 0.3]
        n = extended(a, b, chain(anchors) if anchors else [])
        assert n <= lcs(a, b) and (anchors == [] or n >= len(anchors))
        m = Batch([" ".join(map(str, x)) for x in (a, b)], [0, 0], Hashes()).maps()
        alone = sum((int(x[0]) & ~int(x[1]) & (1 << 64) - 1).bit_count() for x in m)
        assert len(a) - alone >= lcs(a, b)
    assert chain([(5, 5), (1, 9), (2, 2), (9, 1), (2, 2)]) == [(2, 2), (5, 5)] and chain([]) == []


def test_one_seed_in_longer_texts(spark):
    """Eighty of a hundred words in order, with one run of twelve and other words after every fourth else."""
    words = [f"w{i}" for i in range(100)]
    other = words[:12] + [w if (i % 5) != 4 else f"x{i}" for i, w in enumerate(words[12:], 12)]
    assert common(words, other) >= 80
    texts = spark.createDataFrame([(1, "a", " ".join(words), "en"), (2, "b", " ".join(other), "en")], "text_id bigint, id string, text string, lang string")
    ids = spark.createDataFrame([("a", "train", "o"), ("b", "test", "o")], "id string, split string, origin string")
    assert [(r.held_id, r.train_id) for r in text_overlaps(texts, ids).collect()] == [(2, 1)]


def test_a_common_fingerprint_in_many_salts(spark, monkeypatch):
    """A phrase that all texts begin with is spread over salts, and no link is lost."""
    from lectern.llm import overlap

    monkeypatch.setattr(overlap, "SALT_BITS", 1)
    same = "a phrase of six words here"
    rows = [(i, f"k{i}", f"{same} {' '.join(f'n{i // 2}_{j}' for j in range(3))}", "en") for i in range(80)] + [(100 + i, f"k{i}", same, "en") for i in range(20)]
    texts = spark.createDataFrame(rows, "text_id bigint, id string, text string, lang string")
    ids = spark.createDataFrame([(f"k{i}", "test" if i % 2 else "train", "o") for i in range(80)], "id string, split string, origin string")
    got = {(r.held_id, r.train_id) for r in text_overlaps(texts, ids).collect()}
    assert {(i + 1, i) for i in range(0, 80, 2)} <= got and {(101 + i, 100 + j) for i in range(0, 20, 2) for j in range(0, 20, 2)} <= got


def test_long_texts_of_other_words_end_in_the_join(spark):
    """Texts with one phrase in common: lengths and places allow every pair, the counts of words none; training prints without a partner stay back."""
    from lectern.llm import overlap

    r = random.Random(7)
    text = lambda: " ".join([f"p{i}" for i in range(12)] + [f"w{r.randrange(900)}" for _ in range(288)])
    classes = spark.createDataFrame([(i, text(), 0) for i in range(40)], "c bigint, norm string, dense int")
    level = spark.sparkContext.broadcast(np.zeros(1 << 18, np.uint8))
    held, train = classes.where("c < 20"), classes.where("c >= 20")
    prints = lambda side, *how: side.mapInPandas(overlap._prints(level, 0.8, *how), overlap.PRINTS)
    a, b = prints(held, True), prints(train, False)
    assert a.select("fp").join(b.select("fp"), "fp").count() > 400
    assert overlap.seeds(a, b, 0.8).count() == 0
    known = spark.sparkContext.broadcast(overlap.marks(held, level, 0.8, 20))
    kept, shared = {x.fp for x in prints(train, False, known).collect()}, {x.fp for x in a.join(b.select("fp"), "fp", "left_semi").collect()}
    assert shared <= kept and len(kept) < b.count() / 4


def test_cells_lose_no_seed():
    from lectern.llm.overlap import cells

    r = np.random.default_rng(3)
    for share in (0.6, 0.8, 0.95):
        size = r.integers(1, 300, 40_000)
        other = np.maximum((size * r.uniform(share * 0.9, 1.1 / share, len(size))).astype(np.int64), 1)
        pos = (r.uniform(0, 1, len(size)) * size).astype(np.int64)
        there = np.clip(pos + r.integers(-40, 41, len(size)), 0, other - 1)
        through = np.minimum(pos, there) + np.minimum(size - pos, other - there)
        may = through >= share * np.maximum(size, other) - 1e-6
        i, cell = cells(pos, size, share, True)
        _, its = cells(there, other, share, False)
        met = np.bincount(i[cell == its[i]], minlength=len(size))
        assert may.sum() > 2000 and met[may].min() == 1 and met.max() == 1


def test_maps_count_words():
    r = random.Random(11)
    for _ in range(100):
        a, b = ([r.randrange(40) for _ in range(r.randint(1, 300))] for _ in range(2))
        m = Batch([" ".join(map(str, x)) for x in (a, b)], [0, 0], Hashes()).maps()
        alone = sum((int(x[0]) & ~int(x[1]) & (1 << 64) - 1).bit_count() for x in m)
        assert len(a) - alone >= sum(min(a.count(x), b.count(x)) for x in set(a))
