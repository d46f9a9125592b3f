import random

import numpy as np

from lectern.llm.leakage import Items, chain, leaks, passage, plain_stream, slot_places, slots, template_stream, window_minima

rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]


def text(n):
    return " ".join(rng.choice(WORDS) if rng.random() > 0.1 else str(rng.randint(1, 900)) for _ in range(n))


def test_streams():
    assert plain_stream("Ply-Stat ﬁts\n 3.5 mm!") == plain_stream("plystat fits 35mm")
    assert template_stream("used PavsSona in 12.5 mm, 3 runs") == template_stream("used FenRonic in 7 km, 41 runs")
    at, h = window_minima(np.arange(40, dtype=np.uint64), 16)
    assert len(at) and len(window_minima(np.arange(5, dtype=np.uint64), 16)[0]) == 0


def test_against_planted_passages(spark):
    items = [(i, text(90)) for i in range(20)] + [(90, None), (91, "")]
    rows, want = [], set()
    for d in range(120):
        body = text(200).split()
        if d % 3 == 0:
            i = rng.randrange(20)
            words = items[i][1].split()
            share = rng.choice([0.15, 0.55, 1.0])
            n = int(90 * share)
            start = rng.randrange(91 - n)
            copy = [rng.choice(WORDS) if rng.random() < 0.08 else w for w in words[start : start + n]]
            copy = [w[:2] + "\n" + w[2:] if rng.random() < 0.05 else w.upper() if d % 2 else w for w in copy]
            body[100:100] = copy
            if share > 0.4:
                want.add((i, d))
        rows.append((d, " ".join(body), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (0, rows[0][1], "x"), (502, items[0][1] + " " + text(40_000), "x")]
    want.add((0, 502))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    held = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.item_id, r.doc_id) for r in leaks(docs, held).collect()}
    assert got == want
    in_blocks = {(r.item_id, r.doc_id) for r in leaks(docs, held, max_windows=3000).collect()}
    assert in_blocks == want
    assert leaks(docs, held.where("item_id < 0")).count() == 0 and leaks(docs.where("doc_id < 0"), held).count() == 0


def test_mixed_scripts(spark):
    dense = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(n))
    mixed = " ".join(dense(4) + " " + rng.choice(WORDS) for _ in range(30))
    items = [(0, text(60)), (1, dense(150)), (2, mixed)]
    docs = [(0, dense(2000) + "\n" + items[0][1] + "\n" + dense(2000)), (1, text(400) + "\n" + items[1][1] + "\n" + text(400)), (2, text(300) + "\n" + mixed + "\n" + text(300)), (3, dense(2000) + mixed + dense(2000)), (4, dense(900)), (5, text(300))]
    held = spark.createDataFrame(items, "item_id int, text string")
    got = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), held)
    assert {(r.item_id, r.doc_id) for r in got.where("coverage > 0.95").collect()} == {(0, 0), (1, 1), (2, 2), (2, 3)} == {(r.item_id, r.doc_id) for r in got.collect()}
    assert leaks(spark.createDataFrame(docs[:1], "doc_id bigint, text string"), held.where("item_id > 0")).count() == 0


def test_words_of_a_dense_item_alone(spark):
    """The words of an item of a script without spaces, in a document without one of its characters."""
    words = text(14)
    item = words + "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(60))
    docs = spark.createDataFrame([(1, text(200) + " " + words + " " + text(200)), (2, text(400))], "doc_id bigint, text string")
    assert [r.doc_id for r in leaks(docs, spark.createDataFrame([(7, item)], "item_id int, text string")).collect()] == [1]


def test_slots():
    item = "Tom gave 12 apples to his friend Ann, and Ann gave 12 pears and 7 figs to Tom."
    plain, places = plain_stream(item), slot_places(item)
    check = lambda other: slots(plain, places, plain_stream(other))
    assert [plain[a:b] for a, b in places] == ["12", "ann", "ann", "12", "7", "tom"]
    assert check(item) == check(item.upper().replace(" ", "")) == (6, 1.0, True)
    assert check(item.replace("12", "31").replace("Ann", "Bob")) == (6, 2 / 6, True)
    assert check(item.replace("12", "31", 1))[2] is False and slots("", [], "x") == (0, 1.0, True)


def test_reparameterised_questions_are_told_from_copies(spark):
    ask = lambda a, b, c: f"{a} plates were read in {b} rows of the field by the older of the readers, then {c} more plates were read in {b + 1} rows before the readers went home with {a} plates and {c} notes each, which took {a + c} hours"
    docs = spark.createDataFrame([(1, text(80) + " " + ask(12, 5, 71) + " " + text(80)), (2, text(80) + " " + ask(340, 88, 902) + " " + text(80)), (3, text(200))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in leaks(docs, spark.createDataFrame([(1, ask(12, 5, 71))], "item_id int, text string")).collect()}
    assert set(got) == {1, 2} and got[1].kind == "copy" and got[2].kind == "reparameterised" and got[2].consistent and got[2].slots_equal < 0.4
