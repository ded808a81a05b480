import random

from tapewatch.llm import decontaminate as dc

RNG = random.Random(6)
VOCAB = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 5))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


ITEMS = [
    (0, "Anna has 12 apples and buys 5 more. " + prose(10) + " how many apples does Anna hold"),
    (1, prose(30)),
    (2, "The train of Mr Smith runs 80 km in 2 hours. " + prose(12) + " at 80 km"),
    (3, None), (4, ""), (5, "one two three four five"),
]


def documents():
    a, b, c = (ITEMS[k][1] for k in (0, 1, 2))
    return [
        (10, prose(50) + " " + a + " " + prose(50)),
        (11, b.upper()),
        (12, prose(20) + "\n" + a.replace("12", "31").replace("5 more", "9 more").replace("Anna", "Tom") + " " + prose(9)),
        (13, c.replace("80", "95").replace("2 hours", "3 hours").replace("Smith", "Jones")),
        (14, c.replace("runs 80", "runs 95")),  # the same slot takes two values
        (15, prose(400)), (16, None), (17, ""), (18, " ".join(b.split()[:10]) + " " + prose(40)), (19, prose(20_000) + " " + b),
        (None, b), (20, "x one two three four five y"), (10, prose(5)),
    ]


def test_leaks_and_reparameterised_questions(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(documents(), "doc_id long, text string").selectExpr("*", "1 as hash", "2 as item")
    got = {(r.doc_id, r.item_id): r for r in dc.held_items(docs, items).collect()}
    assert set(got) == {(10, 0), (11, 1), (12, 0), (13, 2), (19, 1), (None, 1), (20, 5)}
    assert got[10, 0].verbatim and got[10, 0].coverage == 1.0 and got[19, 1].verbatim
    assert not got[12, 0].verbatim and not got[13, 2].verbatim


def test_without_the_word_filter_and_empty_tables(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    want = sorted(map(str, dc.held_items(docs, items).collect()))
    monkeypatch.setattr(dc, "WORDS_SENT", 0)
    monkeypatch.setattr(dc, "WINDOWS_SENT", 0)
    assert sorted(map(str, dc.held_items(docs, items).collect())) == want
    assert dc.held_items(docs.where("false"), items).count() == 0
    assert dc.held_items(docs, items.where("false")).count() == 0


def test_windows_equal_brute_force():
    canon = dc.Canon()
    text = documents()[0][1]
    pieces, forms = canon.forms(text)
    got = list(dc.windows(1, pieces, forms, [8]))
    assert len([g for g in got if g[1] == 0]) == sum((forms[0][p : p + 8] > dc.NAME).sum() >= dc.LITERALS for p in range(len(pieces) - 7))
    again = {g[4] for g in dc.windows(2, *canon.forms(text.replace("12", "77")), [8]) if g[1] == 0}
    assert {g[4] for g in got if g[1] == 0} == again


def test_opening_names_are_slots(spark):
    items = [(0, "Tom has 12 apples. Sara buys 5 more apples. Tom gives 3 to Sara."), (1, "Anna walks slowly to the old mill."), (2, "The red cart holds 7 stones. It rolls down the long hill. There it stops at the 3 gates.")]
    docs = [
        (0, "xx yy. Kim has 31 apples. Lee buys 9 more apples. Kim gives 4 to Lee. zz"),
        (1, "So it goes. Bertha walks slowly to the old mill. Then"),
        (2, "Question: Kim has 31 apples. Lee buys 9 more apples. Kim gives 4 to Lee."),
        (3, "Kim has 31 apples. Lee buys 9 more apples. Lee gives 4 to Lee."),  # two names become one
        (4, items[2][1].replace("There it", "It")),  # openers changed without being names: the other windows count
        (5, "They walks quickly to the old mill."),
    ]
    got = {(r.doc_id, r.item_id): r.verbatim for r in dc.held_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k for k in got if k[0] != 3} == {(0, 0), (1, 1), (2, 0), (4, 2)} and not got[0, 0]


def test_items_without_a_literal_window(spark, monkeypatch):
    han = "小明有十二个苹果他又买了五个苹果现在一共有多少个"
    items = [(0, "12 + 45 * 3 - 7 / 2 = 140 and 9 8 7 6 5"), (1, "blue heron"), (2, han), (3, "ราคาของแอปเปิลสามผลคือเท่าไร"), (4, "7 9"), (None, "red fox")]
    docs = [
        (0, "xx 12 + 45 * 3 - 7 / 2 = 140 and 9 8 7 6 5 yy"), (1, "xx 13 + 46 * 4 - 8 / 3 = 141 and 8 7 6 5 4 yy"), (2, "a Blue heron flew"), (3, "heron blue and red fox"),
        (4, "前文" + han + "。后文"), (5, "เขาถามว่าราคาของแอปเปิลสามผลคือเท่าไรครับ"), (6, "7 8 9"), (7, "at 7 9."), (8, None),
    ]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 0), (2, 1), (4, 2), (5, 3), (7, 4)}
    got = dc.held_items(*frames).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.verbatim for r in got)
    monkeypatch.setattr(dc, "WORDS_SENT", 0)
    monkeypatch.setattr(dc, "WINDOWS_SENT", 0)
    assert {(r.doc_id, r.item_id) for r in dc.held_items(*frames).collect()} == want


def test_sieve_leaves_every_window():
    """Windows of sieved texts equal those of whole texts, hashes and places alike."""
    rng = random.Random(6)
    items = ["the cat Anna sat on 12 kg mats, and Mr. Bob ran.", "ein Größe über straße naïve café thé tea No. 7", "Élan vital: $5 for 3 cats - now!", "a b c d e f g h"]
    vocabulary = frozenset(w.lower() for x in items for p in x.split() for w in dc.parts_of(p) if w not in ".!?")
    pool = [w for x in items for w in x.split()] + ["Zed", "unknown", "other", "-", "...", "4,5", "well-known", "日本", "x\u00a0y", "Über", "SAT", "kg", "mr"]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choices(pool, weights=[3] * (len(pool) - 13) + [1] * 13, k=rng.randint(0, 120))) for _ in range(300)] + ["", " ", items[0]]
    for sizes in ([8], [4, 5, 8]):
        sieve, canon = dc.Sieve(vocabulary, min(sizes)), dc.Canon(vocabulary)
        found = 0
        for text, parts in zip(texts, sieve.stretches([t.encode() for t in texts]), strict=True):
            whole = sorted((f, n, h, tuple(s)) for _, f, _, n, h, s in dc.windows(1, *canon.forms(text), sizes))
            own = sorted((f, n, h, tuple(s)) for _, t in parts for _, f, _, n, h, s in dc.windows(1, *canon.forms(t), sizes))
            assert own == whole, text
            found += len(own)
        alone = sorted((k, f, p, n, h, tuple(s)) for k, parts in enumerate(sieve.stretches([t.encode() for t in texts])) for first, t in parts for _, f, p, n, h, s in dc._found(canon, [(k, first, t)], sizes, sizes, None))
        parts = [(k, first, t) for k, parts in enumerate(sieve.stretches([t.encode() for t in texts])) for first, t in parts]
        assert sorted((k, f, p, n, h, tuple(s)) for k, f, p, n, h, s in dc._found(canon, parts, sizes, sizes, None)) == alone
        assert found > 500
