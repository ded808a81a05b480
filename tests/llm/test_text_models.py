import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewatch.llm import langid, quality_cnn, toxicity

RNG = random.Random(8)
SYL = {"aa": "ka lo mi ru te so na".split(), "bb": "zu gri pfo älk üm ßt oe".split()}


def words(lang, n):
    return " ".join("".join(RNG.choices(SYL[lang], k=RNG.randint(1, 3))) for _ in range(n))


def test_language_mixture(spark):
    rows = [(i, words(l, RNG.randint(3, 80)), l) for i, l in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "12 !?", None), (503, words("aa", 120) + " " + words("bb", 80), None), (504, words("bb", 4000), None), (None, words("aa", 20), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs.where("doc_id < 60"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i][0] == l for i, _, l in rows[60:120])
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert got[503][0] == "aa" and 0.5 < got[503][1] < 1.0 and got[504][0] == "bb" and got[None][0] == "aa"
    nothing = langid.fit(docs.where("false"))
    assert langid.predict(docs, nothing).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(docs.where("false"), model).count() == 0


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        text = "".join(RNG.choices("abcxyz", k=n))
        c = quality_cnn.chunks(text)
        seen = bytearray(b"\0" * max(n, 1))
        for k, row in enumerate(c):
            for j, b in enumerate(row.tolist()):
                at = k * quality_cnn.HOP + j
                if at < n:
                    seen[at] = b
        assert bytes(seen[:n]).decode() == text and c.shape[1] == quality_cnn.CHUNK


def test_gradients_match_differences():
    import numpy as np

    net = quality_cnn.Net(3)
    texts, y = [words("aa", 90), words("bb", 5)], np.array([1, 0], np.float32)
    loss = lambda: -sum(np.log(p if t else 1 - p) for p, t in zip(net.score(texts), y, strict=True))
    before = loss()
    net.learn(texts, y, epochs=40)
    assert loss() < before / 3


def test_quality_tells_junk_from_prose(spark):
    rows = [(i, words("aa", 60) if i % 2 else words("aa", 60).upper().replace(" ", "!! "), i % 2) for i in range(160)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, words("aa", 9))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 100] + [(900, 1), (None, 0)], "doc_id long, label int")
    net = quality_cnn.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_cnn.score(docs, net).collect()}
    assert len(got) == 163 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in rows[100:]) >= 58
    assert {r.score for r in quality_cnn.score(docs, quality_cnn.fit(docs, labels.where("label = 1"))).collect()} == {0.5}
    assert quality_cnn.score(docs.where("false"), net).count() == 0


def test_toxicity_finds_unseen_forms(spark):
    stem = ["vrakh", "molg"]
    bad = lambda: words("aa", 20) + f" {RNG.choice(stem)}{RNG.choice(SYL['aa'])}{RNG.choice(SYL['bb'])}, " + words("aa", 20) + f" {RNG.choice(stem)}{RNG.choice(SYL['bb'])}"
    rows = [(i, bad() if i % 4 == 0 else words("aa", 42), int(i % 4 == 0)) for i in range(320)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit(3))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 220] + [(900, 0)], "doc_id long, label int")
    c = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, c).collect()}
    assert len(got) == 322 and sum((got[i] >= 0.7) == bool(y) for i, _, y in rows[220:]) >= 97
    assert 0 <= got[900] < 0.7 and 0 <= got[901] < 0.7
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("label = 0"))).collect()} == {0.0}


def kneser_ney(texts, cls):
    """Brute force over strings: p(last symbol after the others) for n-grams of ORDER symbols."""
    top = [Counter() for _ in texts]
    for c, own in zip(top, texts, strict=True):
        for t in own:
            s = " " * 4 + re.sub("[^a-z]+", " ", t.lower()) + ("" if t[-1:] == " " else " ")
            for k in range(4, len(s)):
                c[s[k - 4 : k + 1]] += 1
    by = {5: top}
    for n in (4, 3):
        by[n] = [Counter(g[1:] for g in c) for c in by[n + 1]]
    for n in (2, 1):
        both = Counter(g[1:] for g in set(by[n + 1][0]) | set(by[n + 1][1]))
        by[n] = [both, both]
    base = 1 / max(2, len(by[1][0]) + 1)

    def p(g):
        q = base
        for n in range(1, 6):
            own = g[5 - n :]
            follow = {x: c for x, c in by[n][cls].items() if x[:-1] == own[:-1]}
            if follow:
                total = sum(follow.values())
                q = max(follow.get(own, 0) - 0.75, 0) / total + 0.75 * len(follow) / total * q
        return q

    return p


def test_kneser_ney_against_brute_force(spark):
    texts = [["Abba bab, ab ab", "ba! abba", "cab a bac"], ["cab abc", "abcab bb"]]
    rows = spark.createDataFrame([(t, y) for y in (0, 1) for t in texts[y]], "text string, y int").repartition(3)
    tables = {o: tuple(toxicity.table_of(x) for x in pair) for o, pair in toxicity.smoothed(toxicity.counts(rows)).items()}
    model = toxicity.Model(tables)
    p0, p1 = kneser_ney(texts, 0), kneser_ney(texts, 1)
    for cls, p in ((0, p0), (1, p1)):
        for h in ("    ", " aba", "ab a", "zzca"):
            assert sum(p(h + c) for c in "abc ") + p(h + "?") == pytest.approx(1, abs=1e-9), cls
    text = "abba cab zab bacc abz ab"
    s = " " * 4 + text + " "
    want = [np.log(p1(s[k : k + 5]) / p0(s[k : k + 5])) for k in range(len(text) + 1)]
    ((f, g),) = toxicity._texts_grams(text)
    assert len(f) == len(text) + 1
    assert model.differences(g) == pytest.approx(want, abs=1e-5)


def test_symbols_do_not_depend_on_chunks(monkeypatch):
    texts = [words("aa", 50), "  x\n\n y!", "q" * 100 + " ", "", None, "1 2", "Привет, мир 漢字", "a" * 33 + " b"]
    join = lambda t: [np.concatenate(x).tolist() if x else [] for x in ([f for f, _ in toxicity._texts_grams(t)], [g for _, g in toxicity._texts_grams(t)])]
    whole = [join(t) for t in texts]
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    for t, w in zip(texts, whole, strict=True):
        assert join(t) == w, t


def test_very_long_text_and_repeated_rows(spark):
    long = "stupid idiot " + words("aa", 400_000)
    docs = spark.createDataFrame([(1, long, 1), (1, long, 2), (2, "a" * 300_000, 3)], "doc_id long, text string, SCORE int")
    train = spark.createDataFrame([(k, words("aa", 30) + (" stupid idiot" if k % 2 else "")) for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, label int")
    got = toxicity.score(docs, toxicity.fit(train, labels))
    assert got.columns == ["doc_id", "text", "score"]
    rows = got.collect()
    assert len(rows) == 3 and rows[0].score == rows[1].score and all(0 <= r.score <= 1 for r in rows)


def test_more_languages_than_any_cap(spark):
    """70 languages are all learned, and a text of five languages shares out in five parts."""
    rng = random.Random(5)
    syl = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(12)] for k in range(70)}
    say = lambda lang, n: " ".join("".join(rng.choices(syl[lang], k=2)) for _ in range(n))
    rows = [(k * 10 + j, say(f"l{k:02}", 60), f"l{k:02}") for k in range(70) for j in range(4)]
    mixed = " ".join([say("l03", 120), say("l64", 60), say("l65", 60), say("l66", 60), say("l67", 60)])
    docs = spark.createDataFrame([*rows, (5000, mixed, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert got[5000][0] == "l03" and 0.28 < got[5000][1] < 0.4


def test_long_documents_are_learned_from(spark):
    """Labelled documents of several hundred chunks take part; a column that clashes in another case is replaced."""
    long = lambda up: (words("aa", 9000).upper() if up else words("aa", 9000))
    docs = spark.createDataFrame([(i, long(i % 2 == 0), 1) for i in range(24)], "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, label int")
    got = quality_cnn.score(docs, quality_cnn.fit(docs, labels))
    assert got.columns == ["doc_id", "text", "score"]
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got.collect())


def test_toxicity_model_holds_every_ngram(spark):
    g = np.unique(np.append(0, np.random.default_rng(5).integers(0, 1 << 60, 50_000)))
    rows = spark.createDataFrame([(int(x), 1, float(k)) for k, x in enumerate(g)], "g long, weight long, value double")
    table = toxicity.table_of(rows)
    seen, value = table.find(g)
    assert seen.all() and (value == np.arange(len(g))).all()
    assert not table.find(g + 1)[0][~np.isin(g + 1, g)].any()
    assert not toxicity.Table(g[1:], value[1:]).find(g[:1])[0].any() and not toxicity.Table(g[:0], value[:0]).find(g)[0].any()


def test_toxicity_scores_do_not_depend_on_what_is_sent(spark):
    rows = [(i, words("aa", 30) + (" vrakhmolg " if i % 4 == 0 else " ") + words("bb", 5), int(i % 4 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 90], "doc_id long, label int")
    want = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    for held in (0, 400):
        c = toxicity.fit(docs, labels, held=held)
        assert c.rest is not None and c.model.rest.any()
        assert sum(t.size for pair in c.model.tables.values() for t in pair) <= held
        got = {r.doc_id: r.score for r in toxicity.score(docs, c).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4
