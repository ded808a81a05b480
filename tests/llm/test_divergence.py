import random
from collections import Counter, defaultdict

from tapewatch.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, slab string"


def plain(rows, least=10, top=10):
    def terms(text):
        out, word = [], ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z":
                c = chr(ord(c) + 32)
            if "a" <= c <= "z" or ord(c) >= 128:
                word += c
            else:
                out += [word] * bool(word)
                word = ""
        return out

    groups, held, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = terms(text)
        groups[lang, source].update(words)
        langs[lang].update(words)
        held[lang].update(set(words))
    kept = {g: sorted(t for t in langs[g] if held[g][t] >= least) for g in {g for g, _ in groups}}

    def p(count, lang):
        total = sum(count[t] for t in kept[lang])
        return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]}

    def f(a, b):
        return (a - b) * (a - b) // (a + b)

    out = []
    for (lang, source), count in groups.items():
        own, whole = p(count, lang), p(langs[lang], lang)
        pairs = []
        for g, s in groups:
            if g == lang and s != source:
                other = p(groups[g, s], lang)
                pairs.append((-sum(f(own[t], other[t]) for t in kept[lang]), s.encode(), s))
        more = [(-f(own[t], whole[t]), t.encode(), t) for t in kept[lang] if count[t] and own[t] > whole[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
            out += [(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def corpus(seed, n=400, sources=6, kinds=150):
    rng = random.Random(seed)
    words = ["The", "the", "été", "naïve", "don't", "a-b", "x1y", "漢字", "STRASSE", "ſ", " "] + ["".join(rng.choices("abcdefg", k=3)) for _ in range(kinds)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights=[1000 / (k + 1) for k in range(len(words))], k=rng.choice([0, 1, 5, 60])))
        source = rng.choice([None, "", "s0", "s0", "s0", *(f"s{k}" for k in range(sources))])
        rows.append((i, None if i % 50 == 7 else text, rng.choice(["en", "en", "de", None, "rare"]) if i % 90 else "one", source, i, "clash"))
    return rows + rows[:9] + [(None, "", "none", "a", 0, None), (None, "lonely", "none", "b", 0, None), (1, "x" * 5000, "en", "s0", 1, "")]


def test_equals_brute_force(spark):
    rows = corpus(1)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_more_sources_than_a_block_and_more_terms_than_a_slab(spark, monkeypatch):
    rows = corpus(2, 900, 150)
    monkeypatch.setattr(divergence, "SLAB", 70)
    monkeypatch.setattr(divergence, "ENTRIES", 500)
    monkeypatch.setattr(divergence, "PART", 40)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=3).collect())) == plain(rows, least=3)


def test_all_bits_of_a_word(spark):
    words = ["".join(chr(97 + (k // 26**i) % 26) for i in range(3)) for k in range(1000)]
    rows = [(i, " ".join(words[:: 1 + i % 7]), "en", f"s{i % 5}", 0, "") for i in range(40)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=1).collect())) == plain(rows, least=1)


def test_no_kept_terms_and_empty_table(spark):
    rows = [(1, "a b", "en", "x", 0, ""), (2, "a c", "en", "y", 0, ""), (3, None, None, None, 0, "")]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, v = 5 * 10**12, 10**13 + 7, 123_457
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    assert df.select(divergence._p(F.col("n"))).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * v)
