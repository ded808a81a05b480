import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import Broadcast, SparkContext

from tapewatch.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, n long, key string"


def plain(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            if any(a == b and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "été", "New", "York", "漢字", "don't", "-", "(x)"] + ["".join(rng.choices("abcd", k=2)) for _ in range(25)]
    fixed = ["New York City", "once upon a time there", "a b a b a b", "in spite of", "strictly increasing sequence of"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choices(words, weights=[90 / (k + 1) for k in range(len(words))])[0] for _ in range(rng.choice([0, 1, 30, 60]))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for p in parts)
        rows.append((i, None if i % 40 == 3 else text, rng.choice(["en", "en", "de", None]), "s", i, "clash"))
    return rows + rows[:5]


@pytest.mark.parametrize(("top", "step", "bits"), [(2000, 50_000, 1 << 20), (7, 3, 1 << 20), (1, 1, 1 << 12)])
def test_equals_brute_force(spark, top, step, bits):
    rows = corpus(top)
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=6, top=top, step=step, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 6, top)


def test_long_texts_are_counted_whole(spark, monkeypatch):
    rng = random.Random(9)
    words = ["ab", "cd", "é", "x" * 70, "x" * 71, "y" * 300]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", ". ", "\n\n"]) for _ in range(2000))
    data = text.encode()
    whole = phrases.Batch(phrases.Coder(1), [("en", data, 0, 0)])
    monkeypatch.setattr(phrases, "PART", 200)
    parts = list(phrases._parts(data))
    assert len(parts) > 50
    cut = phrases.Batch(phrases.Coder(1), [("en", *p) for p in parts])
    for (m, a, h), (_, b, g) in zip(whole.windows(), cut.windows(), strict=True):
        at, there = np.flatnonzero(a), np.flatnonzero(b)
        assert h[at].tolist() == g[there].tolist()
        if m < phrases.LONGEST:
            for one, two in zip(whole.around(at, m), cut.around(there, m), strict=True):
                assert one.tolist() == two.tolist()


def test_equal_hashes_do_not_join_phrases():
    codes = np.array([[1, 2, 1, 3], [5, 5, 5, 5]], np.uint64)
    first, kind = phrases._kinds(np.zeros(4, np.uint64), codes)
    assert codes[:, first][:, kind].tolist() == codes.tolist() and len(first) == 3


def test_empty_and_short(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "one two", "en", "", 0, ""), (2, "", "en", "", 0, ""), (3, None, None, "", 0, ""), (4, " .,\t", "de", "", 0, "")]
    assert phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=1).collect() == [("en", 1, "one two", 1, 1, 1, 2, 2000)]


def test_filters_leave_the_driver_after_each_round(spark, monkeypatch):
    sent, gone = [], []
    broadcast, destroy = SparkContext.broadcast, Broadcast.destroy

    def keep(self, value):
        sent.append(broadcast(self, value))
        return sent[-1]

    def drop(self, *args):
        gone.append(self)
        destroy(self, *args)

    monkeypatch.setattr(SparkContext, "broadcast", keep)
    monkeypatch.setattr(Broadcast, "destroy", drop)
    got = phrases.collocations(spark.createDataFrame([(1, "one two three", "en", None, None, None)], SCHEMA), least=1, top=5, step=1, bits=1 << 15)
    assert len(sent) > 1 and gone == sent
    assert got.where("phrase = 'one two three'").count() == 1
