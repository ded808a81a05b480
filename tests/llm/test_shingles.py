import random
import re

import corpus_pipeline
from tapewatch.llm import shingles

RNG = random.Random(11)
VOCAB = ["".join(RNG.choices("abcdefghij", k=RNG.randint(3, 8))) for _ in range(3000)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(texts):
    """Smallest member of each component of pairs with Jaccard >= 0.8."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def edited(text, k):
    w = text.split()
    for at in RNG.sample(range(len(w)), k):
        w[at] = RNG.choice(VOCAB)
    return " ".join(w)


def planted():
    out = [None, "", "One two", "one TWO", "one two three"]
    for n in (40, 60, 100, 150, 400, 3000):
        for _ in range(6):
            base = " ".join(RNG.choices(VOCAB, k=n))
            out += [base, edited(base, 1), edited(base, 2), edited(base, n // 40 + 1), edited(base, n // 12), base.upper()]
    passage = " ".join(RNG.choices(VOCAB, k=60))  # common, but no copy
    out += [passage + " " + " ".join(RNG.choices(VOCAB, k=40)) for _ in range(30)]
    return out


def test_stage_drops_planted_edits_like_brute_force(spark):
    texts = planted()
    want = survivors(texts)
    assert len(want) < len(texts) - 80
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.doc_id for r in shingles.without_copies(docs, crowded=1).collect()} == want
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_stage_rows_without_an_id_or_with_a_shared_one(spark):
    a, b, c = (" ".join(RNG.choices(VOCAB, k=80)) for _ in range(3))
    rows = [(5, a), (None, edited(a, 1)), (None, b), (None, edited(b, 1)), (None, b), (7, c), (7, a), (9, edited(c, 1))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [5, 7, 7]
    assert len([r for r in got if r.doc_id is None]) == 1


def test_stage_takes_its_first_pairs_from_the_fingerprints(spark, monkeypatch):
    base = " ".join(RNG.choices(VOCAB, k=3000))
    # a chorus fills both fingerprints, while the sets of shingles hardly meet
    chorus = " ".join("the same seven words come back again".split() * 300)
    texts = [base, edited(base, 1), *(f"{chorus} {' '.join(RNG.choices(VOCAB, k=40))}" for _ in range(2))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS)
    verified, seen = shingles.verified, []

    def spy(pairs, *rest):
        near = verified(pairs, *rest)
        seen.append((pairs.count(), near.count()))
        return near

    monkeypatch.setattr(shingles, "verified", spy)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 2, 3}
    assert seen[0] == (2, 1) and all(met == 0 for met, _ in seen[1:])


def test_variants_below_the_least_similarity_are_not_all_paired(spark, monkeypatch):
    base = " ".join(RNG.choices(VOCAB, k=300))
    # pairs of variants share half to three quarters of their shingles; some are copies of the base or of each other
    variants = [edited(base, RNG.randint(9, 14)) for _ in range(320)]
    texts = [base, *variants, *(edited(v, 2) for v in variants[:40]), *(edited(base, k) for k in range(1, 8))]
    RNG.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS)
    verified, seen = shingles.verified, []

    def spy(pairs, *rest):
        seen.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingles, "verified", spy)
    monkeypatch.setattr(shingles, "STARS", 1)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == survivors(texts)
    assert seen[-1] < 5 * len(texts)


def test_a_group_of_near_copies_does_not_meet_all_its_farther_variants(spark):
    base = " ".join(RNG.choices(VOCAB, k=150))
    # a group with one label, and variants just out of reach, some with copies of their own
    group = [base, *(edited(base, RNG.choice([1, 2])) for _ in range(90))]
    variants = [edited(base, RNG.choice([3, 4, 5])) for _ in range(150)]
    texts = [*group, *variants, *(edited(v, RNG.choice([1, 2])) for v in variants[:40])]
    sets = [grams(t) for t in texts]
    label = [0 if i < len(group) else i for i in range(len(texts))]
    rows = spark.createDataFrame(list(enumerate(texts)), "__row long, text string")
    kinds = rows.select(rows["__row"].alias("key"), rows["__row"].alias("row"))
    members = spark.createDataFrame(list(enumerate(label)), "key long, label long")
    got = {(r.u, r.v) for r in shingles.prefix_pairs(members, kinds, rows, "text").collect()}
    near = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    want = {(i, j) for j in range(len(texts)) for i in range(j) if label[i] != label[j] and near(i, j)}

    def joined(pairs):
        root = list(label)
        for i, j in pairs:
            x, y = sorted((root[i], root[j]))
            root = [x if r == y else r for r in root]
        return root

    assert len(want) > 100 and all(label[u] != label[v] and u < v for u, v in got)
    assert joined([p for p in got if near(*p)]) == joined(want)
    # further variants are within a few shingles of each member of the group, but need not be held against each
    assert len(got - want) < 5 * len(texts)


def test_shingles_and_texts_are_sent_to_no_task(spark):
    """Spark takes the list of a set for one shingle, and a written text for its compressed bytes."""
    base = " ".join(RNG.choices(VOCAB, k=150))
    rows = spark.createDataFrame(list(enumerate([base, *(edited(base, RNG.choice([1, 2, 3, 4])) for _ in range(90))])), "__row long, text string")
    kinds = rows.select(rows["__row"].alias("key"), rows["__row"].alias("row"))
    plans = spark._jsparkSession.sharedState().statusStore()
    began = plans.executionsCount()
    pairs = shingles.prefix_pairs(kinds.select("key", kinds["key"].alias("label")), kinds, rows, "text")
    assert shingles.verified(pairs, kinds, rows, "text").count() > 0
    run = plans.executionsList()
    said = "\n".join(run.apply(k).physicalPlanDescription() for k in range(began, run.size()))
    sent = {c for columns in re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*?)\]", said) for c in re.findall(r"(\w+)#", columns)}
    assert "SortMergeJoin" in said and not sent & {"s", "set", "other", "text", "a", "b", "hub"}
