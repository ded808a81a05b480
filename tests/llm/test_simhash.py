import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tapewatch.llm import simhash
from tapewatch.llm.common import clear, components, shared_folder, written


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 200]))) for _ in range(60)]
    out = [None, "", " \t\n", "One", "ONE", "a b", "A\tB", "x" * 50_000, " ".join(["same"] * 4000)]
    for t in base:
        out.append(t)
        w = t.split()
        for _ in range(rng.randint(0, 3)):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(words)
            out.append(" ".join(v))
        out.append(t.upper())
    return out


def test_fingerprint_matches_plain_form():
    for t in texts():
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain(t)


def test_components_match_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = brute([plain(t) for _, t, _ in rows])
    for crowded in (256, 1):
        got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, crowded=crowded).collect()}
        assert got == {i: (plain(t), want[i]) for i, t, _ in rows}


def test_crowded_lists_keep_every_link(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, id long")
    want = brute(signed)
    for crowded in (1000, 3, 0):  # no list is split; some are, and stay crowded; all are
        got = {r.id: r.component_id for r in simhash.group(df, crowded).collect()}
        assert got == dict(enumerate(want))


def test_split_lists_report_each_pair_once(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 150:
        f = base
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = sorted((u, v) for u in signed for v in signed if u < v and bin((u ^ v) & (1 << 64) - 1).count("1") <= 3)
    posts = simhash._postings(spark.createDataFrame([(f,) for f in signed], "fp long"))
    whole, split = simhash._pairs(posts, simhash.PICKS), simhash._pairs(simhash._split(posts), simhash.FIVES)
    assert sorted(map(tuple, whole.collect())) == want == sorted(map(tuple, split.collect()))


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "z y x w v u"), (1, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (1, 1)], key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components_of_long_chain_and_star(spark):
    edges = spark.range(299).select((F.col("id") * 7 % 300).alias("u"), ((F.col("id") + 1) * 7 % 300).alias("v"))
    star = spark.range(1001, 1400).select(F.lit(1000).cast("long").alias("u"), F.col("id").alias("v"))
    got = components(edges.unionByName(star)).groupBy("label").count().collect()
    assert {(r["label"], r["count"]) for r in got} == {(0, 300), (1000, 400)}


def test_left_tables_can_be_cleared(spark):
    kept = written(spark.range(3), "kept")
    assert kept.count() == 3
    clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(shared_folder(spark) + "/tapewatch/*").count()


def sent(df):
    """The tables that the plan sends to all tasks."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in line]


def test_exploded_postings_are_sent_to_no_task(spark):
    """Spark takes 35 postings or 65 variants of a fingerprint for one row."""
    fps = written(spark.range(300).select(F.xxhash64("id").alias("fp")), "few")
    assert not sent(simhash.linked_fingerprints(fps))
    assert not sent(simhash._pairs(simhash._split(simhash._postings(fps)), simhash.FIVES))
    assert not sent(simhash._stars(fps))
