import hashlib
import random
import re

from pyspark.sql import functions as F

from tapewatch.llm import pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def fine(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rx in RULES.items() for m in re.finditer(rx, text or "") if fine(k, m[0])]


TEXTS = [
    None, "", "no data", "écrire à bosbt.42@mail8.example.com, merci", "a@b.c_d@e.f g@h.i.j.k@l.m", "x@y a@b..c a@b.c. @x.y", "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.2.3 1.2.3",
    "4041894974608795 4041-8949-7460-8795 4041 8949  74608795 12345678901234567890", "+1 (988) 555-2485 ++44 20 7946 0958 +1 +12345678", "😀 tel 😀 +1 (456) 555-2186x", "\ufdd0a@b.co\ufdd1 9\ufdd29",
    "7" * 60_000, "a." * 30_000 + "@x", "b@" + "c." * 5_000 + "d", "1 2 " * 20_000, "mail me at joe [at] example [dot] com", "call (988) 555-2485 now", "+" * 20_000,
]


def test_base_spans_match_python(spark):
    rng = random.Random(4)
    odd = ["".join(rng.choices("a1@.+- (0)é_%9", k=rng.randint(0, 60))) for _ in range(600)]
    rows = list(enumerate([*TEXTS, *odd]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__email", F.lit(1))
    got = {r.doc_id: r.base for r in pii.personal_data(docs).select("doc_id", pii.as_text(F.filter("spans", lambda s: s["base"])).alias("base")).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        assert got[k] == ",".join(plain(t)), repr((t or "")[:80])
    assert pii.personal_data(docs.where("false")).count() == 0


def test_proposed_spans_and_masking(spark):
    docs = spark.createDataFrame([(1, "write to joe [at] example [dot] com or +1 (988) 555-2485, phone (988) 555-2485"), (2, "x a@b.co 1.2.3.4"), (None, None)], "doc_id long, text string")
    found = pii.candidates(docs, keep_text=True)
    spans = pii.accepted(found, pii.learn(found))
    got = {r.doc_id: (r.s, r.m) for r in spans.select("doc_id", pii.as_text(F.col("spans")).alias("s"), pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got[2] == ("email:2:8,ip:9:16", "x <email> <ip>") and got[None] == ("", None)
    assert "email:9:35" in got[1][0] and got[1][1].startswith("write to <email> or <phone>")


def test_reliable_labelers_get_more_weight():
    rows = [dict(kind=0, base=False, shape=1, gazetteer=g, context=1, n=n) for g, n in ((1, 90), (-1, 10))] + [dict(kind=0, base=False, shape=-1, gazetteer=g, context=-1, n=n) for g, n in ((1, 50), (-1, 50))]
    post, dist = pii.reliabilities(rows)
    assert min(post[:2]) > 0.8 > 0.2 > max(post[2:])
    assert dist[1][0][1] > 0.9 and dist[0][0][-1] > 0.9 and dist[0][1][1] > 0.3
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
