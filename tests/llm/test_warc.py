import base64
import hashlib
import random
import time

from tapewatch.llm import warc
from tapewatch.llm.common import scratch

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, None, None), (3, "http://a/ü x\r\ny", ""), (5, "u", "<p>x</p>"), (5, "u", "<p>x</p>"), (9, "v", "é" * 70_000), (-4, "w", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, None, "alone"), (2**62 + 5, "big", "b"), (12, "q", "WARC/1.1\r\n\r\n\x1f")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as sha", "1 as payload")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(least=0):
    out = []
    for page, _, html in PAGES:
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        size = len((html or "").encode())
        visit = page is not None and size >= least and page < max(same)
        out.append((page, size, digest(html), "revisit" if visit else "response", max(same) if visit else None))
    return sorted(out, key=str)


def rows(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


def test_round_trip_with_revisits(spark):
    assert rows(warc.round_trip(pages(spark))) == expected()
    assert rows(warc.round_trip(pages(spark), 5)) == expected(5)
    assert rows(warc.round_trip(pages(spark).where("false"))) == []


def test_payloads_come_back(spark):
    path = scratch(spark, "w")
    warc.write_archives(pages(spark), path)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).where("record_type = 'response'").collect() if r.page_id is not None}
    assert got == {5: "<p>x</p>", 3: "", 9: "é" * 70_000, 2**62 + 5: "b", 12: "WARC/1.1\r\n\r\n\x1f"}


def some(n, plain=False):
    out = []
    for k in range(n):
        data = warc.record(k, f"http://h/{k}", bytes(random.Random(k).choices(range(256), k=300)), warc.sha1_32(bytes(random.Random(k).choices(range(256), k=300))), None, "2024-01-01T00:00:00Z")
        out.append(data if plain else warc.member(data))
    return out


def test_salvage_recovers_all_but_the_damaged(spark):
    for plain in (False, True):
        parts = some(9, plain)
        for hurt in (0, 4, 8):
            broken = bytearray(parts[hurt])
            broken[len(broken) // 2] ^= 0x55
            data = b"".join(parts[:hurt]) + bytes(broken) + b"".join(parts[hurt + 1 :])
            got = list(warc.salvage(data))
            assert [r["page_id"] for r in got if r["kind"] == "record"] == [k for k in range(9) if k != hurt]
            gaps = [r for r in got if r["kind"] == "gap"]
            assert len(gaps) == 1 and gaps[0]["problem"] and gaps[0]["offset"] <= sum(map(len, parts[:hurt]))
            assert gaps[0]["offset"] + gaps[0]["length"] >= sum(map(len, parts[: hurt + 1])) - 1


def test_salvage_of_cuts_garbage_and_mixed_forms():
    parts = some(4)
    cut = b"".join(parts)[:-20]
    assert [r["kind"] for r in warc.salvage(cut)] == ["record"] * 3 + ["gap"]
    mixed = b"garbage" + parts[0] + b"\0\0" + some(2, True)[1] + b"\x1f\x8b\x08junk" + parts[2]
    assert [(r["kind"], r.get("page_id")) for r in warc.salvage(mixed)] == [("gap", None), ("record", 0), ("record", 1), ("gap", None), ("record", 2)]
    assert list(warc.salvage(b"")) == []


def test_page_ids_in_record_ids():
    for n in (0, 5, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_urn(n)) == n
    assert warc.page_of("urn:uuid:12345678-1234-5678-1234-567812345678") is None


def archive(records, size=10_000):
    rng = random.Random(records)
    out = []
    for k in range(records):
        body = rng.randbytes(size)
        out.append(warc.member(warc.record(k, f"http://x/{k}", body, warc.sha1_32(body), None, "2024-01-01T00:00:00Z")))
    return b"".join(out)


def test_reading_is_linear():
    """Twice the archive takes about twice the time, with undamaged members and with false marks in damaged bytes."""
    times = []
    for n in (1000, 2000):
        data = archive(n) + (warc.MAGIC + b"?" * 40) * n
        began = time.process_time()
        got = list(warc.salvage(data))
        times.append(time.process_time() - began)
        assert [r["kind"] for r in got] == ["record"] * n + ["gap"]
    assert times[1] < 3 * times[0] + 0.2


def test_archives_are_bounded_in_bytes(spark):
    rng = random.Random(3)
    rows = [(k, "u", rng.randbytes(300).hex()) for k in range(60)]
    path = scratch(spark, "bounded")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, file_bytes=3000)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) > 5 and max(sizes) < 4500
    assert {r.page_id for r in warc.read_archives(spark, path).collect()} == set(range(60))
