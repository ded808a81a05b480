import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tapewatch.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = bpe.encoding(PATH, PATTERN)._mergeable_ranks
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    marks = ["don't", "'re", "'s", "'", "''ll", " ", "  ", "\n\n", "\t", "\r\n", "été", "naïve", "漢字かな", "١٢٣", "42", "1/2", "…", "?!", "\U0001f600", "\u00a0", "\u2003", "e\u0301", "\ua7ce", "\u0897", "x" * 90]
    mixed = ["".join(rng.choice(marks) + rng.choice(["", " "]) for _ in range(rng.randint(1, 900))) for _ in range(30)]
    odd = ["a" * 3000, " " * 2000 + "x", "ab " * 1500, "'" * 999, "'re" * 800, "\n" * 700 + " end", "漢" * 1200, "9" * 1000 + " tail", "q" * 100 + " " * 300 + "w" * 400]
    return [None, "", " ", "x", "<|endoftext|>", "same", "same", *mixed, *odd]


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_round_trip_equals_the_library(spark, library):
    rows = [(i if i % 9 else None, t, f"r{i}") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    for chunk, overlap in ((64, 16), (300, 40), (1 << 15, 1 << 10)):
        got = bpe.round_trip(docs, PATH, PATTERN, chunk=chunk, overlap=overlap)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        want = []
        for i, t, _ in rows:
            ids = library.encode_ordinary(t or "")
            want.append((i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode())))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_pieces_in_order_are_the_text(spark, library):
    docs = spark.createDataFrame([(i, t, i, i, i) for i, t in enumerate(texts())], "doc_id long, text string, kept long, row long, k long")
    pieces = bpe.decode(bpe.encode(docs, PATH, PATTERN, chunk=100, overlap=20), PATH, PATTERN)
    assert pieces.columns == ["doc_id", "kept", "k", "row", "piece", "ids", "bytes"]
    found = {}
    for r in sorted(pieces.collect(), key=lambda r: r["piece"]):
        assert r.kept == r.k == r.doc_id
        ids, data = found.setdefault(r.doc_id, ([], []))
        ids += np.frombuffer(r.ids, "<u4").tolist()
        data.append(bytes(r.bytes))
    for i, t in enumerate(texts()):
        assert found[i][0] == library.encode_ordinary(t or "")
        assert b"".join(found[i][1]) == (t or "").encode()


def test_every_stitch_is_a_boundary_of_the_whole_text(spark):
    long = [t for t in texts() if t and len(t) > 100]
    src = spark.createDataFrame([((i,), i, t) for i, t in enumerate(long)], "kept struct<i: long>, row long, text string")
    for r in bpe._stitched(bpe._chunked(src, 100, 20), PATTERN, 20).collect():
        ends = [0, *bpe.settled(long[r.row], PATTERN, True)]
        assert r.begin in ends and (r.stop is None or r.stop in ends)


def test_character_classes_are_those_of_the_library(library):
    every = "".join(f" {chr(c)}" for c in range(0x250, 0x20000, 7) if not 0xD800 <= c < 0xE000) + "a\u0085b\x1cc\x1dd"
    parts = bpe.splitter(PATTERN).findall(every)
    assert "".join(parts) == every
    assert [i for p in parts for i in library._encode_single_piece(p.encode())] == library.encode_ordinary(every)


def test_empty_table_and_text_alone(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs, PATH, PATTERN).count() == 0
    got = bpe.round_trip(spark.createDataFrame([("a b",), (None,)], "text string"), PATH, PATTERN).collect()
    assert sorted(r.n_tokens for r in got) == [0, 2]
    with pytest.raises(ValueError):
        bpe.round_trip(docs, PATH, PATTERN, chunk=10, overlap=20)
