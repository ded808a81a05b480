import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapewatch.llm import binary_records as br
from tapewatch.llm import packing, tokens
from tapewatch.llm.common import scratch
from tapewatch.llm.queries import tokenizer_file
from tapewatch.llm.tokens import PieceEncoder

TEXTS = [
    None, "", " ", "  ", "a", " a  b \n c", "x\n \ny z\t \t q", "Éauouon.\nEn paeux  leaux", "it's 12 345, ok?! ", "ab " * 3000, "   x \x1c \x1cy", "q" * 5000 + " w", "日本語 テキスト", "<|endoftext|> a <|endoftext|>",
    "caf\u00e9. na\u00efve\u00d7. x\u00a0 y a\u00a0\u00a0b \u2003 \u3000z\u3000.", "a\nb\n\nc\n d\n", "\n", " \n ", "one,\ntwo.\nThree", "tail ", "a. b! c? d; 1. \u0417\u0434. .", "don't we'll 'tis.",
]


TOKENIZER = Tokenizer.from_file(tokenizer_file())


def reference(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_piece_encoder_equals_whole_text():
    rng = random.Random(1)
    odd = ["".join(rng.choices(" \n\t \x85\x1cab'é1,S", k=60)) for _ in range(400)]
    enc = PieceEncoder(tokenizer_file(), entries=50)
    for t in [*TEXTS, *odd]:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == reference(t), repr(t)


def docs(spark):
    rows = [(i * 3, t, i) for i, t in enumerate(TEXTS)] + [(None, "null id", 0), (9, "again", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)


def test_records_round_trip(spark):
    got = br.token_records(docs(spark), tokenizer_file(), end_id=0).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(ids) == len(TEXTS) + 2
    at = 0
    text = {i * 3: t for i, t in enumerate(TEXTS)}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id not in (None, 9):
            want = np.array([*reference(text[r.doc_id]), 0], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))


def test_shuffled_reads_and_damage(spark):
    path = scratch(spark, "t")
    br.write_records(docs(spark), path, tokenizer_file(), files=3, file_bytes=200)
    index = br.index_records(spark, path, scratch(spark, "i"))
    files = index.groupBy("path").agg(F.sum("length").alias("n"), F.max("length").alias("one")).collect()
    assert len(files) > 6 and all(r.n < 200 + r.one for r in files)
    ids = [r.doc_id for r in br.starts(index).orderBy("start").collect()]
    assert ids == [None, *sorted(i for i in ids if i is not None)]
    got = {r.doc_id: r.ids for r in br.read_at(spark, index.where("record % 2 = 1")).collect()}
    assert got and all(ids == [*reference(TEXTS[d // 3]), 0] for d, ids in got.items() if d is not None and d != 9)
    good = br.frame(5, b"\1\0\2\0", 2)
    assert [(d, i.tolist()) for _, _, d, i in br.frames(good * 2)] == [(5, [1, 2])] * 2
    for k in range(len(good)):
        with pytest.raises(ValueError):
            list(br.frames(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :]))


def test_records_of_empty_table(spark):
    assert br.token_records(docs(spark).where("false"), tokenizer_file()).count() == 0


def test_best_fill_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(0, 7))}
        cap = rng.randint(0, 120)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        best, used = packing.best_fill(counts, cap)
        assert best == max(s for s in sums if s <= cap)
        assert sum(n * c for n, c in used.items()) == best and all(c <= counts[n] for n, c in used.items())


def test_windows_are_gapless_and_full():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.geometric(1 / 600, 3000), 2048)
    place, offset = packing.fill_windows(lengths, 2048)
    totals = np.bincount(place, lengths)
    assert totals.max() <= 2048 and (2048 * len(totals) - totals.sum()) / totals.sum() < 0.01
    for w in range(len(totals)):
        own = sorted(zip(offset[place == w].tolist(), lengths[place == w].tolist(), strict=True))
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]


def test_packed_documents(spark):
    got = packing.pack_documents(docs(spark), tokenizer_file(), window=64, end_id=1, group=8).toPandas()
    text = {i * 3: t for i, t in enumerate(TEXTS)}
    for d, own in got[got.doc_id.notna() & (got.doc_id != 9)].groupby("doc_id"):
        ids = np.array([*reference(text[d]), 1], "<u4")
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert got.groupby("sequence_id").length.sum().max() <= 64
    assert packing.pack_documents(docs(spark).where("false"), tokenizer_file()).count() == 0


def test_a_worker_gives_its_encoders_back():
    path = tokenizer_file()
    texts = ["the quick brown fox " * 40, None, "x" * 3000 + " one\ntwo  three. " * 30]
    small = tokens.encoder(path, batch=256)
    assert [x.tolist() for x in small.encode_all(texts)] == [x.tolist() for x in tokens.encoder(path).encode_all(texts)]
    tokens.release()
    assert not tokens._OPEN and tokens.encoder(path, batch=256) is not small
