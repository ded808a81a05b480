"""Language identification as inference of a mixture.

A document is a bag of letter trigrams drawn from a mixture of the learned languages. Expectation-maximisation
estimates the proportions, and the set of languages is the nested one (by proportion) with the best likelihood
penalised by its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm import tokens
from tapewatch.llm.common import drop_columns, letters, widened

BINS = 1 << 16
#: Labelled documents learned from, per language.
SAMPLE = 2500
#: Languages with a smaller share of a text are in no set.
NOTE = 0.02


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed letter trigrams of a whole text and their counts; None where the text has no letter."""
    if not text:
        return None
    f = letters(text)
    letter = f > 0
    if not letter.any():
        return None
    f = f[letter | np.concatenate(([False], letter[:-1]))]
    f = np.concatenate((np.zeros(1, np.uint32), f, np.zeros(1, np.uint32)))
    g = (f[:-2] * np.uint32(2654435761) + f[1:-1] * np.uint32(2246822519) + f[2:] * np.uint32(3266489917)) >> np.uint32(16)
    if len(g) < 4000:
        return np.unique(g, return_counts=True)
    n = np.bincount(g, minlength=BINS)
    at = np.flatnonzero(n)
    return at, n[at]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, prior: float = 4000.0):
        self.langs = langs
        total = counts.sum(0)
        back = (total + 0.5) / (total.sum() + 0.5 * BINS)
        own = counts.sum(1, keepdims=True)
        self.p = np.ascontiguousarray(((counts + prior * back) / (own + prior)).T.astype(np.float32))  # (bin, language)

    def mixture(self, at: np.ndarray, n: np.ndarray, penalty: float = 3.0, rounds: int = 8) -> tuple[int, float]:
        """The leading language of the chosen set and its proportion.

        Sets are nested, in the order of the proportions over all languages; every one up to the last language with a
        share of note is scored, so that a set may win although the one before it did not gain.
        """
        p, n = self.p[at].astype(np.float64), n.astype(np.float64)
        size = n.sum()
        k = p.shape[1]
        if k == 1:
            return 0, 1.0
        share = np.full(k, 1 / k)
        for _ in range(rounds):
            share = share * ((n / (p @ share)) @ p) / size
        order = np.argsort(-share, kind="stable")
        most = max(1, int((share > NOTE).sum()))
        best, found = -np.inf, (int(order[0]), 1.0)
        for m in range(1, most + 1):
            own = p[:, order[:m]]
            s = share[order[:m]] / share[order[:m]].sum()
            for _ in range(3 if m > 1 else 0):
                s = s * ((n / (own @ s)) @ own) / size
            score = n @ np.log(own @ s) - penalty * (m - 1) * np.log(size + 1)
            if score > best:
                lead = int(np.argmax(s))
                best, found = score, (int(order[lead]), float(min(1.0, s[lead])))
        return found


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learns trigram counts from about `sample` documents of each language, drawn by a hash of the id.

    Every language is learned. Rows with a null text or language are left out. What reaches the driver is one array of
    trigram counts for each language, whatever the number of documents.
    """
    src = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = src.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return Model([], np.zeros((0, BINS)))
    langs = sorted(r["lang"] for r in sizes)
    rates = labelled.sparkSession.createDataFrame([(r["lang"], sample / max(1, r["count"])) for r in sizes], "lang string, rate double")
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000)) / 1e6
    # one row for each language is sent to the tasks
    picked = src.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", "text").repartition(4)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if (got := trigrams(text)) is not None:
                    own.setdefault(lang, np.zeros(BINS, np.int32))[got[0]] += got[1].astype(np.int32)
        if own:  # an empty frame has no type of its columns
            yield pd.DataFrame({"lang": list(own), "n": [x.tobytes() for x in own.values()]})

    counts = np.zeros((len(langs), BINS))
    for r in picked.mapInPandas(count, "lang string, n binary").toLocalIterator():
        counts[langs.index(r["lang"])] += np.frombuffer(r["n"], np.int32)
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the predicted language and the share of the text that speaks it.

    'und' and 0 where the text is null or has no letter, or nothing was learned. Columns of these two names are
    replaced, in upper or lower case, all others stay.
    """
    src = drop_columns(docs, lang_out, score_out)
    keep = src.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one array of BINS for each language

    def run(batches):
        import pyarrow as pa

        tokens.release()  # a worker that has packed before holds them
        m = shared.value
        at = keep.index(text_col)
        for b in batches:
            lang, score = [], []
            for t in b.column(at):
                got = trigrams(t.as_py()) if m.langs else None
                k, s = m.mixture(*got) if got is not None else (-1, 0.0)
                lang.append(m.langs[k] if k >= 0 else "und")
                score.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, lang_out, score_out])

    return src.mapInArrow(run, widened(src, **{lang_out: "string", score_out: "double"}))
