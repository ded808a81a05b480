"""A byte-level convolutional quality classifier in numpy.

A document is cut into overlapping chunks that cover all its bytes. Bytes are embedded, learned filters run over each
chunk, the strongest response of each filter is kept, and a small layer describes the chunk. The maximum and the mean
of the chunks' descriptions give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import drop_columns, widened

CHUNK, HOP, WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 256, 192, 8, 4, 8, 24, 16
#: Documents learned from for each label, and chunks of each of them that a step takes at most (drawn anew each time).
SAMPLE, STEP_CHUNKS = 1200, 85
_SPOTS = (CHUNK - WIDTH) // STRIDE + 1
_AT = np.arange(_SPOTS)[:, None] * STRIDE + np.arange(WIDTH)


def chunks(text: str | None) -> np.ndarray:
    """(chunks, CHUNK) bytes of a whole text; the last chunk is padded with zero bytes, an empty text is one chunk."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(data) - (CHUNK - HOP)) // HOP))
    padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


class Net:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(size=s).astype(np.float32) / np.sqrt(np.float32(s[0]))
        self.w = {"e": r.normal(size=(256, EMBED)).astype(np.float32) * np.float32(0.5), "c": f(WIDTH * EMBED, FILTERS), "cb": np.zeros(FILTERS, np.float32), "h": f(FILTERS, HIDDEN), "hb": np.zeros(HIDDEN, np.float32), "o": f(2 * HIDDEN, 1)[:, 0], "ob": np.zeros(1, np.float32)}

    def describe(self, x: np.ndarray) -> np.ndarray:
        """Descriptions of chunks, some at a time."""
        w, out = self.w, np.empty((len(x), HIDDEN), np.float32)
        for at in range(0, len(x), 256):
            part = w["e"][x[at : at + 256]].reshape(-1, CHUNK * EMBED)
            win = np.lib.stride_tricks.sliding_window_view(part, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
            top = (np.ascontiguousarray(win) @ w["c"]).max(1) + w["cb"]
            out[at : at + 256] = np.maximum(np.maximum(top, 0) @ w["h"] + w["hb"], 0)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        parts = [chunks(t) for t in texts]
        ends = np.cumsum([len(p) for p in parts])
        d = self.describe(np.concatenate(parts)) if parts else np.empty((0, HIDDEN), np.float32)
        starts = np.concatenate(([0], ends[:-1])).astype(int)
        pooled = np.concatenate([np.maximum.reduceat(d, starts), np.add.reduceat(d, starts) / (ends - starts)[:, None]], 1)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.w["o"] + self.w["ob"], -30, 30).astype(np.float64)))

    def learn(self, texts: list[str], labels: np.ndarray, epochs: int = 8, rate: float = 3e-3, seed: int = 5) -> Net:
        """Adam on the logistic loss, gradients by hand; rows are drawn in an order given by the seed."""
        w, r = self.w, np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        parts, step = [chunks(t) for t in texts], 0
        for _ in range(epochs):
            order = r.permutation(len(parts))
            for s in range(0, len(order), 24):
                own = order[s : s + 24]
                taken = [parts[k] if len(parts[k]) <= STEP_CHUNKS else parts[k][np.sort(r.choice(len(parts[k]), STEP_CHUNKS, replace=False))] for k in own]
                x = np.concatenate(taken)
                size = np.array([len(t) for t in taken])
                starts = np.concatenate(([0], np.cumsum(size)[:-1]))
                doc = np.repeat(np.arange(len(own)), size)
                win = w["e"][x[:, _AT]].reshape(len(x), _SPOTS, WIDTH * EMBED)
                conv = win @ w["c"]
                arg = conv.argmax(1)
                top = np.take_along_axis(conv, arg[:, None], 1)[:, 0] + w["cb"]
                act = np.maximum(top, 0)
                hid = act @ w["h"] + w["hb"]
                d = np.maximum(hid, 0)
                high, mean = np.maximum.reduceat(d, starts), np.add.reduceat(d, starts) / size[:, None]
                pooled = np.concatenate([high, mean], 1)
                p = 1 / (1 + np.exp(-np.clip(pooled @ w["o"] + w["ob"], -30, 30)))
                g = ((p - labels[own]) / len(own)).astype(np.float32)
                grad = {"o": pooled.T @ g, "ob": g.sum(keepdims=True)}
                gp = g[:, None] * w["o"]
                won = d == high[doc]
                gd = won * gp[doc, :HIDDEN] / np.maximum(np.add.reduceat(won.astype(np.float32), starts), 1)[doc] + (gp[:, HIDDEN:] / size[:, None])[doc]
                gh = gd * (hid > 0)
                grad |= {"h": act.T @ gh, "hb": gh.sum(0)}
                gt = (gh @ w["h"].T) * (top > 0)
                grad["cb"] = gt.sum(0)
                rows = np.arange(len(x))[:, None]
                best = win[rows, arg]  # (chunks, filters, inputs)
                grad["c"] = np.einsum("bfi,bf->if", best, gt, optimize=True)
                ge = (gt[:, :, None] * w["c"].T[None]).reshape(len(x), FILTERS, WIDTH, EMBED)
                byte = x[rows[..., None], _AT[arg]].reshape(-1)
                grad["e"] = np.stack([np.bincount(byte, g_, 256) for g_ in ge.reshape(-1, EMBED).T], 1).astype(np.float32)
                step += 1
                for k, v in grad.items():
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.001 * (v * v - m2[k])
                    w[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", sample: int = SAMPLE) -> Net:
    """Learns from about `sample` documents of either label, drawn by a hash of the id, whatever their length.

    A long document takes part in a step with STEP_CHUNKS of its chunks, drawn anew each time. Rows with a null id, text or label are left out; with fewer than two labels the net stays at one half for all.
    """
    net = Net()
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        net.w["o"][:] = 0
        return net
    draw = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1_000_000)) / 1e6
    drawn = known.where(draw < F.when(F.col("y") == 1, sample / sizes[1]).otherwise(sample / sizes[0]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # about 2 * sample rows of two numbers: sent to the tasks, so that no text is shuffled
    src = texts.join(F.broadcast(drawn), "id")
    rows = sorted((r["id"] if r["id"] is not None else -1, r["text"], r["y"]) for r in src.select("id", "text", "y").collect())
    return net.learn([r[1] for r in rows], np.array([r[2] for r in rows], np.float32)) if rows else net


def score(docs: DataFrame, net: Net, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1 for every whole text; a null text counts as empty. A column of this name, in upper or lower case, is replaced."""
    src = drop_columns(docs, out)
    keep = src.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = keep.index(text_col)
        for b in batches:
            texts = b.column(at)
            scores = [s for k in range(0, len(texts), 64) for s in net.score(texts[k : k + 64].to_pylist()).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*keep, out])

    return src.mapInArrow(run, widened(src, **{out: "double"}))
