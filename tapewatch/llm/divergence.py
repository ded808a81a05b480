"""How the sources of a language differ in their words, from bitmaps by count.

For each group (language, source) and each count, the terms that occur that often in the group are a set of bits over
the numbered terms of the language; terms that do not occur are what the other sets leave of all terms. For two groups,
AND and popcount of their sets give the number of terms in each cell of their joint table of counts, and the divergence
is the sum over the cells of that number times the cell's value. Terms of like frequency are numbered together, so that
few counts occur among 64 of them; slabs of terms and blocks of sources are tasks of bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.common import written

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Terms of a slab and sources of a block: a task sees one slab of two blocks.
SLAB = 1024
BLOCK = 64
#: Entries that a task counts before it hands them on; bytes of a text that are split at once.
ENTRIES = 500_000
PART = 1 << 20

_UPPER = bytes(range(0x41, 0x5B))
_TERM = bytes(c | 0x20 if c in _UPPER else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _parts(text: str) -> Iterator[list[bytes]]:
    """The terms of a text: runs of letters A to Z, in lower case, and of what is not ASCII."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERM)
    at = 0
    while len(data) - at > PART:
        cut = data.rfind(b" ", at, at + PART)
        cut = data.find(b" ", at + PART) if cut < 0 else cut
        if cut < 0:
            break
        yield data[at:cut].split()
        at = cut + 1
    yield data[at:].split()


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row without a term for every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            lang, source, term, n, df = [], [], [], [], []
            for (g, s), (count, held) in groups.items():
                lang += [g] * (len(count) + 1)
                source += [s] * (len(count) + 1)
                term += [None, *count]
                n += [0, *count.values()]
                df += [0, *(held[t] for t in count)]
            groups.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

        entries = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                count, held = groups.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(count), set()
                for words in _parts(text.as_py()):
                    count.update(words)
                    seen.update(words)
                held.update(seen)
                entries += len(count) - before
                if entries >= ENTRIES:
                    yield out()
                    entries = 0
        if groups:
            yield out()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _numbered(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, n, slab, word, bit): the kept terms, numbered within slabs of like frequency."""
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    terms = terms.select("lang", "term", "n", F.length(F.bin("n")).alias("size"))
    slabs = terms.groupBy("lang", "size").agg(F.ceil(F.count("*") / SLAB).alias("slabs"))
    part = F.pmod(F.xxhash64("term"), F.col("slabs"))
    dealt = terms.join(slabs, ["lang", "size"]).withColumn("slab", F.col("size") * F.lit(1 << 40) + part)
    at = F.row_number().over(Window.partitionBy("lang", "slab").orderBy("n", "term")) - 1
    return dealt.withColumn("at", at).select("lang", "term", "n", "slab", F.floor(F.col("at") / 64).cast("int").alias("word"), (F.col("at") % 64).alias("bit"))


def _p(n: Column) -> Column:
    """The smoothed share of a term, in billionths; products may pass 64 bits."""
    top = F.lit(SCALE).cast("decimal(38,0)") * (n + F.lit(2)).cast("decimal(25,0)")
    return F.lit(1) + F.call_function("div", top.cast("decimal(38,0)"), (F.col("total") + 2 * F.col("v")).cast("decimal(38,0)"))


def _f(p: Column, q: Column) -> Column:
    """At most a billion for shares of at most a billion, so that the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cells(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of cells of one slab for all pairs of a source of block a with a later one of block b."""
    lang, _, a, b = key
    full = pdf[pdf["kind"] == 2]
    zero = pdf[pdf["kind"] == 1]
    rows = pdf[pdf["kind"] == 0]
    out = np.zeros((BLOCK, BLOCK), np.int64)
    for word, mask in zip(full["word"], full["bits"], strict=True):
        own = rows[rows["word"] == word]
        source = np.concatenate((own["source"].to_numpy(np.int64), zero["source"].to_numpy(np.int64)))
        p = np.concatenate((own["p"].to_numpy(np.int64), zero["p"].to_numpy(np.int64)))
        some = np.zeros(2 * BLOCK, np.int64)  # what occurs in a source: of block a, then of block b
        place = lambda s: s % BLOCK + BLOCK * (s // BLOCK != a)
        np.bitwise_or.at(some, place(own["source"].to_numpy(np.int64)), own["bits"].to_numpy(np.int64))
        bits = np.concatenate((own["bits"].to_numpy(np.int64), np.int64(mask) & ~some[place(zero["source"].to_numpy(np.int64))])).view(np.uint64)
        left, right = np.flatnonzero(source // BLOCK == a), np.flatnonzero(source // BLOCK == b)
        for at in range(0, len(left), 256):
            l = left[at : at + 256]
            joint = np.bitwise_count(bits[l, None] & bits[None, right])
            i, j = np.nonzero(joint)
            pi, qj = p[l[i]], p[right[j]]
            value = joint[i, j].astype(np.int64) * ((pi - qj) * (pi - qj) // (pi + qj))
            np.add.at(out, (source[l[i]] % BLOCK, source[right[j]] % BLOCK), value)
    i, j = np.meshgrid(np.arange(BLOCK) + a * BLOCK, np.arange(BLOCK) + b * BLOCK, indexing="ij")
    here = np.isin(i, zero["source"]) & np.isin(j, zero["source"]) & (i < j)
    return pd.DataFrame({"lang": lang, "i": i[here], "j": j[here], "value": out[here]})


def _pairs(groups: DataFrame, terms: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, i, j, value) for all pairs of sources of a language, i before j."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    levels = kept.groupBy("lang", "number", "slab", "word", "n").agg(F.bit_or(bit).alias("bits"))
    levels = levels.join(groups.select("lang", "number", "total", "v"), ["lang", "number"])
    full = terms.groupBy("lang", "slab", "word").agg(F.bit_or(bit).alias("bits"))
    blocks = groups.groupBy("lang").agg(F.max(F.floor(F.col("number") / BLOCK)).alias("last"))
    every = F.sequence(F.lit(0).cast("long"), F.col("last"))

    def dealt(rows: DataFrame, kind: int, source: Column, word: Column, p: Column, bits: Column) -> DataFrame:
        """A copy for each pair of blocks that the row's source takes part in."""
        own = F.floor(source / BLOCK)
        met = rows.join(blocks, "lang").withColumn("other", F.explode(every))
        return met.select("lang", "slab", F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"), F.lit(kind).alias("kind"),
                          source.cast("long").alias("source"), word.cast("int").alias("word"), p.cast("long").alias("p"), bits.cast("long").alias("bits"))

    none, number = F.lit(0), F.col("number")
    slabs = terms.select("lang", "slab").distinct()
    rows = dealt(levels, 0, number, F.col("word"), _p(F.col("n")), F.col("bits"))
    rows = rows.unionByName(dealt(slabs.join(groups, "lang"), 1, number, none, _p(F.lit(0)), none))
    of_all = full.join(blocks, "lang").withColumn("a", F.explode(every)).withColumn("b", F.explode(F.sequence(F.col("a"), F.col("last"))))
    rows = rows.unionByName(of_all.select("lang", "slab", "a", "b", F.lit(2).alias("kind"), none.cast("long").alias("source"), "word", none.cast("long").alias("p"), "bits"))
    found = rows.groupBy("lang", "slab", "a", "b").applyInPandas(_cells, "lang string, i long, j long, value long")
    return found.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source of docs (text, lang, source).

    Nulls count as ''. A language keeps the terms in at least `least_docs` of its rows. Part `pair` ranks the other
    sources of the language by the divergence over all kept terms; part `term` has the first `top_terms` terms that a
    source has more often than its language. Ties go to the smaller item in UTF-8. A source without kept terms has
    pairs, a language with one source has none, and repeated rows count as documents of their own. Other columns of docs
    are not looked at.
    """
    counts = written(_counted(docs), "counts")
    terms = written(_numbered(counts, least_docs), "terms")
    kept = counts.where("term is not null").select("lang", "source", "term", "n").join(terms.drop("n"), ["lang", "term"])
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a small row for each source
    groups = counts.where("term is null").select("lang", "source", number.cast("long").alias("number"))
    kept = written(kept.join(groups, ["lang", "source"]), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = written(groups.select("lang", "source", "number", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total"))), "groups")

    values = _pairs(groups, terms, kept)
    one = groups.select("lang", F.col("number").alias("i"), "source")
    two = groups.select("lang", F.col("number").alias("j"), F.col("source").alias("item"))
    every = one.join(two, "lang").where("i <> j")  # as many rows as the result has
    both = values.unionByName(values.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    pairs = every.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    whole = terms.select("lang", "term", F.col("n").alias("lang_n"))
    own = kept.join(groups.drop("number"), ["lang", "source"]).join(whole, ["lang", "term"])
    own = own.withColumn("p", _p(F.col("n"))).withColumn("total", F.col("lang_total")).withColumn("q", _p(F.col("lang_n"))).where("p > q")
    more = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top_terms))
