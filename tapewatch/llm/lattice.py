"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points in several tables.

Each table projects unit vectors to eight dimensions and takes the nearest point of the E8 lattice as the home cell;
a vector is also posted to the neighbouring cells nearest to it. Vectors that meet in a cell are compared by cosine, in
blocks, inside the tasks; a pair that meets in several cells counts in the first one only.

Members of a crowded cell that lie within half the threshold's angle of one of them form a ball: by the triangle
inequality all of a ball's members are linked, so their links are counted without comparing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import components, union_all, written

TABLES, PROBES, BLOCK = 8, 3, 1024
#: Projections are scaled so that vectors at the threshold are this far apart in one projected dimension. Larger values
#: bring fewer candidates and less recall; at this one, pairs exactly at the threshold are found in 99.6 % of cases and
#: 6 in 100,000 random pairs meet.
SPREAD = 0.36
#: Rounds of balls around one member of each crowded cell.
ROUNDS = 2


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(whole + half)


NEIGHBOURS = minimal_vectors()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    gap = y[odd] - r[odd]
    k = np.abs(gap).argmax(1)
    r[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (D8 and its half-integer coset) to each row."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def projections(dims: int, tables: int, scale: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table a projection to eight dimensions and odd multipliers that turn a lattice point into a number."""
    rng = np.random.default_rng(seed + dims)
    return [(rng.normal(size=(dims, 8)) * scale, rng.integers(1, 2**62, 8) * 2 + 1) for _ in range(tables)]


def cells(unit: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], probes: int) -> np.ndarray:
    """Cell numbers, (rows, tables, 1 + probes): the home cell first, then the nearest neighbours."""
    out = np.empty((len(unit), len(tables), 1 + probes), np.int64)
    for t, (project, mix) in enumerate(tables):
        y = unit @ project
        home = nearest_e8(y)
        side = np.argsort(-((y - home) @ NEIGHBOURS.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None], home[:, None] + NEIGHBOURS[side]], axis=1)
        out[:, t] = ((points * 2).astype(np.int64) * mix).sum(-1)
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square overflows."""
    m = m / np.abs(m).max(1)[:, None]
    return m / np.sqrt((m * m).sum(1))[:, None]


def _rows(column: pa.Array, lo: int, hi: int) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    part = column.slice(lo, hi - lo)
    return part.flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of equal first column, across batches; rows are sorted by it."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if kept and kept[-1].column(0)[0].as_py() != key[0]:
            yield pa.concat_batches(kept)
            kept = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            kept.append(b.slice(lo, hi - lo))
            if hi < b.num_rows:
                yield kept[0] if len(kept) == 1 else pa.concat_batches(kept)
                kept = []
    if kept:
        yield pa.concat_batches(kept)


def _fresh(link: np.ndarray, codes: np.ndarray, t: int, cell: int) -> np.ndarray:
    """link without the pairs that also meet in an earlier cell: of a table before t, or of t with a smaller number."""
    for k in range(t + 1):
        names, number, n = np.unique(codes[:, k], return_inverse=True, return_counts=True)
        use = (n > 1) & ((names < cell) if k == t else True)
        at = np.cumsum(use) - 1
        number = number.reshape(len(codes), -1)
        row = np.broadcast_to(np.arange(len(codes))[:, None], number.shape)
        held = use[number]
        where = np.zeros((len(codes), int(use.sum())), np.float32)
        where[row[held], at[number[held]]] = 1
        link = link & (where @ where.T == 0)
    return link


def _roots(link: np.ndarray) -> np.ndarray:
    lab = np.arange(len(link))
    big = len(link)
    while True:
        new = np.minimum(lab, np.where(link, lab[None, :], big).min(1))
        if (new == lab).all():
            return lab
        lab = new


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    tables: int = TABLES, probes: int = PROBES, spread: float = SPREAD, block: int = BLOCK, seed: int = 7,
) -> DataFrame:
    """One row for each vector: id, n_links, component_id, kept.

    Equal vectors of a label are one class; classes are compared, and n_links counts other rows (so a class of n
    adds n - 1). Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label
    or id, link with nothing: n_links 0 and component_id their own id. Vectors of different lengths never link. `kept`
    is false only for members that are not the smallest id of their component, or have no id. Classes are told apart by
    a 128-bit digest of label and components. An empty table gives an empty one; further columns are not looked at.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("e").isNotNull() & ~bad & F.exists("e", lambda x: x != 0.0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    src = src.withColumn("e", F.when(F.coalesce(sound, F.lit(False)), F.col("e")))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = []
            for label, e in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if not e.is_valid:
                    node.append(None)
                    continue
                data = e.values.to_numpy() + 0.0  # -0.0 is 0.0
                node.append(blake2b(data.tobytes(), digest_size=16, key=blake2b(label.encode("utf-8", "surrogatepass"), digest_size=32).digest()).digest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node, pa.binary())], names=["id", "label", "e", "node"])

    known = written(src.mapInArrow(named, "id long, label string, e array<double>, node binary"), "vector-nodes")
    classes = known.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("e").alias("e"), F.count("*").alias("n"), F.min("id").alias("least"))
    scale = spread / np.sqrt(2 - 2 * threshold)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list] = {}
        for b in batches:
            e = b.column(2)
            size = e.value_lengths().to_numpy()
            codes = np.empty((len(size), tables * (1 + probes)), np.int64)
            for d in np.unique(size).tolist():
                if d not in made:
                    made[d] = projections(d, tables, scale, seed)
                at = np.flatnonzero(size == d)
                own = e if len(at) == len(size) else e.take(pa.array(at))
                codes[at] = cells(unit_rows(_rows(own, 0, len(at))), made[d], probes).reshape(len(at), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * codes.shape[1], pa.int32()), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "codes"])

    classes = written(classes.mapInArrow(coded, "node binary, label string, e array<double>, n long, least long, codes array<long>"), "vector-classes")
    posts = classes.select("node", F.posexplode("codes").alias("k", "cell"), F.concat_ws(":", F.size("e"), "label").alias("of"))
    posts = posts.select("node", F.concat_ws(":", F.floor(F.col("k") / (1 + probes)), "cell", "of").alias("cell"))
    busy = posts.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    met = written(posts.join(busy, "cell"), "lattice-posts")
    crowd = met.where(F.col("members") > block)
    balls = _balls(crowd, classes, threshold) if not crowd.isEmpty() else None
    row = classes.select("node", "e", "codes", "n")
    if balls is None:
        row, met = row.withColumn("ball", F.lit(None).cast("binary")), met.withColumn("side", F.lit(0))
        full = met.withColumn("g", F.concat_ws("|", F.lit("0|0"), "cell"))
    else:
        row = row.join(balls, "node", "left")
        full = union_all([met.where(F.col("members") <= block).select("node", F.lit(0).alias("side"), F.concat_ws("|", F.lit("0|0"), "cell").alias("g")), _block_pairs(crowd, balls, block)])
    full = full.join(row, "node").select("g", "side", "node", "n", "ball", "e", "codes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            rows = b.num_rows
            if rows < 2:
                continue
            unit = unit_rows(_rows(b.column(5), 0, rows))
            link = unit @ unit.T >= threshold
            np.fill_diagonal(link, False)
            if not link.any():
                continue
            i, j, place = b.column(0)[0].as_py().split("|", 2)
            t, cell, _ = place.split(":", 2)
            if i != j:
                side = b.column(1).to_numpy()
                link &= side[:, None] != side[None, :]
            if b.column(4).null_count < rows - 1:
                ball = b.column(4).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                link &= (ball[:, None] != ball[None, :]) | (ball < 0)[:, None]
            if not link.any():
                continue
            some = np.flatnonzero(link.any(1))
            codes = _rows(b.column(6), 0, rows)[some].reshape(len(some), tables, -1)
            link = _fresh(link[np.ix_(some, some)], codes, int(t), int(cell))
            if link.any():
                node = b.column(2).take(pa.array(some))
                links = link @ b.column(3).to_numpy()[some]
                yield pa.RecordBatch.from_arrays([node, pa.array(links, pa.int64()), node.take(pa.array(_roots(link)))], names=["node", "links", "root"]).filter(pa.array(links > 0))

    part = full.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "node binary, links long, root binary")
    if balls is not None:
        sizes = balls.join(classes.select("node", "n"), "node")
        whole = sizes.groupBy("ball").agg(F.sum("n").alias("all"))
        part = part.unionByName(sizes.join(whole, "ball").select("node", (F.col("all") - F.col("n")).alias("links"), F.col("ball").alias("root")))
    part = written(part, "vector-links")
    comp = components(part.select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    links = part.groupBy("node").agg(F.sum("links").alias("links"))
    base = classes.select("node", "n", "least")
    lead = written(base.join(comp, "node").groupBy("label").agg(F.min("least").alias("lead")), "vector-leads")
    named_comp = comp.join(lead, "label").select("node", "lead")
    per_class = base.join(links, "node", "left").join(named_comp, "node", "left")
    per_class = written(per_class.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("lead", "least").alias("lead")), "vector-of-class")
    out = known.select("id", "node").join(per_class, "node", "left")
    comp_id = F.coalesce("lead", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"))


def _balls(crowd: DataFrame, classes: DataFrame, threshold: float, rounds: int = ROUNDS) -> DataFrame:
    """(node, ball): members of crowded cells within half the threshold's angle of the class that a ball is named after."""
    near = float(np.cos(np.arccos(threshold) / 2)) + 1e-9
    found: DataFrame | None = None
    dot = F.aggregate(F.zip_with("e", "f", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    unit = F.transform("e", lambda x: x / F.array_max(F.transform("e", F.abs)))
    shape = classes.select("node", unit.alias("e")).withColumn("e", F.transform("e", lambda x: x / norm(F.col("e"))))
    left = crowd.select("cell", "node")
    for r in range(rounds):
        hubs = left.groupBy("cell").agg(F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node")).alias("x")).select("cell", F.col("x.node").alias("ball"))
        hubs = written(hubs.join(shape.select(F.col("node").alias("ball"), F.col("e").alias("f")), "ball"), "ball-hubs")
        tried = left.join(hubs.select("cell", "ball"), "cell").select("node", "ball").distinct()
        tried = tried.join(shape, "node").join(hubs.select("ball", "f").dropDuplicates(["ball"]), "ball").select("node", "ball", dot.alias("c")).where(F.col("c") >= near)
        own = tried.groupBy("node").agg(F.max(F.struct("c", "ball")).alias("x")).select("node", "x.ball")
        found = written(own if found is None else found.unionByName(own), "balls")
        left = written(crowd.select("cell", "node").join(found, "node", "left_anti"), "no-ball")
        if left.isEmpty():
            break
    return found


def _block_pairs(crowd: DataFrame, balls: DataFrame, block: int) -> DataFrame:
    """(node, side, g): members of crowded cells by pairs of blocks; a block is of one ball or of none, and blocks of one ball are not paired."""
    held = crowd.join(balls, "node", "left").select("cell", "node", F.coalesce(F.hex("ball"), F.lit("")).alias("ball"))
    sizes = held.groupBy("cell", "ball").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    held = held.join(sizes, ["cell", "ball"]).select("cell", "node", F.concat_ws(".", "ball", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("own"))
    held = written(held, "blocks")
    blocks = sizes.select("cell", "ball", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select("cell", "ball", F.concat_ws(".", "ball", "k").alias("i"))
    other = blocks.select("cell", F.col("ball").alias("ball_j"), F.col("i").alias("j"))
    pairs = written(blocks.join(other, "cell").where("i <= j and (ball <> ball_j or ball = '')").select("cell", "i", "j"), "block-pairs")
    g = F.concat_ws("|", "i", "j", "cell")
    first = held.withColumnRenamed("own", "i").join(pairs, ["cell", "i"]).select("node", F.lit(0).alias("side"), g.alias("g"))
    second = held.withColumnRenamed("own", "j").join(pairs.where("i <> j"), ["cell", "j"]).select("node", F.lit(1).alias("side"), g.alias("g"))
    return first.unionByName(second)
