import numpy as np

from tapewatch.llm import lattice


def test_nearest_point_is_nearest():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(300, 8)) * 2
    near = lattice.nearest_e8(y)
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(1), 2)
    twice = near * 2
    assert np.allclose(twice, np.rint(twice)) and np.allclose(near.sum(1) % 2, 0)
    d = ((y - near) ** 2).sum(1)
    for v in lattice.NEIGHBOURS:
        assert (((y - near - v) ** 2).sum(1) >= d - 1e-9).all()


def rows():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    out = []
    for k, b in enumerate(base):
        for _ in range(1 + (k % 4) * 3 + 60 * (k == 7)):
            out.append((len(out), [float(np.float32(x)) for x in b + rng.normal(size=16) * 0.05], k % 3))
    out += [(len(out) + j, out[5][1], out[5][2]) for j in range(4)]  # copies
    n = len(out)
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    out += [(n + j, e, 0) for j, e in enumerate(odd)] + [(n + 20, out[0][1], None), (None, out[0][1], 0)]
    return out


def brute(data):
    ok = [r for r in data if r[0] is not None and r[2] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {r[0]: set() for r in data if r[0] is not None}
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    return links


def reach(links):
    out = {}
    for s in sorted(links):
        if s not in out:
            todo = [s]
            while todo:
                n = todo.pop()
                if n not in out:
                    out[n] = s
                    todo += links[n]
    return out


def test_links_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "2 as links").repartition(3)
    want = brute(data)
    for block in (1024, 20):
        got = {r.vec_id: r for r in lattice.near_duplicate_vectors(df, block=block).collect()}
        assert len(got) == len(data)
        true, found = sum(map(len, want.values())), sum(r.n_links for k, r in got.items() if k is not None)
        assert all(got[k].n_links <= len(v) for k, v in want.items()) and found >= 0.99 * true > 500
        comp = reach(want)
        assert sum(got[k].component_id == c for k, c in comp.items()) >= 0.99 * len(comp)
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got.values())
        assert got[None].n_links == 0 and not got[None].kept


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (3, [2.0, 4.0], 0)], "vec_id long, embedding array<double>, label int")
    assert lattice.near_duplicate_vectors(df.where("false")).count() == 0
    got = sorted(tuple(r) for r in lattice.near_duplicate_vectors(df).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (3, 2, 1, False)]


def test_recall_at_the_threshold(spark):
    """Planted pairs exactly at cosine 0.98 (0.9801 to stand above rounding): at least 97 % are found, none below it."""
    rng = np.random.default_rng(9)
    out = []
    for k in range(600):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9801 if k % 2 else 0.9799
        out += [(2 * k, a.tolist(), 0), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    df = spark.createDataFrame(out, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in lattice.near_duplicate_vectors(df).collect()}
    assert sum(got[2 * k] for k in range(1, 600, 2)) >= 0.97 * 300
    assert not any(got[2 * k] for k in range(0, 600, 2))


def test_crowded_cell_of_near_copies(spark):
    """A ball, its fringe and a second ball in one cell: counts equal brute force, with blocks far smaller than the cell."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    data = [(k, (base + rng.normal(size=32) * (0.02 if k % 3 else 0.14)).tolist(), 1) for k in range(240)]
    want = brute(data)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {r.vec_id: r for r in lattice.near_duplicate_vectors(df, block=16).collect()}
    true, found = sum(map(len, want.values())), sum(r.n_links for r in got.values())
    assert all(got[k].n_links <= len(v) for k, v in want.items()) and found >= 0.99 * true > 10_000


def test_large_and_small_components(spark):
    big = [1e200, 2e200, -3e200]
    data = [(1, big, 0), (2, [x / 1e300 for x in big], 0), (3, [0.0, -0.0, 5.0], 0), (4, [-0.0, 0.0, 5.0], 0), (5, [], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicate_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}
