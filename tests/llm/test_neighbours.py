"""Nearest vectors against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import neighbours as nb

SCHEMA = "chunk_id string, embedding array<float>, rep string, n int"


def brute(rows, k, dim):
    by = {}
    for c, e, *_ in rows:
        if c is not None and e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e) and any(e):
            by[c] = min(by.get(c, e), e)
    ids = sorted(by)
    m = np.array([by[c] for c in ids], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    out = {}
    for i, c in enumerate(ids):
        out[c] = [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]]
    return out


def data(n=300, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    rows = [(f"c{i:04d}", (centres[i % 20] + 0.2 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(f"d{i:02d}", rows[0][1]) for i in range(15)]  # copies
    rows += [("c0001", rows[1][1]), (None, rows[1][1]), ("x1", None), ("x2", []), ("x3", [0.0] * dim), ("x4", [float("nan")] * dim), ("x5", [1.0] * (dim - 1)), ("x6", [float("inf")] + [1.0] * (dim - 1))]
    return [(a, b, "clash", 1) for a, b in rows]


@pytest.mark.parametrize("tile", [2000, 60])
def test_exact_when_every_file_is_read(spark, tile):
    rows = data()
    got = {}
    df = spark.createDataFrame(rows, SCHEMA)
    # one pivot: a single inverted file holds everything, so nothing can be missed
    for r in nb.nearest(df, "chunk_id", "embedding", 5, dimensions=8, vectors_per_pivot=10**9, postings=16, rerank=10_000, tile=tile).collect():
        got.setdefault(r.chunk_id, []).append((-r.cosine, r.neighbour))
    assert {c: [n for _, n in sorted(v)] for c, v in got.items()} == brute(rows, 5, 8)


def test_recall(spark):
    rows = data(800, 16, 4)
    want = {tuple(sorted((a, b))) for a, ns in brute(rows, 5, 16).items() for b in ns}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in nb.neighbour_pairs(df, dimensions=16, vectors_per_pivot=20).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_exact_neighbours_and_recall(spark, monkeypatch):
    monkeypatch.setattr(nb, "EXACT_QUERIES", 30)
    monkeypatch.setattr(nb, "EXACT_VECTORS", 70)
    rows = data(300, 8)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", row_id long")
    want = brute(rows, 5, 8)
    for condition, asked in (("true", set(want)), ("row_id % 50 = 0", {r[0] for i, r in enumerate(rows) if i % 50 == 0} & set(want))):
        got = {}
        for r in nb.exact_neighbours(df, "chunk_id", "embedding", condition, dimensions=8).collect():
            got.setdefault(r.chunk_id, []).append((-r.cosine, r.neighbour))
        assert {c: [n for _, n in sorted(v)] for c, v in got.items()} == {c: n for c, n in want.items() if c in asked}
    r = nb.recall(df, dimensions=8).first()
    assert (r.n_queries, r.n_true) == (len(asked), 5 * len(asked)) and r.recall >= 0.9
    assert nb.exact_neighbours(df.limit(0), "chunk_id", "embedding", "true", dimensions=8).count() == 0


def test_two_levels_of_pivots_find_nearly_the_nearest():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    make = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(centres[rng.integers(0, 40, n)] + 0.6 * rng.normal(size=(n, 16)))
    pivots, v = nb.Pivots.of(make(900)), make(500)
    two = lambda probes: nb.Pivots(pivots.vectors, pivots.leaders, pivots.groups, 0, probes)
    exact, near = nb.pivot_orders(v, pivots, 8), nb.pivot_orders(v, two(10), 8)
    assert sum(len(set(a[:4]) & set(b[:4])) for a, b in zip(exact, near)) >= 0.95 * 4 * len(v)
    assert (nb.pivot_orders(v, two(10_000), 8) == exact).all()
    sizes = np.full(900, 10)
    sizes[7] = 5000
    cells = nb.cells_of(pivots, sizes, 2000)
    assert (cells == cells[7]).sum() == 1 and len(cells) == 900 and np.bincount(cells).max() <= 2 * nb.CELL_PIVOTS


def test_few_and_none(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "", 0), ("b", [0.0, 1.0], "", 0)], SCHEMA)
    assert [tuple(r) for r in nb.neighbour_pairs(df, dimensions=2).collect()] == [("a", "b")]
    assert nb.neighbour_pairs(df.limit(0), dimensions=2).count() == 0
    assert nb.neighbour_pairs(df.where("chunk_id = 'a'"), dimensions=2).count() == 0


def test_footrule_similarity_is_the_distance():
    rng = np.random.default_rng(1)
    a, b = (np.array([rng.permutation(12)[:5] for _ in range(6)]) for _ in range(2))
    got = nb.footrule_similarity(a, b)
    for i in range(6):
        for j in range(6):
            pa_, pb = ({p: k for k, p in enumerate(x)} for x in (a[i], b[j]))
            distance = sum(abs(pa_.get(p, 5) - pb.get(p, 5)) for p in set(pa_) | set(pb))
            assert got[i, j] == (30 - distance) / 2


def rescaled(n, dim, seed):
    """Copies of one vector in other lengths; their ids aren't in the order of the rows."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=dim)
    return [(f"r{(i * 7919) % n:04d}", (v * s).astype(np.float32).tolist(), "", 0) for i, s in enumerate(rng.uniform(0.2, 5, n))]


def test_rescaled_copies_have_the_smallest_ids_as_neighbours(spark):
    rows = rescaled(700, 64, 8) + [(f"z{a}", e, "", 0) for a, e, *_ in data(100, 64)[:100]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nb.nearest(df, "chunk_id", "embedding").where("chunk_id < 's'").collect():
        got.setdefault(r.chunk_id, []).append((-r.cosine, r.neighbour))
    want = {c: n for c, n in brute(rows, 5, 64).items() if c < "s"}
    assert {c: [n for _, n in sorted(v)] for c, v in got.items()} == want


def test_directions_are_few_for_rescaled_copies_and_differ_for_others():
    keys = nb._directions(nb._matrix(pa.array([e for _, e, *_ in rescaled(2000, 64, 9)], pa.list_(pa.float32())), 64))
    assert len(set(keys)) <= 32
    other = nb._matrix(pa.array([[1.0, 0.0], [1.0, 1e-4], [-1.0, 0.0], [1e30, 0.0]], pa.list_(pa.float64())), 2)
    assert len(set(nb._directions(other))) == 3


def test_ties_at_the_last_rank_are_all_compared():
    rng = np.random.default_rng(6)
    n, dim = 400, 8
    v = [(np.ones(dim) * s).astype(np.float32).tolist() for s in rng.uniform(0.5, 2, n)]
    columns = {"rep": [f"m{i:03d}" for i in range(n)], "e": pa.array(v, pa.list_(pa.float32())), "pivots": pa.array([[0, 1, 2]] * n, pa.list_(pa.int32()))}
    t = pa.table(columns | {"is_query": [True] * n, "is_member": [True] * n, "files": pa.array([[0, 1]] * n, pa.list_(pa.int32()))})
    found = {}
    for r in nb._block(t, 5, dim, 150).to_pylist():
        found.setdefault(r["q"], set()).add(r["m"])
    ids = columns["rep"]
    assert found == {q: set([m for m in ids if m != q][:5]) for q in ids}
