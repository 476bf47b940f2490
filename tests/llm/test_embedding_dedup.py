"""op9 against brute force."""

import numpy as np
import pytest

from tarnlake.llm import embedding_dedup as ed


def brute(rows, threshold):
    vectors = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and not any(x is None for x in v) and np.isfinite(v).all() and np.any(v):
            vectors[i] = (np.asarray(v, float) / np.linalg.norm(v), label)
    root, n = {i: i for i, _, _ in rows}, dict.fromkeys((i for i, _, _ in rows), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(vectors)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            (x, la), (y, lb) = vectors[i], vectors[j]
            if la == lb and len(x) == len(y) and float(x @ y) >= threshold:
                n[i] += 1
                n[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (n[i], find(i)) for i in n}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for label, size in ((0, 700), (1, 60), (None, 5)):
        centers = rng.normal(size=(6, 16))
        for i in range(size):
            v = centers[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.25, 2.0])
            rows.append((v.astype(np.float32).tolist(), label))
    rows += [(rows[0][0], 0)] * 30 + [([0.0] * 16, 0), (None, 0), ([], 0), ([None] + [1.0] * 15, 0), ([float("nan")] * 16, 0), ([float("inf")] + [1.0] * 15, 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([-0.0, 1.0], 1), ([0.0, 1.0], 1)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("block", [64, 4096])
def test_equals_brute_force(spark, vectors, block, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ed, "BLOCK", block)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("cell", "raw", "n", "id", "part")})
    got = ed.near_duplicates(df, 0.93).collect()
    want = brute(vectors, 0.93)
    assert len(got) == len(vectors)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id], r
        assert r.kept == (r.vec_id == r.component_id)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    got = ed.near_duplicates(spark.createDataFrame([(None, [1.0, 1.0], 0), (3, [1.0, 1.0], 0), (3, [1.0, 1.0], 0), (4, None, None)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert ed.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_one_id_with_several_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (2, [0.0, 1.0], 0), (3, [0.0, 1.001], 0), (2, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)]
    got = ed.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r) for r in got) == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 1, 2, False), (2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False)])


def tree_of(x, small):
    tree = ed.cover_tree(x, small)
    todo, seen = [tree], []
    while todo:
        node = todo.pop()
        assert ed.distances(x[node.points], x[node.center][None]).max() <= node.radius + 1e-9
        assert sorted([*node.single.tolist(), *(p for c in node.nodes for p in c.points.tolist())]) == sorted(node.points.tolist())
        assert all(c.radius <= node.radius * 1.0001 + 1e-9 or len(node.points) == len(x) for c in node.nodes)
        seen += node.single.tolist()
        todo += node.nodes
    assert sorted(seen) == list(range(len(x)))
    return tree


@pytest.mark.parametrize(("size", "spread", "threshold"), [(8, 0.05, 0.99), (8, 0.4, 0.9), (64, 0.03, 0.93), (64, 2.0, 0.93), (3, 1.0, 0.999)])
def test_dual_traversal_is_exact(size, spread, threshold):
    rng = np.random.default_rng(size)
    x, y = (ed.unit(np.concatenate([c + spread * rng.normal(size=(120, size)) for c in rng.normal(size=(6, size))])) for _ in range(2))
    y[:50] = x[:50]
    small = float(np.sqrt(2 - 2 * threshold)) / 2
    one, two = tree_of(x, small), tree_of(y, small)
    i, j = ed.dual_traversal(x, one, x, one, threshold, True)
    want = np.argwhere(np.triu(x @ x.T >= threshold, 1))
    assert {frozenset(p) for p in zip(i.tolist(), j.tolist())} == {frozenset(p) for p in want.tolist()} and len(i) == len(want)
    i, j = ed.dual_traversal(x, one, y, two, threshold, False)
    assert sorted(zip(i.tolist(), j.tolist())) == [tuple(p) for p in np.argwhere(x @ y.T >= threshold).tolist()]


def test_radii_prune_clustered_points(monkeypatch):
    rng = np.random.default_rng(1)
    x = ed.unit(np.concatenate([c + 0.02 * rng.normal(size=(40, 16)) for c in rng.normal(size=(50, 16))]))
    tree, compared = ed.cover_tree(x, 0.18), []
    plain = ed.cosines
    monkeypatch.setattr(ed, "cosines", lambda a, b: compared.append(len(a) * len(b)) or plain(a, b))
    i, _ = ed.dual_traversal(x, tree, x, tree, 0.93, True)
    assert len(i) >= 50 * 40 * 39 / 2 and sum(compared) < 0.1 * len(x) ** 2


def test_vectors_as_bytes():
    import pyarrow as pa

    rows = [[1.0, -0.0], None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [2.0]]
    got = ed.as_bytes(pa.array([[9.0], *rows], pa.list_(pa.float64()))[1:]).to_pylist()
    assert got == [np.array([1.0, 0.0]).tobytes(), None, None, None, None, None, None, np.array([2.0]).tobytes()]
