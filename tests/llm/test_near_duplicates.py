"""op10 against brute force on real sets, and its parts."""

import random

import numpy as np
import pytest

from tarnlake.llm import near_duplicates as nd
from tarnlake.llm.components import components

from .helpers import SF, clashing, odd_rows, table


def brute(rows, k, percent):
    """{doc_id: (n_shingles, component)} of unique ids."""
    sets = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (t or "").translate(lower)).split(" ") if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a, x in enumerate(ids):
        for y in ids[a + 1 :]:
            small, large = sorted((len(sets[x]), len(sets[y])))
            if 100 * small >= percent * large:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a_, b_ = find(x), find(y)
                    root[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, n, words=150, most=30):
    """Copies of one text with some words changed: a group whose links are chains, not a clique."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rng = random.Random(k)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    texts += family(rng, 120, most=12) + family(rng, 60, words=12, most=2) + ["same words here"] * 40 + ["a", "A", "a b", "A\tb", " ", "", None, "É é", "é é"]
    rng.shuffle(texts)
    got = nd.near_duplicates(clashing(table(spark, texts, 1000)), k, percent).collect()
    want = brute(list(enumerate(texts, 1000)), k, percent)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_odd_rows(spark):
    got = nd.near_duplicates(odd_rows(spark), 3, 85).collect()
    assert len(got) == 8
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_shingles for i in (1, 2, 3, 4, 5, 6, None)] == [0, 0, 0, 4, 3, 1, 4]
    assert by_id[None].component_id is None and by_id[None].kept
    assert all(by_id[i].component_id == i for i in (1, 2, 3, 4, 5, 6))
    assert nd.near_duplicates(table(spark, []), 3, 85).count() == 0


def test_representatives_keep_one_row_of_each_group(spark):
    rows = nd.representatives(clashing(odd_rows(spark).union(table(spark, ["one two three four five six"], 9))), 3, 85).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 3, 4, 5, 6] and sum(r.doc_id is None for r in rows) == 1


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, np.uint64)
    a, b = pool[:2000], pool[300:2300]  # similarity 1700 / 2300
    ra, rb, both = (nd.registers(x, np.array([0]))[0] for x in (a, b, np.union1d(a, b)))
    assert (np.maximum(ra, rb) == both).all()
    fit = nd.log_likelihood(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([0.5]))
    assert abs(nd.GRID[fit[0].argmax()] - 1700 / 2300) < 0.08
    assert nd.may_link(ra[None], rb[None], np.array([2000]), np.array([2000]), 74)[0]
    assert not nd.may_link(ra[None], rb[None], np.array([2000]), np.array([2000]), 95)[0]


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_bands_miss_hardly_anything(percent):
    n, rows = nd.bands_of(percent)
    assert n * rows <= nd.REGISTERS and (1 - (percent / 100) ** rows) ** n < 1e-8


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    some = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    edges = chain + star + some + [(5, 5), (None, 7)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_repeated_id_with_several_texts_is_one_document(spark):
    a, b, c = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4")
    rows = [(5, a), (5, b), (7, b), (9, a), (9, a), (3, c), (8, c), (8, ""), (5, a)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted([(5, 8, 5), (5, 8, 5), (5, 8, 5), (7, 8, 5), (9, 8, 5), (9, 8, 5), (3, 8, 3), (8, 8, 3), (8, 0, 8)])


def test_rows_of_one_hot_id(spark):
    rng = random.Random(9)
    texts = family(rng, 30, most=12)
    rows = [(1, t) for t in texts[:5] for _ in range(200)] + list(enumerate(texts[5:], 2))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    want = brute(list(enumerate(texts[:5], -5)) + list(enumerate(texts[5:], 2)), 3, 85)
    hot = {want[i][1] for i in range(-5, 0)}
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id == 1} == {1}
    assert all(r.component_id == (1 if want[r.doc_id][1] in hot else want[r.doc_id][1]) for r in got if r.doc_id > 1)


@pytest.mark.parametrize("cell", [1, 1 << 25])
def test_cells_bounded_by_bytes_give_the_same(spark, monkeypatch, cell):
    monkeypatch.setattr(nd, "CELL_BYTES", cell * 4000)
    texts = family(random.Random(4), 60, most=40)
    got = nd.near_duplicates(table(spark, texts), 3, 85).collect()
    want = brute(list(enumerate(texts)), 3, 85)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
