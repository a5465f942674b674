import numpy as np
import pytest

from fillwise.llm import embed_dedup as M

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id long, n long, component long"


def vectors(seed=1, clique=80):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((150, 16))
    core = rnd.standard_normal(16)
    tight = core + 0.05 * rnd.standard_normal((clique, 16))
    loose = core[::-1] + 0.33 * rnd.standard_normal((clique, 16))
    pairs = base[:30] + 0.1 * rnd.standard_normal((30, 16))
    x = np.concatenate([base, tight, loose, pairs, base[:5], 3 * base[5:10]]).astype(np.float32)
    return [x[i].tolist() for i in rnd.permutation(len(x))]


def brute(rows):
    ok = [r for r in rows if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    x = [np.array(r[1], np.float64) for r in ok]
    links, parent = {id(r): 0 for r in rows}, list(range(len(ok)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for i in range(len(ok)):
        for j in range(i):
            if len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.9:
                links[id(ok[i])] += 1
                links[id(ok[j])] += 1
                a, b = root(i), root(j)
                if ok[a][0] > ok[b][0]:
                    a, b = b, a
                parent[b] = a
    low = {}
    for k, r in enumerate(ok):
        low[root(k)] = min(low.get(root(k), r[0]), r[0])
    comp = {id(r): low[root(k)] for k, r in enumerate(ok)}
    out = [(r[0], links[id(r)], comp.get(id(r), r[0]), None if r[0] is None else comp.get(id(r), r[0]) == r[0]) for r in rows]
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 7, 7, 7) for r in rows], SCHEMA).repartition(4)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in M.near_duplicates(df).collect()), key=str)


@pytest.mark.parametrize("cell", [M.CELL, 16])
def test_links_and_components_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(M, "CELL", cell)
    rows = [(i, v) for i, v in enumerate(vectors())]
    assert run(spark, rows) == brute(rows)


def test_neighbour_windows(monkeypatch):
    monkeypatch.setattr(M, "NEIGHBOURS", 3)
    x = M.unit(np.random.default_rng(1).standard_normal((40, 2)))
    lane = np.repeat([0, 1], 20)
    i, j = M.neighbour_links(x, lane, 5)
    want = {(a, b) for b in range(5, 40) for a in range(max(0, b - 3), b) if lane[a] == lane[b] and x[a] @ x[b] >= 0.9}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_number_of_passes_grows_with_the_logarithm():
    assert [M.passes(n) for n in (10, 10**4, 10**6)] == sorted(M.passes(n) for n in (10, 10**4, 10**6))
    assert M.passes(10**6) < 20 * M.passes(100)


def test_odd_vectors(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one), (2, one), (2, one), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]),
            (8, [float("inf"), 1.0, 0.0]), (None, one), (9, [1.0, 0.0]), (10, [1.0]), (11, [1e-30, 1e-32, 0.0]), (12, [3e38, 1e37, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_narrowing_bits(monkeypatch):
    monkeypatch.setattr(M, "NEIGHBOURS", 2)
    top = 1 << 62
    key, lane = np.array([0, 1, 2, 3, 3, 3, top, top + 1]), np.array([0, 0, 0, 0, 0, 0, 0, 1])
    assert M.narrowing_bits(key, lane, 0).tolist() == [M.UNKNOWN, M.UNKNOWN, 63, 63, 64, 64, 2, M.UNKNOWN]
    assert M.narrowing_bits(key, lane, 3).tolist() == [63, 64, 64, 2, M.UNKNOWN]


def crowded(n=9000, cone=3000, planted=250, dims=64):
    """A third of the rows in a cone of mean cosine 0.75, some of them with a partner at 0.9 to 0.91."""
    rnd = np.random.default_rng(3)
    axis = M.unit(rnd.standard_normal((1, dims)))

    def across(x):
        y = rnd.standard_normal(x.shape)
        return M.unit(y - (y * x).sum(1, keepdims=True) * x)
    x = np.sqrt(0.75) * axis + 0.5 * across(np.repeat(axis, cone, 0))
    c = rnd.uniform(0.9005, 0.91, (planted, 1))
    to_axis = M.unit(axis - (x[:planted] @ axis.T) * x[:planted])                  # partners stay in the cone
    turn = M.unit(0.45 * to_axis + across(x[:planted]))
    turn = M.unit(turn - (turn * x[:planted]).sum(1, keepdims=True) * x[:planted])
    return np.concatenate([x, c * x[:planted] + np.sqrt(1 - c * c) * turn, rnd.standard_normal((n - cone - planted, dims))]).astype(np.float32)


@pytest.mark.parametrize("row_pass", [M.ROW_PASS, 1])              # pair by pair, and by further passes first
def test_links_in_a_crowded_cone(spark, monkeypatch, row_pass):
    monkeypatch.setattr(M, "ROW_PASS", row_pass)
    monkeypatch.setattr(M, "BLOCK", 1000)
    x = crowded()
    u = M.unit(x.astype(np.float64))
    i, j = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    got = {r[0]: r[2] for r in run(spark, [(k, v) for k, v in enumerate(x.tolist())])}
    lost = sum(got[a] != got[b] for a, b in zip(i.tolist(), j.tolist()))
    assert len(i) >= 250 and lost <= (0 if row_pass > 1 else 0.01 * len(i))


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, [1.0, 2.0])]) == [(3, 0, 3, True)]
