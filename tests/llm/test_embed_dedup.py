import numpy as np
import pytest

from pagelattice.llm import embed_dedup as E


def _cloud(seed, n=400):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(4, 12))
    x = np.concatenate([rng.normal(size=(n, 12)), c[rng.integers(0, 4, n)] + 0.07 * rng.normal(size=(n, 12)), c[[0]] + 0.003 * rng.normal(size=(n // 2, 12))])
    return x[rng.permutation(len(x))]


def _labels(s):
    i, j = np.nonzero(s)
    return E._forest(len(s), i, j)


@pytest.mark.parametrize("seed", range(4))
def test_dual_traversal(seed):
    x = E.unit(_cloud(seed))
    w = np.random.default_rng(seed).integers(1, 4, len(x))
    s = x @ x.T >= 0.98
    np.fill_diagonal(s, False)
    got, _, label = E.dual_traverse(x, x, w, w, 0.98, True)
    assert (got == s @ w).all() and (label == _labels(s)).all()
    a, b = x[:333], x[333:]
    s = a @ b.T >= 0.98
    ga, gb, label = E.dual_traverse(a, b, w[:333], w[333:], 0.98, False)
    assert (ga == s @ w[333:]).all() and (gb == w[:333] @ s).all()
    i, j = np.nonzero(s)
    assert (label == E._forest(len(x), i, j + 333)).all()


def test_tree_covers_its_points():
    x = E.unit(_cloud(9))
    tree = E.CoverTree(x)
    for node, kids in enumerate(tree.children):
        gap = np.linalg.norm(x[tree.members[node]] - x[tree.centre[node]], axis=1)
        assert gap.max() <= tree.radius[node] + 1e-12
        if kids is not None:
            assert sorted(np.concatenate([tree.members[k] for k in kids])) == sorted(tree.members[node])
            assert tree.centre[node] in [tree.centre[k] for k in kids]
            inside = [tree.radius[k] for k in kids]
            assert max(inside) <= tree.radius[node] + 1e-12


def _brute(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector, label)."""
    ok = []
    for _, v, label in rows:
        good = label is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        ok.append(E.unit(np.array([v], float))[0] if good else None)
    n = len(rows)
    link = [[i != j and ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        comp = min(ids) if ids else None
        out.append((rows[i][0], sum(link[i]), comp, rows[i][0] is not None and rows[i][0] == comp))
    return sorted(out, key=str)


def test_rows(spark):
    x = _cloud(3, 40).tolist()
    rows = [(i, v, i % 3) for i, v in enumerate(x)]
    rows += [(1000 + i, x[i], i % 3) for i in range(9)] + [(5, x[5], 2), (None, x[4], 1), (None, x[4], None)]
    rows += [(2000, None, 1), (2001, [0.0] * 12, 1), (2002, [1.0, None], 1), (2003, [float("nan"), 1.0], 1), (2004, [float("inf"), 1.0], 1), (2005, [1.0, 0.0], 1), (2006, [2.0, 0.001], 1), (2007, [], 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, point string, w long")
    for block in (16, 2048):
        got = sorted((tuple(r) for r in E.near_duplicates(frame, block_rows=block).collect()), key=str)
        assert got == _brute(rows)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.near_duplicates(frame).collect() == []


def test_all_unfit(spark):
    frame = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, E.near_duplicates(frame).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def _same_as_brute(spark, rows, **params):
    df = spark.createDataFrame([(i, [float(c) for c in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in E.near_duplicates(df, **params).collect())
    assert got == sorted(tuple(x) for x in _brute(rows))


def test_vectors_that_dot_products_cannot_tell_apart(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    multiples = [(i, base * (1 + 0.37 * i), 1) for i in range(200)]
    close = [(1000 + i, base[::-1] + 1e-12 * rng.normal(size=16), 2) for i in range(200)]
    _same_as_brute(spark, multiples + close)
    for rows in (multiples, close):
        x = E.unit(np.array([v for _, v, _ in rows]))
        tree = E.CoverTree(x)
        assert all(len(k) > 1 for k in tree.children if k is not None)


def test_very_small_and_very_large_components(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, base + 0.01 * rng.normal(size=8), 1) for i in range(40)]
    rows += [(100, base * 1e-200, 1), (101, base * 1e200, 1), (102, base * 1e-310, 1), (103, -base * 1e-200, 1)]
    _same_as_brute(spark, rows, block_rows=8)
