"""Cover trees: their invariants, what radii rule out, and labels of any type."""

import math

import numpy as np
import pytest

from inkveil.llm import vectors
from inkveil.llm.vectors import CoverTree, Join


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def cloud(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    x = unit(rng.standard_normal((n, dims)))
    x[n // 2 :] = unit(x[: n - n // 2] + rng.standard_normal((n - n // 2, dims)) * 0.1 / math.sqrt(dims))
    return x


@pytest.mark.parametrize(("n", "dims"), [(300, 2), (500, 3), (300, 40)])
def test_tree_and_join_against_all_pairs(n, dims):
    x, weight = cloud(n, dims), np.arange(n) % 3 + 1
    tree = CoverTree.build(x, np.arange(n), weight)
    for k in range(len(tree.lo)):
        assert tree.lo[k] <= tree.centre[k] < tree.hi[k]
        assert np.linalg.norm(tree.x[tree.lo[k] : tree.hi[k]] - tree.x[tree.centre[k]], axis=1).max() <= tree.radius[k] + 1e-6
        kids = np.arange(tree.first[k], tree.last[k])
        if len(kids):
            assert tree.centre[k] in tree.centre[kids] and tree.radius[kids].max() < tree.radius[k]
            far = np.linalg.norm(tree.x[tree.centre[kids]][:, None] - tree.x[tree.centre[kids]][None], axis=2) + 9 * np.eye(len(kids))
            assert len(kids) == 1 or far.min() > tree.radius[kids].max() - 1e-6
            assert [*tree.lo[kids], tree.hi[k]] == [tree.lo[k], *tree.hi[kids]]
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    join = Join(tree, tree, 0.93)
    got = np.zeros(n, np.int64)
    got[tree.ids] = join.na
    assert (got == (near * weight).sum(axis=1)).all()
    a, b = (CoverTree.build(x[s], np.arange(n)[s], weight[s]) for s in (slice(0, n // 3), slice(n // 3, n)))
    cross = Join(a, b, 0.93)
    got[a.ids], got[b.ids] = cross.na, cross.nb
    across = near.copy()
    across[: n // 3, : n // 3] = across[n // 3 :, n // 3 :] = False
    assert (got == (across * weight).sum(axis=1)).all()


def test_radii_rule_out_most_pairs_of_clusters():
    for n in (10_000, 50_000):
        rng = np.random.default_rng(1)
        centres = unit(rng.standard_normal((n // 50, 4)))
        x = unit(np.repeat(centres, 50, axis=0) + rng.standard_normal((n, 4)) * 0.0002)
        tree = CoverTree.build(x, np.arange(n), np.ones(n, np.int64))
        assert Join(tree, tree, 0.999).compared < n  # of n * n / 2


def test_vectors_as_good_as_equal():
    rng = np.random.default_rng(2)
    x = unit(rng.standard_normal((1, 16)) + rng.standard_normal((4000, 16)) * 1e-10)
    tree = CoverTree.build(x, np.arange(4000), np.ones(4000, np.int64))
    assert set(Join(tree, tree, 0.93).na) == {3999}


@pytest.mark.parametrize("cell", [8192, 40])
def test_labels_are_compared_as_they_are(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    x = cloud(240, 6)
    x[200:] = x[0] + np.arange(40)[:, None] * 1e-9
    near = x @ x.T >= 0.93 * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    for kind, names in (("string", ["a/8!.0", "a", "1.5", "/"]), ("double", [1.2, 1.7, -0.0, 0.0])):
        label = [names[i % 4] for i in range(240)]
        same = np.array([[p == q for q in label] for p in label])
        links = near & same & ~np.eye(240, dtype=bool)
        rows = [(i, v.tolist(), n) for i, (v, n) in enumerate(zip(x, label, strict=True))] + [(900, x[0].tolist(), None), (901, None, names[0]), (902, [], names[0]), (903, [1.0, None], names[0]), (904, [float("nan")] * 6, names[0])]
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
        assert [got[i][0] for i in range(240)] == links.sum(axis=1).tolist()
        least = np.arange(240)
        for _ in range(240):
            least = np.minimum(least, np.where(links, least[None, :], 240).min(axis=1))
        assert [got[i][1] for i in range(240)] == least.tolist()
        assert all(got[i] == (0, i) for i in range(900, 905))
