"""Near-duplicate vectors against a comparison of all pairs, in clusters that fill every list."""

import numpy as np
import pytest

from pagemill.llm import neighbours


def plain(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    component = np.arange(len(x))
    while True:
        least = np.where(near, component[None, :], len(x)).min(axis=1, initial=len(x))
        new = np.minimum(component, least)
        new = new[new]
        if (new == component).all():
            return near.sum(axis=1), component
        component = new


def found(spark, x, partitions=4, **params):
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(partitions)
    return {r.vec_id: r for r in neighbours.near_duplicates(rows, params=neighbours.Descent(**params)).collect()}


def clusters(centres, each, spread, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([c + spread * rng.standard_normal((each, len(c))) for c in centres])


def at_cosine(c, width=32):
    """Two directions with cosine c."""
    a, b = np.zeros(width), np.zeros(width)
    a[0], b[0], b[1] = 1, c, (1 - c * c) ** 0.5
    return [a, b]


@pytest.mark.parametrize("each", [80, 150])
def test_two_tight_clusters_near_each_other_are_one_component(spark, each):
    x = clusters(at_cosine(0.968), each, 0.002)
    links, component = plain(x)
    assert links.sum() == 2 * each * (2 * each - 1) and set(component) == {0}
    got = found(spark, x)
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert {r.component_id for r in got.values()} == {0} and {r.recall for r in got.values()} == {1.0}


def test_a_chain_of_clusters_and_clusters_apart(spark):
    turn = np.arccos(0.966)
    chain = [np.r_[np.cos(k * turn), np.sin(k * turn), np.zeros(14)] for k in range(4)]
    apart = [np.eye(16)[k] for k in (5, 9)]
    x = np.concatenate([clusters([*chain, *apart], 40, 0.002), np.random.default_rng(3).standard_normal((100, 16))])
    links, component = plain(x)
    got = found(spark, x)
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == component.tolist()


def test_one_cluster_in_one_partition(spark):
    """One group in the only batch: nothing is ready before the batches end."""
    x = clusters(np.eye(16)[:1], 20, 0.001)
    assert {r.n_links for r in found(spark, x, 1).values()} == {19}


def test_one_vector_and_none(spark):
    assert found(spark, np.eye(8)[:1])[0].n_links == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.near_duplicates(empty).columns == ["vec_id", "n_links", "component_id", "kept", "recall"]
    assert neighbours.near_duplicates(empty).count() == 0
