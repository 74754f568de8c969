"""Whole-number clustering and codes against plain versions that compare everything with everything."""

import hashlib
import math

import numpy as np
import pytest

from pagemill.llm import bisectors, grid_codes
from pagemill.llm.whole_vectors import digest

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, code string, whole int"


def rows_of(n, dims, seed=1):
    """Vectors with ties, repeated rows, nulls, odd lengths, shared ids, and columns with clashing names."""
    rng = np.random.default_rng(seed)
    base = np.round(rng.normal(0, 0.3, (n, dims)), 2)
    rows = [(i, base[i].tolist(), None if i % 7 == 0 else i % 3, "c", "d", i) for i in range(n)]
    rows += [(i, base[i].tolist(), 1, "c", "d", i) for i in range(0, n, 9)]  # repeated rows
    rows += [(n + i, base[0].tolist(), 2, None, None, None) for i in range(5)]  # ties
    rows += [
        (-1, None, 1, "x", "y", 0), (-2, [None] * dims, 1, "x", "y", 0), (-3, [math.nan] * dims, 1, "x", "y", 0),
        (-4, [0.1] * (dims - 1) + [math.inf], 1, "x", "y", 0), (-5, [], 1, "x", "y", 0), (n + 9, [0.5] * (dims - 1), 1, "x", "y", 0),
        (None, base[1].tolist(), None, None, None, None), (None, base[2].tolist(), None, None, None, None),
    ]
    return rows


def kept_of(rows, dims, scale):
    """(vec_id, whole numbers, label) of the kept rows, in the order in which rows start codebooks."""
    good = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(r[0], [math.floor(scale * x) for x in r[1]], r[2]) for r in good]
    return sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def nearest(vector, centres):
    distances = [sum((a - b) ** 2 for a, b in zip(vector, c)) for c in centres]
    return distances.index(min(distances)), min(distances)


def moved(vectors, of, centres):
    out = []
    for number, centre in enumerate(centres):
        mine = [v for v, c in zip(vectors, of) if c == number]
        out.append([sum(column) // len(mine) for column in zip(*mine)] if mine else centre)
    return out


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = kept_of(rows, dims, scale)
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v, _ in kept if i is not None)
    centres = [v for _, v in named[:k]]
    vectors = [v for _, v, _ in kept]
    for _ in range(rounds):
        centres = moved(vectors, [nearest(v, centres)[0] for v in vectors], centres)
    found = [(i, *nearest(v, centres)) for i, v, _ in kept]
    of = {c: sum(d for _, x, d in found if x == c) for c in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, of[c], sum(of.values()), sha[c]) for i, c, d in found), key=str)


def test_clusters_equal_plain_ones(spark):
    rows = rows_of(90, 8)
    params = bisectors.Clustering(k=5, rounds=4, dims=8, scale=16)
    got = bisectors.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5), params)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, 5, 4, 8, 16, 3)


def test_a_zero_leaves_the_smaller_number():
    centroids = np.array([[0, 0], [4, 0], [4, 0], [2, 2]])
    points = np.array([[2, 0], [4, 0], [2, 1], [2, -9], [3, 1]])
    assert bisectors.tournament(points, *bisectors.bisectors(centroids)).tolist() == [nearest(p, centroids)[0] for p in points.tolist()]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 4, None, None, None, None) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = bisectors.cluster(df, bisectors.Clustering(dims=4, scale=4)).collect()
    assert len(found) == n and all(r.distance == 0 for r in found)
    coded, books = grid_codes.compress(df, grid_codes.Coding(parts=2, scale=4))
    assert sorted(r.vec_id for r in coded.collect()) == list(range(n)) and books.shape[1] == n


def test_codes_equal_plain_ones(spark):
    rows = rows_of(120, 8)
    params = grid_codes.Coding(parts=4, entries=10, rounds=2, scale=16, memo=50)
    coded, books = grid_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), params)
    kept = kept_of(rows, 8, 16)
    codes, errors = [[] for _ in kept], [0] * len(kept)
    for part in range(4):
        vectors = [v[2 * part : 2 * part + 2] for _, v, _ in kept]
        centres = vectors[:10]
        for _ in range(2):
            centres = moved(vectors, [nearest(v, centres)[0] for v in vectors], centres)
        assert books[part].tolist() == centres
        for at, v in enumerate(vectors):
            entry, distance = nearest(v, centres)
            codes[at].append(f"{entry:02x}")
            errors[at] += distance
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    want = sorted(((i, "".join(c), e, by_label[label]) for (i, _, label), c, e in zip(kept, codes, errors)), key=str)
    got = coded.select("vec_id", grid_codes.code_text(), "error", "label_error").collect()
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("spread", [1, 40, 3000, 1 << 20])
def test_cells_leave_out_no_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (64, 4))
    rows = rng.integers(-2 * spread, 2 * spread + 1, (500, 4))
    rows[:64] = entries
    index, distance = grid_codes.Cells(entries, 100).nearest(rows)
    plain = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def test_cells_leave_out_some_entries():
    rng = np.random.default_rng(5)
    cells = grid_codes.Cells(rng.integers(-40, 41, (64, 4)), 10_000)
    cells.nearest(rng.integers(-40, 41, (2000, 4)))
    assert np.mean([len(kept) for kept in cells.known.values()]) < 32


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 8).tolist(), 0, None, None, None) for i in range(60)]
    params = grid_codes.Coding(parts=4, entries=60, scale=256)
    coded, books = grid_codes.compress(spark.createDataFrame(rows, SCHEMA), params)
    for row in grid_codes.decode(coded, books, params).collect():
        assert np.abs(np.array(row.approximate) - rows[row.vec_id][1]).max() <= 0.5 / 256 + 1e-9


def test_huge_components_end_the_job_with_a_message(spark):
    df = spark.createDataFrame([(1, [1e30] * 4, 1, None, None, None)], SCHEMA)
    with pytest.raises(Exception, match="exceeds"):
        bisectors.cluster(df, bisectors.Clustering(dims=4)).collect()


def test_digest_joins_components():
    assert digest(np.array([[1, -2], [3, 4]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()
