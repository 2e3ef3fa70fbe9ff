"""Vector codes and centroids against plain versions: every vector with every centre, in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import heap_lloyd, registry, sort_means, vector_blocks

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string, r int, cluster string, code int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "id", "v", 1, "c", 2) for i, v, l in rows], SCHEMA)


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def rows_of(n, dims, seed=1, spread=1.0):
    """Clumps, repeated rows, an equal id, an id that is null, and vectors that go."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([c + rnd.gauss(0, spread) for c in rnd.choice(centres)]), rnd.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(5, rows[-1][1], 1), (6, f32([0.0] * dims), 1), (None, f32([0.5] * dims), None), (n, rows[0][1], 0), (n + 1, rows[0][1], None)]
    rows += [(n + 2, None, 1), (n + 3, [None] + [0.0] * (dims - 1), 1), (n + 4, [float("nan")] * dims, 1), (n + 5, [float("inf")] + [0.0] * (dims - 1), None)]
    return rows


def d2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(points, centres, rounds):
    for last in [False] * rounds + [True]:
        at = [min(range(len(centres)), key=lambda c: (d2(p, centres[c]), c)) for p in points]
        if not last:
            for c in range(len(centres)):
                own = [p for p, a in zip(points, at, strict=True) if a == c]
                if own:
                    centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return at, centres


def joined(v):
    return hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()


def nulls_last(i):
    return (i is None, i or 0)


@pytest.mark.parametrize("n, spread", [(300, 1.0), (60, 0.05), (3, 1.0)])
def test_centroids_against_all_distances(spark, n, spread):
    rows = rows_of(n, 64, spread=spread)
    rows.append((n + 6, [1.0] * 63, 1))  # of another size
    good = [(i, v) for i, v, _ in rows if whole(v) and len(v) == 64]
    ints = [[math.floor(1024 * x) for x in v] for _, v in good]
    hashed = lambda k: (good[k][0] is None, hashlib.sha256(f"3:{good[k][0]}".encode()).hexdigest(), good[k][1])
    centres = [list(ints[k]) for k in sorted(range(len(good)), key=hashed)[:8]]
    at, centres = lloyd(ints, centres, 10)
    done = sort_means.Clustering(frame(spark, rows).repartition(3))
    got = sorted(tuple(r) for r in done.assigned.fillna(-1).collect())
    assert got == sorted((-1 if i is None else i, a, d2(p, centres[a])) for (i, _), a, p in zip(good, at, ints, strict=True))
    assert done.centroids.tolist() == centres and [done.digest(c) for c in range(len(centres))] == [joined(c) for c in centres]


def test_few_distances_are_taken_and_none_too_few():
    rnd = np.random.default_rng(3)
    centres = (rnd.normal(size=(40, 8)) * 20_000).astype(np.int64)
    before = rnd.integers(0, 40, 5_000)
    vectors = centres[before] + (rnd.normal(size=(5_000, 8)) * 300).astype(np.int64)
    vectors[:200] = (centres[0] + centres[1]) // 2  # as near to two centres as can be
    best, found, looks = sort_means.nearest(vectors, before, centres)
    all_of_them = np.stack([sort_means.distances(vectors, c) for c in centres], axis=1)
    assert (best == all_of_them.argmin(axis=1)).all() and (found == all_of_them.min(axis=1)).all()
    assert looks < 0.2 * all_of_them.size


def test_stops_strictly_beyond_twice_the_distance():
    # the other centroid lies at exactly twice the distance and is as near: the smaller number wins, so it must be looked at
    best, found, _ = sort_means.nearest(np.array([[0, 5]]), np.array([1]), np.array([[0, 10], [0, 0]]))
    assert best.tolist() == [0] and found.tolist() == [25]


@pytest.mark.parametrize("n, dims, spread", [(200, 16, 1.0), (400, 64, 0.3), (4, 8, 1.0)])
def test_codes_against_all_distances(spark, n, dims, spread):
    rows = rows_of(n, dims, seed=2, spread=spread)
    good = [(i, v, l) for i, v, l in rows if whole(v)]
    good.sort(key=lambda r: (nulls_last(r[0]), r[1]))
    ints, w = [[math.floor(4096 * x) for x in v] for _, v, _ in good], dims // 8
    at, books = [], []
    for p in range(8):
        own = [v[p * w : (p + 1) * w] for v in ints]
        a, b = lloyd(own, [list(v) for v in own[:16]], 6)
        at.append(a), books.append(b)
    codes = ["".join(f"{at[p][k]:02x}" for p in range(8)) for k in range(len(good))]
    errors = [sum(d2(ints[k][p * w : (p + 1) * w], books[p][at[p][k]]) for p in range(8)) for k in range(len(good))]
    done = heap_lloyd.Codes(frame(spark, rows + [(10_000, [1.0] * (dims + 1), 1)]).repartition(3))
    key = lambda i, l, *rest: (-1 if i is None else i, l or "", *rest)
    assert sorted(key(*r) for r in done.coded.collect()) == sorted(key(i, None if l is None else str(l), c, e) for (i, _, l), c, e in zip(good, codes, errors, strict=True))
    assert done.books.tolist() == books and done.digest() == joined([x for b in books for e in b for x in e])
    back = heap_lloyd.decode(done.coded, done.books).select("code", "decoded").distinct().collect()
    assert all(r["decoded"] == [x for p in range(8) for x in books[p][int(r["code"][2 * p : 2 * p + 2], 16)]] for r in back)


def test_heaps_pop_only_what_drift_has_reached(spark):
    done = heap_lloyd.Codes(frame(spark, rows_of(2_000, 64, seed=4, spread=0.02)).coalesce(1), rounds=8)
    assert done.popped[0] == 8 * 2_005 and done.popped[-1] < 0.5 * done.popped[0]


def test_drift_counts_the_largest_move_of_another_entry():
    old, new = np.zeros((1, 3, 1), dtype=np.int64), np.array([[[3], [1], [0]]])
    assert heap_lloyd.drifted(np.zeros((1, 3)), old, new).tolist() == [[4.0, 4.0, 3.0]]
    twice = np.array([[[3], [-3], [0]]])
    assert heap_lloyd.drifted(np.zeros((1, 3)), old, twice).tolist() == [[6.0, 6.0, 3.0]]


def test_blocks_of_a_heap_state_keep_their_heaps():
    heaps = heap_lloyd.Heaps.fresh(5, 3)
    heaps.popped(np.zeros(3), 0.0)
    heaps.push([0, 1, 2, 3, 4], np.array([2, 1, 2, 2, 1]), np.array([3.0, 1.0, 2.0, 0.5, 7.0]), np.zeros(3))
    again = heap_lloyd.Heaps.load(heaps.dump(), 5, 3)
    assert again.entry.tolist() == [2, 1, 2, 2, 1] and again.heaps == heaps.heaps
    assert sorted(again.popped(np.array([0.0, 0.0, 2.0]), 0.0)) == [2, 3] and again.popped(np.array([0.0, 1.0, 2.0]), 0.0) == [1]


def test_empty_tables_and_large_numbers(spark):
    empty = frame(spark, [])
    for df in (empty, frame(spark, [(1, None, 1), (2, [None] * 64, 1)])):
        assert sort_means.Clustering(df).assigned.count() == 0 and heap_lloyd.Codes(df).coded.count() == 0
    large = frame(spark, [(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [1.0] * 64, 1)])
    assert {r["distance"] for r in sort_means.Clustering(large).assigned.collect()} == {0}
    assert {r["error"] for r in heap_lloyd.Codes(large).coded.collect()} == {0}
    assert heap_lloyd.Codes(frame(spark, [(1, [1.0] * 8, 1), (0, [], 1), (2, [1.0] * 7, 1)])).coded.count() == 1


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK", 7)
    df = frame(spark, rows_of(50, 64)).coalesce(1)
    rows = vector_blocks.kept(df, "vec_id", "embedding")
    assert rows.where(F.col("id") == 7).count() == 1
    small = vector_blocks.blocks(rows.where(F.size("v") == 64), 1024, 64, lambda v: (b"", [len(v)]))
    assert all(r[0] <= 7 for r in small.select(F.size("ids")).collect())


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_centroids"])
def test_queries_on_an_empty_table(spark, tmp_path, name):
    frame(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert registry.queries()[name](spark, str(tmp_path)).collect() == []
