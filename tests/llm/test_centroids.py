import hashlib
import math
import random

import numpy as np
import pytest

from docproof.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, numbers string, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", "y") for i, v in rows], SCHEMA)


def slow(rows, k, rounds, width):
    kept = [(i, [math.floor(64 * x) for x in map(float, np.array(v, np.float32))]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    middle = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min(range(len(middle)), key=lambda c: (far(v, middle[c]), c))
    if not middle:
        return []
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v), []).append(v)
        middle = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else m for c, m in enumerate(middle)]
    found = [(i, place(v), far(v, middle[place(v)])) for i, v in kept]
    sums = {}
    for _, c, d in found:
        sums[c] = sums.get(c, 0) + d
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((i, c, d, sums[c], sum(sums.values()), names[c]) for i, c, d in found), key=repr)


def find(spark, rows, k=16, rounds=3, width=64):
    return sorted(map(tuple, centroids.cluster_vectors(frame(spark, rows), k, rounds, width).collect()), key=repr)


def test_like_brute_force_with_ties_and_repeats(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += rows[:40] + [(7, [0.5] * 6)] * 3 + [(None, [0.1] * 6)]
    assert find(spark, rows, 16, 3, 6) == slow(rows, 16, 3, 6)
    assert find(spark, rows, 5, 0, 6) == slow(rows, 5, 0, 6)


def test_clustered_vectors_of_full_width(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(12, 64))
    rows = [(int(i), (middle[i % 12] + 0.2 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(600)]
    assert find(spark, rows) == slow(rows, 16, 3, 64)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [-0.01, 4.0]), (1, [0.0, 0.0])]
    others = [(4, None), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0])]
    assert find(spark, sound + others, 3, 2, 2) == slow(sound, 3, 2, 2)
    assert find(spark, others, 3, 2, 2) == [] and find(spark, [], 3, 2, 2) == []
    assert find(spark, [(None, [1.0, 1.0])], 3, 2, 2) == []


def test_filter_spares_distances_and_keeps_results():
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(16, 64)) * 64
    numbers = np.floor(middle[rng.integers(16, size=4000)] + 10 * rng.normal(size=(4000, 64))).astype(np.int64)
    centre = numbers.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(numbers.T))
    turn = centroids.Rotation(centre, axes[:, ::-1])
    chosen = numbers[:16].copy()
    cluster, distance, seen = centroids.nearest(numbers, *turn(numbers), chosen, turn)
    every = ((numbers[:, None, :] - chosen[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert seen < 0.5 * every.size
    # Any rotation gives the same result, also one without a leading axis of any use.
    blind = centroids.Rotation(np.zeros(64), np.eye(64), 1)
    assert (centroids.nearest(numbers, *blind(numbers), chosen, blind)[0] == cluster).all()


def test_numbers_too_large_are_an_error():
    big = np.full((1, 2), 1 << 27)
    turn = centroids.Rotation(np.zeros(2), np.eye(2))
    with pytest.raises(ValueError):
        centroids.nearest(big, *turn(big), big, turn)
