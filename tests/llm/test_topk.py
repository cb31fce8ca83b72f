import math
import random

import numpy as np
import pytest

from metreur.llm import topk


def brute(rows, wanted, k):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * float(np.float32(x))) for x in v]
        best[i] = max(best.get(i, w), w)
    out = []
    for q, v in best.items():
        if wanted(q):
            scores = sorted((-sum(a * b for a, b in zip(v, c, strict=False)), i) for i, c in best.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def table(n, width, seed, copies=0):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, 0.3) for _ in range(width)]) for k in range(n)]
    rows += [(1000 + k, rows[0][1]) for k in range(copies)]
    return rows


@pytest.mark.parametrize(("n", "copies", "options"), [(300, 0, {}), (300, 150, {"block": 8, "shard": 64}), (10, 0, {}), (200, 40, {"sample": 0}), (400, 0, {"block": 16, "shard": 32, "k": 3})])
def test_search_is_the_plain_one(spark, n, copies, options):
    rows = table(n, 12, n, copies)
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 10), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, []), (2005, [0.5] * 3), (None, rows[1][1]), rows[5], (7, [0.1] * 12), (2020, [0.0] * 12)]
    frame = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double").repartition(3)
    got = topk.search(frame, frame.where("vec_id % 20 = 0"), **options)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda q: q % 20 == 0, options.get("k", 20))


def test_products_beyond_doubles(spark):
    rows = [(k, [float(2**22 + k), float(-(2**22)) - k]) for k in range(0, 60, 5)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in topk.search(frame, frame).collect()) == brute(rows, lambda q: True, 20)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.search(frame, frame).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")
    assert topk.search(one, one).count() == 0


def test_blocks_are_left_out():
    r = np.random.default_rng(2)
    vectors = np.concatenate([r.integers(50, 60, (64, 8)), r.integers(-60, -50, (640, 8))])
    shard = topk.Shard(np.arange(len(vectors)), vectors, 16)
    seen = []
    own = shard.vectors

    class Watched(np.ndarray):
        def __getitem__(self, key):
            seen.append(key)
            return super().__getitem__(key)

    shard.vectors = own.view(Watched)
    shard.search(np.array([0]), vectors[:1], np.array([topk.LOW]), 5)
    assert len([k for k in seen if isinstance(k, slice)]) <= 4
