"""Exact top-k search against brute force over whole numbers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ndspark.llm import top_k

SCHEMA = "vec_id long, embedding array<double>, label int, query long, score string, shard int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 9, "clash", 3) for i, v in rows], SCHEMA)


def brute(rows, asking, k=5):
    """{(query id, its vector)} -> [(id, score)], in Python integers."""
    whole = lambda v: [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v]
    fine = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in fine if asking(i)}:
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in fine if j != i and len(w) == len(v)]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(spark, rows, asking, **more):
    v = vectors(spark, rows)
    return sorted(map(tuple, top_k.top_k(v, v.where(asking), **more).collect()))


def test_clusters_ties_and_copies(spark):
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[i % 9]]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # one vector with a quarter of all rows: ties everywhere
    want = brute(rows, lambda i: i % 50 == 0)
    assert found(spark, rows, "vec_id % 50 = 0", size=128) == want
    assert found(spark, rows, "vec_id % 50 = 0", size=5000) == want
    assert found(spark, rows, "vec_id % 300 = 0", k=3) == brute(rows, lambda i: i % 300 == 0, 3)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (100, [2.0]), (150, []), (6, []), (None, [1.0, 1.0]), (7, [-1.0, -0.001]), (0, [1.0, 2.0]), (8, [3.0, 1.0]), (8, [3.0, 1.0])]
    assert found(spark, rows, "vec_id % 50 = 0") == brute(rows, lambda i: i % 50 == 0)
    assert found(spark, rows, "false") == [] and found(spark, [], "true") == []


def test_scores_are_exact_beyond_doubles(spark):
    rows = [(0, [2.0**40 + 1, 3.0]), (50, [2.0**70, -1.0])] + [(i, [2.0**20 + i, float(-i)]) for i in range(1, 40)] + [(60, [1e300, 1e300]), (61, [-1e300, 5.0])]
    assert found(spark, rows, "vec_id % 50 = 0") == brute(rows, lambda i: i % 50 == 0)


def test_blocks_are_skipped_and_every_vector_may_ask(spark):
    r = np.random.default_rng(1)
    m = np.floor(256 * (np.repeat(np.eye(8) * 4, 64, 0) + r.normal(0, 0.02, (512, 8)))).astype(np.int64)
    m = m[np.argsort(top_k._key(m), kind="stable")]
    cuts = range(0, 512, top_k.BLOCK)
    shard = np.arange(512), m, *(np.stack([f(m[c : c + top_k.BLOCK], axis=0) for c in cuts]) for f in (np.max, np.min))
    best, scored = top_k.search(m, np.arange(512), shard, 5)
    assert scored < 0.3 * 512 * len(cuts)
    s = (m @ m.T).astype(float)
    np.fill_diagonal(s, -np.inf)
    assert (best.scores == np.sort(s, 1)[:, :-6:-1]).all()
    rows = [(int(i), [float(x) / 256 for x in v]) for i, v in enumerate(m[:80])]
    v = vectors(spark, rows)
    assert sorted(map(tuple, top_k.top_k(v).collect())) == brute(rows, lambda i: True)
    assert top_k.top_k(v, v.where(F.lit(False))).columns == ["query_id", "rank", "vec_id", "score"]
