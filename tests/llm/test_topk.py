import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from signalmill.llm import topk


def brute(rows, k=5):
    fine = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.setdefault(i, []).append([math.floor(Fraction(x) * 256) for x in v])
    out = []
    for q, vectors in fine.items():
        if q % 50:
            continue
        v = min(vectors)
        scores = sorted(((-min(max(sum(a * b for a, b in zip(v, w)), -(1 << 63)), (1 << 63) - 1), i) for i, ws in fine.items() if i != q for w in ws if len(w) == len(v)))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, kind="float", **kw):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3).withColumn("c", F.lit("x")).withColumn("q", F.lit(1))
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, **kw).select("query_id", "rank", "vec_id", "score").collect()))


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-8, 8) / 16 for _ in range(6)]) for i in range(260)]
    rows += [(300 + i, [0.5] * 6) for i in range(20)]
    rows += [(50, rows[50][1]), (400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (None, [0.5] * 6), (450, [0.25, 0.5]), (451, [0.5, -0.5]), (500, [1e30] * 6)]
    assert run(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-2.5e5, 2.5e5) for _ in range(4)]) for i in range(60)]
    rows = [(i, np.array(v, "float32").astype(float).tolist()) for i, v in rows]
    assert run(spark, rows) == brute(rows)


def test_components_of_any_size(spark):
    rng = random.Random(5)
    sizes = [1.0, 1e6, 1e9, 1e15, 1e150, 1e300, 1.7e308]
    rows = [(i, [rng.uniform(-1, 1) * rng.choice(sizes[: 1 + i % 7]) for _ in range(3)]) for i in range(120)]
    assert run(spark, rows, "double") == brute(rows)
    plain = [(0, [1.0, 2.0]), (1, [200000.0, 1.0]), (2, [1.0, 1.0])]
    assert run(spark, plain) == brute(plain) and run(spark, plain)[0][2] == 1
    million = [(i, [rng.uniform(-1e6, 1e6) for _ in range(4)]) for i in range(60)]
    assert run(spark, million, "double") == brute(million)


def test_many_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.randint(-8, 8) / 16 for _ in range(4)]) for i in range(0, 600, 10)]
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    assert run(spark, rows) == brute(rows)


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [0.5, 0.25]) for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [-3.0])]
    assert run(spark, rows) == brute(rows) == [(0, 1, 1, 131072), (0, 2, 2, -196608)]


def test_empty(spark):
    assert run(spark, []) == []
