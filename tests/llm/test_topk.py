import math

import numpy as np

from timberline.llm import topk as T


def _brute(rows, k, scale=256):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in good:
        if q % 50:
            continue
        found = sorted((-sum(a * b for a, b in zip(w, x)), i) for i, x in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def _run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in T.search(df, df.filter("vec_id % 50 = 0"), **options).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.1, 16), 2) * (rng.random(16) < 0.4)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(20)]  # ties
    assert _run(spark, rows) == _brute(rows, 5)
    assert _run(spark, rows, k=3, query_rows=2) == _brute(rows, 3)
    assert _run(spark, rows, k=3, query_rows=3, candidate_rows=7) == _brute(rows, 3)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, []), (50, [float("inf"), 0.0]), (5, [-1.0, 0.5]), (100, [0.25, -0.25]), (None, [1.0, 1.0])]
    assert _run(spark, rows) == _brute(rows, 5)
    assert _run(spark, rows[:1]) == [] and _run(spark, []) == []
    same = [(i, [1.0]) for i in range(30)]
    assert _run(spark, same) == [(0, r, r, 65536) for r in range(1, 6)]


def test_large_weights_use_64_bits(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 0.0]), (2, [-1e6, 0.0])]
    assert _run(spark, rows) == _brute(rows, 5)


def test_lengths_names_and_repeated_rows(spark):
    """Vectors of several lengths meet over the terms that both have; other columns have this operator's names."""
    rows = [(i, [0.01 * ((i * j) % 17 - 8) for j in range(1, 2 + i % 5)]) for i in range(160)]
    rows += [(7, rows[7][1])] * 2 + [(50, rows[50][1])]
    df = spark.createDataFrame([(*r, "w", 1, 2.0) for r in rows], "vec_id long, embedding array<double>, w string, cell int, score double")
    got = [tuple(r) for r in T.search(df, df.filter("vec_id % 50 = 0"), query_rows=2, candidate_rows=16).collect()]
    once = sorted({(i, tuple(v)) for i, v in rows if i % 50 == 0})
    want = []
    for q, v in once:
        w = [math.floor(256 * x) for x in v]
        found = sorted((-sum(a * math.floor(256 * b) for a, b in zip(w, x)), i) for i, x in rows if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    assert sorted(got) == sorted(want)


def test_sums_are_exact_in_every_type():
    rng = np.random.default_rng(5)
    for top in (10, 3000, 10**6, 10**9):
        block, asked = rng.integers(-top, top, (300, 40)), rng.integers(-top, top, (70, 40))
        block[rng.random(block.shape) < 0.5] = 0
        block[:, 3], asked[:, 5] = 0, 0
        asked[rng.random(asked.shape) < 0.5] = 0
        ids = rng.permutation(300)
        q, v, s = T.best_of_block(np.arange(1000, 1070), asked, ids, block, 4)
        every = asked @ block.T
        for i in range(70):
            best = sorted(zip(-every[i], ids))[:4]
            assert sorted(zip(-s[q == 1000 + i], v[q == 1000 + i])) == best
