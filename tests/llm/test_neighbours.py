import math
import random

import numpy as np

from assaylake.llm import neighbours


def brute(rows, k, every):
    ok = []
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float64)
        ok.append((i, x / np.sqrt((x * x).sum())))
    best = {}
    for q, x in ok:
        if q % every == 0:
            for i, y in ok:
                if i != q and len(x) == len(y):
                    best.setdefault(q, {})
                    best[q][i] = max(best[q].get(i, -9), float(x @ y))
    return {q: sorted(((-round(s, 12), i) for i, s in b.items()))[:k] for q, b in best.items()}


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(4000 + i, [1.0] * 16) for i in range(1500)] + [(6000 + i, [2.0] * 15 + [2.0 + i * 0.05]) for i in range(300)]
    rows += [(7000, None), (7050, [0.0] * 16), (7100, [float("nan")] + [1.0] * 15), (7150, [None] + [1.0] * 15), (7200, []), (None, [1.0] * 16), (7250, [1.0, 2.0]), (7251, [2.0, 1.0]), (7300, [1.0, 2.0, 3.0]), (50, [1e30] * 16), (7400, [1e-30] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, score int")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -round(r.score, 12), r.vec_id))
    got = {q: [x[1:] for x in sorted(v)] for q, v in got.items()}
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 50)
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = random.Random(1)
    x = neighbours.unit(np.array([[rng.gauss(0, 1) ** 3 for _ in range(40)] for _ in range(200)]))
    codes, scale, lost = neighbours.quantise(x)
    about = neighbours.products(codes, codes) * scale[:, None] * scale
    bound = lost[:, None] + np.sqrt(((codes * scale[:, None]) ** 2).sum(axis=1))[:, None] * lost + 1e-9
    assert (np.abs(about - x @ x.T) <= bound).all()
    wide = np.full((2, 3000), 127, dtype=np.int8)
    assert neighbours.products(wide, wide)[0, 1] == 3000 * 127 * 127


def test_repeated_ids_among_equal_vectors(spark):
    rows = [(7, [1.0, 2.0])] * 6 + [(i, [1.0, 2.0]) for i in (8, 9, 10, 11, 12, 13)] + [(50, [1.0, 2.1]), (50, [1.0, 2.1]), (100, [1.0, 2.0]), (100, [1.0, 2.0])]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {50: [7, 8, 9, 10, 11], 100: [7, 8, 9, 10, 11]}
