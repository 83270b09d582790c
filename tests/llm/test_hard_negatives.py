import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm.hard_negatives import Packing, mine

SCHEMA = "vec_id long, embedding array<double>, label int, n int, line string, score long"


def brute(rows, positives=5, negatives=10):
    """``rows`` are (vec_id, vector, label); every tenth id is an anchor."""
    fit = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows
           if i is not None and v is not None and g is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for a, anchor in enumerate(fit):
        if anchor[0] % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(anchor[1], v)), i, g == anchor[2]) for b, (i, v, g) in enumerate(fit) if b != a)
        for score, positive, _ in [s for s in scored if s[2]][:positives]:
            found = [(i, -s) for s, i, same in scored if not same and -30 * score <= -100 * s <= -90 * score][:negatives]
            out += [(anchor[0], positive, r, i, -score, s) for r, (i, s) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **arguments):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = mine(df, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0, **arguments)
    return sorted(map(tuple, got.collect()))


def vectors(n, size, seed, scale=1.0, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=size)
    return [(i, ((rng.normal(size=size) * 0.5 + middle) * scale).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("group", [7, 16384])
def test_equals_brute_force(spark, group):
    rows = vectors(120, 6, 3)
    rows += [(200 + i, rows[i % 3][1], i % 3) for i in range(30)]  # many ties
    assert mined(spark, rows, group=group) == brute(rows)
    assert len(brute(rows)) > 100


def test_wide_and_mixed_components(spark):
    rows = vectors(40, 4, 5, scale=1e4) + [(100, [1e15, 3.0, -2e15, 0.5], 1), (101, [1e15, 1.0], 1), (103, [7e14, 1e3, -1e15], 2)]
    want = brute([(i, v + [0.0] * (4 - len(v)), g) for i, v, g in rows])
    clipped = [(*w[:4], min(w[4], 2 ** 63 - 1), min(w[5], 2 ** 63 - 1)) for w in want]
    assert mined(spark, rows, group=9) == sorted(clipped)
    assert any(w[4] > 2 ** 63 for w in want)


def test_rows_that_take_no_part(spark):
    rows = vectors(60, 3, 8)
    odd = [(None, [1.0, 1.0, 1.0], 1), (300, None, 1), (301, [1.0, None, 2.0], 1), (302, [float("nan"), 1.0, 1.0], 1),
           (303, [float("inf"), 1.0, 1.0], 1), (304, [1e307, 1.0, 1.0], 1), (310, [1.0, 1.0, 1.0], None), (305, [], 1)]
    assert mined(spark, rows + odd) == brute(rows + odd)


def test_repeated_rows_and_empty_tables(spark):
    rows = vectors(30, 3, 9, labels=2)
    rows += [rows[10], rows[10], rows[11]]
    assert mined(spark, rows, group=5) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    assert mined(spark, [(10, [1.0], 1)]) == []


def test_fields_hold_exact_scores():
    rng = np.random.default_rng(2)
    for top in (3, 200, 1 << 20, 1 << 40):
        rows = [rng.integers(-top, top, 5).astype(float) for _ in range(11)]
        packing = Packing(5, min(map(min, rows)), max(map(max, rows)), max(np.abs(r).sum() for r in rows))
        whole = packing.whole(rows)
        exact = np.array([[int(sum(int(x) * int(y) for x, y in zip(a, b))) for b in rows] for a in rows], object)
        assert (packing.scores(packing.pack(whole), whole, len(rows)) == exact).all()
    assert Packing(64, -140, 140, 1600.0).fields == 3
