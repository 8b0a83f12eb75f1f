"""Hard negatives: products, heaps, the grid of cells and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratebook.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, row int, anchor string, q string"


def test_products_of_every_shape_are_exact():
    rng = np.random.default_rng(0)
    for shape in ((1, 1, 1), (3, 5, 7), (40, 64, 33), (65, 65, 65), (0, 4, 3), (17, 0, 20)):
        n, d, m = shape
        a, b = rng.integers(-1 << 29, 1 << 29, (n, d)), rng.integers(-1 << 28, 1 << 28, (d, m))
        assert np.array_equal(H.strassen(a, b, 4), a @ b)
    big = np.array([[1 << 40, 3], [-(1 << 62), 1]])
    assert H.scores(big, big).tolist() == [[np.iinfo(np.int64).max, np.iinfo(np.int64).min], [np.iinfo(np.int64).min, np.iinfo(np.int64).max]]


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 5, 300), rng.integers(0, 9, 300), rng.integers(0, 40, 300), np.arange(300)])
    want = [r for o in range(5) for r in sorted(x[x[:, 0] == o].tolist(), key=lambda r: (-r[1], r[2], r[3]))[:4]]
    assert H.merged(4, *(H.merged(4, part) for part in np.array_split(x, 7))).tolist() == want


def by_hand(rows, low=80, high=100):
    """Plain loops over distinct sound rows."""
    sound = []
    for i, v, label, *_ in rows:
        if None not in (i, v, label) and all(c is not None and np.isfinite(c) for c in v):
            r = (i, tuple(int(np.floor(256 * c)) for c in v), label)
            if r not in sound:
                sound.append(r)
    out = []
    for a in sound:
        if a[0] % 100:
            continue
        score = {r: sum(x * y for x, y in zip(a[1], r[1])) for r in sound if r is not a}
        first = sorted((r for r in score if r[2] == a[2]), key=lambda r: (-score[r], r[0]))[:5]
        for p in first:
            fit = [r for r in score if r[2] != a[2] and low * score[p] <= 100 * score[r] <= high * score[p]]
            for rank, r in enumerate(sorted(fit, key=lambda r: (-score[r], r[0]))[:5], 1):
                out.append((a[0], p[0], rank, r[0], score[p], score[r]))
    return sorted(out)


@pytest.mark.parametrize("cell", [H.CELL, (3, 40)])
def test_same_rows_as_loops(spark, cell):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist(), int(rng.integers(0, 3))) for i in range(0, 1500, 5)]
    rows += [(2000 + i, rows[3][1], i % 2) for i in range(120)]  # many equal vectors: ties
    rows += [(100, None, 1), (None, [1.0] * 6, 1), (201, [1.0] * 6, None), (202, [1.0, None], 1), (203, [float("nan")] * 6, 1),
             (204, [float("inf")] * 6, 0), (300, [], 1), (205, [1.0, 2.0], 2), (200, [0.5] * 6, 2)]
    rows += rows[:30]  # repeated rows
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = H.mine(df, F.col("vec_id") % 100 == 0, cell=cell)
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows)


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([(100, [1.0], 1, 1, "x", "y"), (101, [1.0], 2, 1, "x", "y")], SCHEMA)
    is_anchor = F.col("vec_id") % 100 == 0
    assert H.mine(df, is_anchor).count() == 0
    assert H.mine(df.limit(0), is_anchor).count() == 0
