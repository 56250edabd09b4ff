"""CIEDE2000 against published pairs; pixel distances against the full dynamic programme."""

import random

import numpy as np
import pytest

from rasterloom.functions import colour


@pytest.mark.parametrize("one, two, expected", [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, 2.49, -0.001), (50, -2.49, 0.0011), 7.2195), ((50, 2.5, 0), (50, 0, -2.5), 4.3065), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082)])
def test_ciede2000(one, two, expected):
    assert round(colour.ciede2000(one, two), 4) == expected


def test_costs():
    for palette in colour.PALETTES:
        c = np.array(colour.costs(palette)).reshape(16, 16)
        assert (c == c.T).all() and not c.diagonal().any() and c.max() < 256
    assert colour.costs(5)[5 * 16 + 10] == 0  # its greys are one colour
    assert colour.costs(0)[5 * 16 + 10] > 0


def full(a, b, cost):
    """Damerau-Levenshtein with insertions and deletions at 100000 and swaps at 1."""
    n = len(a)
    d = np.full((n + 1, n + 1), 0.0)
    d[:, 0] = d[0] = np.arange(n + 1) * 100000
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            d[i, j] = min(d[i - 1, j] + 100000, d[i, j - 1] + 100000, d[i - 1, j - 1] + cost[a[i - 1], b[j - 1]])
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[n, n]


def test_pixel_distance(spark):
    from pyspark.sql import functions as F

    rnd, cost = random.Random(4), np.array(colour.costs(5)).reshape(16, 16)
    rows = [([rnd.randrange(4) for _ in range(10)], [rnd.randrange(4) for _ in range(10)]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<int>, b array<int>").select("a", "b", colour.pixel_distance(F.col("a"), F.col("b"), 10, 5).alias("d")).collect()
    assert all(r["d"] == full(r["a"], r["b"], cost) for r in got)


def test_kernel_agrees_with_expression(spark):
    """The numpy distances and the SQL dynamic programme, for all modes and palettes."""
    from pyspark.sql import functions as F

    from rasterloom.functions import bits, layouts
    from rasterloom.operators.distances import masked_pixels

    rnd = np.random.default_rng(2)
    for mode in ("HGR", "DHGR"):
        n, shown = 1 << bits.MASKED_BITS[mode], masked_pixels(spark, mode)
        byte, src, dst = rnd.integers(0, len(bits.PHASES[mode]), 80), rnd.integers(0, n, 80), rnd.integers(0, n, 80)
        pairs = spark.createDataFrame([(i, int(b), int(s), int(d)) for i, (b, s, d) in enumerate(zip(byte, src, dst))], "i long, byte int, src long, dst long")
        both = pairs.join(shown.toDF("byte", "src", "a"), ["byte", "src"]).join(shown.toDF("byte", "dst", "b"), ["byte", "dst"])
        for palette in colour.PALETTES:
            rows = both.select("i", colour.pixel_distance(F.col("a"), F.col("b"), bits.PIXELS[mode], palette).alias("dist")).collect()
            mine = layouts.Distances(mode, palette)(byte, src, dst)
            assert {r["i"]: r["dist"] for r in rows} == dict(enumerate(mine.tolist())) and len(rows) == 80
    many = rnd.integers(0, 1 << 13, (2, 9000))
    measure = layouts.Distances("DHGR", 5)
    whole = measure(many[0] % 4, many[0], many[1])  # a large call measures distinct pairs
    assert (whole == np.concatenate([measure(m[0] % 4, m[0], m[1]) for m in np.split(many, 9, 1)])).all()
