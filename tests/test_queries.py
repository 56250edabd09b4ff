"""Every query with SQL gives the SQL's rows."""

import os

import pytest

from rasterloom import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x != x else str(x) if isinstance(x, str) else round(float(x), 6)
    return sorted((tuple(map(plain, r)) for r in frame.values.tolist()), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_query(spark, duck, name):
    got, expected = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_resampling_keeps_energy(spark):
    out = catalog.QUERIES["audio_resample"](spark, DATA)
    assert out.count() == 750 and out.select("chunk").distinct().count() == 1


def test_resampling_a_tone(spark):
    import numpy as np

    from rasterloom.operators.audio import resample

    x = np.sin(2 * np.pi * 5 * np.arange(400) / 400)
    pcm = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, value double")
    y = np.array([r["sample"] for r in resample(pcm, 400, 3, 4).orderBy("idx").collect()])
    assert len(y) == 300 and np.allclose(y, np.sin(2 * np.pi * 5 * np.arange(300) / 300) / np.sqrt(0.75), atol=1e-9)
    assert abs((x**2).sum() - (y**2).sum()) < 1e-6
