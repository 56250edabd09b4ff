"""Audio: resampling by chunks. Chunk borders matter, as each chunk is transformed on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import ship


def resample(pcm: DataFrame, chunk: int, up: int, down: int) -> DataFrame:
    """(chunk, idx, sample) of pcm (idx, value) at up/down of its rate; null samples are silence.

    A chunk is one bounded group; its spectrum is cut or padded, and divided by the root of the rate to keep its energy.
    """
    ship(pcm.sparkSession)

    def run(key, t):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(t.column("idx").to_numpy(), kind="stable")
        x = np.nan_to_num(t.column("value").to_numpy()[order].astype(float))
        n = max(1, len(x) * up // down)
        spectrum = np.fft.rfft(x)
        kept = np.zeros(n // 2 + 1, complex)
        m = min(len(kept), len(spectrum))
        kept[:m] = spectrum[:m]
        y = np.fft.irfft(kept, n) * (n / len(x)) / np.sqrt(up / down)
        return pa.table({"chunk": pa.array([key[0].as_py()] * n, pa.int64()), "idx": pa.array(range(n), pa.int64()), "sample": pa.array(y, pa.float64())})

    rows = pcm.select(F.floor(F.col("idx") / chunk).alias("chunk"), "idx", "value")
    return rows.groupBy("chunk").applyInArrow(run, "chunk long, idx long, sample double")
