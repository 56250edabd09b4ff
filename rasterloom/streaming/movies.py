"""Streaming encoder: frames' pages arrive as a stream; each movie's encoder state lives between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from rasterloom.operators import greedy
from rasterloom.session import ship

def encode_stream(pages: DataFrame, ops_per_frame: int, palette: int = 5, mode: str = "HGR") -> DataFrame:
    """Operations (as greedy.SCHEMA) for a stream of pages: (movie, frame, page, cells), for DHGR (movie, frame, page, main, aux).

    Frames of a movie must come in order; pages of one frame in one micro-batch. State is a movie's shown screen,
    priorities and operation count: 128 KiB a bank whatever the stream's length.
    """
    ship(pages.sparkSession)
    banks = ["cells"] if mode == "HGR" else ["main", "aux"]

    def step(key: tuple, batches: Iterable, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        encoder, seq, frames = greedy.Encoder(mode, palette), 0, {}
        for pdf in batches:
            for frame, page, *cells in zip(pdf["frame"], pdf["page"], *(pdf[b] for b in banks)):
                frames.setdefault(int(frame), np.zeros_like(encoder.screen))[int(page)] = np.stack(cells)
        if state.exists:
            encoder.screen, encoder.priority, seq = pickle.loads(state.get[0])
        rows = []
        for frame in sorted(frames):
            for op in greedy.budgeted(encoder, [frames[frame]], ops_per_frame, frame):
                rows.append((int(key[0]), seq, *op))
                seq += 1
        state.update((pickle.dumps((encoder.screen, encoder.priority, seq)),))
        yield pd.DataFrame(rows, columns=["movie", "seq", "frame", "bank", "page", "content", "offsets"])

    return pages.groupBy("movie").applyInPandasWithState(step, greedy.SCHEMA, "state binary", "append", "NoTimeout")


def replay_stream(ops: DataFrame) -> DataFrame:
    """The screens as they stand: the last store to each (movie, bank, page, offset); for update or complete mode."""
    writes = ops.select("movie", "bank", "page", F.explode("offsets").alias("off"), "content", "seq")
    return writes.groupBy("movie", "bank", "page", "off").agg(F.max_by("content", "seq").alias("content"))
