"""Packing: documents' tokens into windows of one capacity by Karmarkar-Karp multiway differencing.

Each task packs the documents it reads, so no text and no token is shuffled and no key can make a task large.
Full windows of a long document stand alone. What is left of each document waits, in pieces, until a batch of
`windows` windows is full; differencing then deals the batch's pieces to near-equal windows. When a window exceeds
the capacity, the number of windows rises by one and the batch is dealt again.

Nulls and edges: a null text is empty, and an empty text is its end token alone; a null id stays null in the
result; repeated rows are packed once each; an empty table gives no pieces; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from rasterloom.llm.common import columns

SCHEMA = "doc_id long, start long, length long, token_bytes binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Deals items to `windows` windows with near-equal sums: the indices of each window's items.

    A partial partition is its windows' sums, ascending and less their minimum, each with a chain of its items: first,
    last, and each item's follower. The two partitions with the widest imbalance are merged, the fullest windows of one
    with the emptiest of the other.
    """
    import numpy as np

    if not sizes:
        return [[] for _ in range(windows)]
    heap = []
    for i, s in enumerate(sizes):
        sums, chain = np.zeros(windows, np.int64), np.full((2, windows), -1, np.int64)
        sums[-1], chain[:, -1] = s, i
        heap.append((-s, i, sums, chain))
    heapq.heapify(heap)
    follower = np.full(len(sizes), -1, np.int64)
    while len(heap) > 1:
        _, i, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        order = sums.argsort(kind="stable")
        x, y = x[:, order], y[:, ::-1][:, order]
        both = (x[0] >= 0) & (y[0] >= 0)
        follower[x[1, both]] = y[0, both]
        chain = np.stack([np.where(x[0] >= 0, x[0], y[0]), np.where(y[1] >= 0, y[1], x[1])])
        sums = sums[order]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), i, sums, chain))
    follower, out = follower.tolist(), []
    for at in heap[0][3][0].tolist():
        items = []
        while at >= 0:
            items.append(at)
            at = follower[at]
        out.append(sorted(items))
    return out


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the sum's need upwards, that differencing fills without exceeding the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return [w for w in dealt if w]
        windows += 1


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, windows: int = 128, piece: int = 512, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it starts in its document, its ids (little-endian uint32), its window and its place there.

    piece: remainders are cut into pieces of at most that many tokens, so that differencing has enough of them.
    """
    rows = columns(docs, **{id_col: "long", text_col: "string"})

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from rasterloom.llm.subwords import encoder

        state = Packer(encoder(tokenizer).encode_many, TaskContext.get().partitionId() << 32, capacity, windows, piece, end_id)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("token_bytes", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                state.add(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
                if len(state.out) >= 4096:
                    yield state.take(schema)
        state.finish()
        if state.out:
            yield state.take(schema)

    return rows.mapInArrow(run, SCHEMA)


class Packer:
    """The packing state of one task: pieces that wait for a batch, and finished rows."""

    def __init__(self, encode, first: int, capacity: int, windows: int, piece: int, end_id: int):
        self.encode, self.next, self.capacity, self.windows, self.piece = encode, first, capacity, windows, piece
        self.end = end_id.to_bytes(4, "little")
        self.wait, self.held, self.out = [], 0, []

    def add(self, ids: list, texts: list[str]) -> None:
        for doc, tokens in zip(ids, self.encode(texts)):
            tokens += self.end
            n, at = len(tokens) // 4, 0
            while n - at >= self.capacity:
                self._row(doc, at, tokens[4 * at : 4 * (at + self.capacity)], n, self.next, 0)
                self.next += 1
                at += self.capacity
            while at < n:  # a batch can end within a document
                # Differencing leaves a few tokens of imbalance a window; the batch keeps that much room.
                room = self.windows * (self.capacity - self.capacity // 160) - self.held
                # The batch's last pieces are small: they even out what the large ones leave.
                step = min(n - at, self.piece if room > self.windows * 12 else max(1, self.capacity // 128), max(room, 1))
                self.wait.append((doc, at, tokens[4 * at : 4 * (at + step)], n))
                self.held += step
                at += step
                if self.held >= self.windows * (self.capacity - self.capacity // 160):
                    self.finish()

    def finish(self) -> None:
        sizes = [len(p[2]) // 4 for p in self.wait]
        for window in deal(sizes, self.capacity) if sizes else []:
            offset = 0
            for i in window:
                doc, at, tokens, n = self.wait[i]
                self._row(doc, at, tokens, n, self.next, offset)
                offset += sizes[i]
            self.next += 1
        self.wait, self.held = [], 0

    def _row(self, doc, at: int, tokens: bytes, n: int, sequence: int, offset: int) -> None:
        self.out.append((doc, at, len(tokens) // 4, tokens, n, sequence, offset))

    def take(self, schema):
        import pyarrow as pa

        cols, self.out = list(zip(*self.out)), []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
