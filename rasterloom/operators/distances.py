"""Perceptual distance between what a screen shows and what it should show, cell by cell.

Texts are cut into pages, packed, masked and measured in numpy, some thousand pages at once, in one pass over the
documents without a shuffle: nothing of a page depends on another row. Each distinct (byte, source, target) of a batch is
measured once; the full table is never built. HGR has one bank (0), DHGR the main bank (0) and the auxiliary one (1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions import bits, colour
from rasterloom.session import ship

#: Fixed arithmetic for ties: spreads equal priorities over a frame.
NONCE = "(page * 131 + off * 29 + frame * 17) % 256"
_CELL = "movie long, frame int, page int, bank int, off int, byte int"


def masked_pixels(spark: SparkSession, mode: str) -> DataFrame:
    """(byte, masked, pixels): what each masked value shows; 2^15 rows for HGR, 2^15 for DHGR."""
    n, phases = 1 << bits.MASKED_BITS[mode], bits.PHASES[mode]
    rows = spark.range(len(phases) * n).select((F.col("id") / n).cast("int").alias("byte"), (F.col("id") % n).alias("masked"))
    if mode == "HGR":
        dots = F.expr(f"CASE WHEN byte = 0 THEN {bits.hgr_dots('masked', 0)} ELSE {bits.hgr_dots('masked', 1)} END")
    else:
        dots = F.col("masked")
    phase = F.get(F.array(*[F.lit(p) for p in phases]), F.col("byte"))
    shown = rows.select("byte", "masked", dots.alias("dots"), phase.alias("phase"))
    return shown.select("byte", "masked", colour.pixels(F.col("dots"), bits.PIXELS[mode], F.col("phase")).alias("pixels"))


def with_distance(cells: DataFrame, mode: str = "HGR", palette: int = 5) -> DataFrame:
    """cells (byte, src, dst, ...) with dist; equal values are at 0."""
    ship(cells.sparkSession)

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from rasterloom.functions.layouts import distances

        for b in batches:
            byte, src, dst = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("byte", "src", "dst"))
            yield b.append_column("dist", pa.array(distances(mode, palette)(byte, src, dst), pa.int32()))

    return cells.mapInArrow(run, T.StructType([*cells.schema.fields, T.StructField("dist", T.IntegerType())]))


def pair_distances(pairs: DataFrame, mode: str = "HGR", palette: int = 5) -> DataFrame:
    """(byte, lo, hi, dist) of the distinct pairs (byte, src, dst); each unordered pair is measured once."""
    once = pairs.select("byte", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    return with_distance(once.withColumnsRenamed({"lo": "src", "hi": "dst"}), mode, palette).withColumnsRenamed({"src": "lo", "dst": "hi"})


def _by_page(docs: DataFrame, mode: str, schema: str, found: Callable) -> DataFrame:
    """Rows that found(layout, movie, frame, page, now, before) gives, as columns, for batches of pages of docs (doc_id, text)."""
    ship(docs.sparkSession)
    movies = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("movie"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from rasterloom.functions.layouts import Layout, page_batches

        layout = Layout(mode)
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64() if c.split()[1] == "long" else pa.int32() for c in schema.split(", ")]
        for b in batches:
            ids = b.column(0)
            for movie, place, now, before in page_batches(layout, ids, b.column(1).to_pylist()):
                columns = found(layout, place // 32, place % 32, now, before)
                which = ids.take(pa.array(movie[columns[0]]))
                yield pa.record_batch([which, *(pa.array(np.ascontiguousarray(c).astype(np.int64 if k == pa.int64() else np.int32)) for c, k in zip(columns[1:], kinds[1:]))], names)

    return movies.mapInArrow(run, schema)


def _cells(layout, now, before):
    """(packed columns, wanted and present masked values) of pages, and the places (page row, bank, offset) where these differ."""
    import numpy as np

    from rasterloom.functions.layouts import HOLE

    packed = layout.pack(now)
    want, have = layout.mask(packed), layout.mask(layout.pack(before))
    return packed, want, have, np.nonzero((want != have) & ~HOLE)


def changed_cells(docs: DataFrame, mode: str = "HGR") -> DataFrame:
    """(movie, frame, page, bank, off, byte, src, dst, packed, value): visible cells whose masked values differ from the frame before."""

    def found(layout, frame, page, now, before):
        packed, want, have, (row, bank, off) = _cells(layout, now, before)
        return row, frame[row], page[row], bank, off, layout.byte[bank, off], have[row, bank, off], want[row, bank, off], packed[row, off // 2], now[row, bank, off]

    return _by_page(docs, mode, _CELL + ", src long, dst long, packed long, value long", found)


def diff_weights(docs: DataFrame, palette: int = 5, mode: str = "HGR") -> DataFrame:
    """(movie, frame, page, bank, off, byte, dist > 0): how far each visible cell is from the new frame."""

    def found(layout, frame, page, now, before):
        from rasterloom.functions.layouts import distances

        _, want, have, (row, bank, off) = _cells(layout, now, before)
        byte = layout.byte[bank, off]
        dist = distances(mode, palette)(byte, have[row, bank, off], want[row, bank, off])
        on = dist > 0
        row, bank, off = row[on], bank[on], off[on]
        return row, frame[row], page[row], bank, off, byte[on], dist[on]

    return _by_page(docs, mode, _CELL + ", dist int", found)


def accumulated(docs: DataFrame, palette: int = 5) -> DataFrame:
    """(movie, frame, page, priority > 0, most): sum and maximum of the cells' priorities, in HGR.

    A cell's distances add up over frames until one of them is 0. A movie's text is one row, so its frames follow each other
    in one task, which keeps the priorities of the movie it is in; there is no shuffle. A null id is no movie.
    """
    ship(docs.sparkSession)
    movies = docs.where("text <> '' AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("movie"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from rasterloom.functions.layouts import Layout, distances, page_batches

        layout, measure = Layout("HGR"), distances("HGR", palette)
        for b in batches:
            ids, held, at = b.column(0), np.zeros((32, 256), np.int64), -1
            for movie, place, now, before in page_batches(layout, ids, b.column(1).to_pylist()):
                _, want, have, cell = _cells(layout, now, before)
                priority = np.zeros(want.shape, np.int64)
                priority[cell] = measure(layout.byte[cell[1], cell[2]], have[cell], want[cell])
                priority = priority[:, 0]
                # Pages of first frames have nothing before them; the others go frame by frame, in the order of the rows.
                later = np.flatnonzero(place >= 32)
                starts = np.flatnonzero(np.diff(movie[later] * (1 << 40) + place[later] // 32, prepend=-1))
                for rows in np.split(later, starts[1:]) if len(later) else []:
                    row, page = rows[0], place[rows] % 32
                    if movie[row] != at:  # its frame before is of this batch, if it is not held
                        held[:], at = 0, movie[row]
                        first = np.flatnonzero((movie == at) & (place < 32))
                        held[place[first]] = priority[first]
                    priority[rows] += np.where(priority[rows] > 0, held[page], 0)
                    held[:] = 0  # pages that are not listed are blank in both frames
                    held[page] = priority[rows]
                # The next batch may go on with the last movie.
                if movie[-1] != at:
                    held[:], at = 0, movie[-1]
                    last = np.flatnonzero(movie == at)
                    held[place[last] % 32] = priority[last]
                total = priority.sum(1)
                on = np.flatnonzero(total)
                yield pa.record_batch([ids.take(pa.array(movie[on])), pa.array((place[on] // 32).astype(np.int32)), pa.array((place[on] % 32).astype(np.int32)), pa.array(total[on]), pa.array(priority.max(1)[on])], ["movie", "frame", "page", "priority", "most"])

    return movies.mapInArrow(run, "movie long, frame int, page int, priority long, most long")


def _gains(layout, mode: str, palette: int, frame, page, now, before):
    """(page row, bank, content, first, delta) of each page and bank that has a cell to change.

    content: the one of its worst cell, `first`. delta: what storing it at each of the 256 cells would add to the error,
    0 in holes and at the first. The error compares the target with the content stored against the target itself.
    """
    import numpy as np

    from rasterloom.functions.layouts import HOLE, distances

    measure = distances(mode, palette)
    packed, want, have, at = _cells(layout, now, before)
    weight = np.zeros(want.shape, np.int64)
    weight[at] = measure(layout.byte[at[1], at[2]], have[at], want[at])
    order = _order(weight, frame, page)
    first = order.argmax(2)
    content = np.take_along_axis(now, first[..., None], 2)[..., 0]
    stored = layout.store(packed, content)
    row, bank = np.nonzero(weight.any(2))
    stored, target, weight, first, content = stored[row, bank], want[row, bank], weight[row, bank], first[row, bank], content[row, bank]
    error = measure(layout.byte[bank].ravel(), stored.ravel(), target.ravel()).reshape(-1, 256)
    delta = np.where(HOLE, 0, error - weight)
    delta[np.arange(len(row)), first] = 0
    return row, bank, content, first, delta


def _order(value, frame, page):
    """Numbers that are larger for larger values, and for equal ones by nonce and offset: [page row, bank, 256]."""
    import numpy as np

    off = np.arange(256)
    nonce = (page[:, None] * 131 + off * 29 + frame[:, None] * 17) % 256
    return (value << 16) + ((255 - nonce) << 8)[:, None] + (255 - off)


def page_gains(docs: DataFrame, palette: int = 5, mode: str = "HGR") -> DataFrame:
    """(movie, frame, page, bank, content, off, delta): what storing the content of a page's worst cell at its others would add to the error."""

    def found(layout, frame, page, now, before):
        import numpy as np

        from rasterloom.functions.layouts import HOLE

        row, bank, content, first, delta = _gains(layout, mode, palette, frame, page, now, before)
        i, off = np.nonzero(~HOLE & (np.arange(256) != first[:, None]))
        return row[i], frame[row[i]], page[row[i]], bank[i], content[i], off, delta[i, off]

    return _by_page(docs, mode, "movie long, frame int, page int, bank int, content long, off int, delta int", found)


def best_offsets(docs: DataFrame, k: int = 2, palette: int = 5, mode: str = "HGR") -> DataFrame:
    """(movie, frame, page, bank, content, off, delta, rank): of page_gains, the k that bring most."""

    def found(layout, frame, page, now, before):
        import numpy as np

        row, bank, content, _, delta = _gains(layout, mode, palette, frame, page, now, before)
        best = np.argsort(-_order(-delta[:, None], frame[row], page[row])[:, 0], axis=1)[:, :k]
        gain = np.take_along_axis(delta, best, 1)
        i, rank = np.nonzero(gain < 0)
        return row[i], frame[row[i]], page[row[i]], bank[i], content[i], best[i, rank], gain[i, rank], rank + 1

    return _by_page(docs, mode, "movie long, frame int, page int, bank int, content long, off int, delta int, rank int", found)
