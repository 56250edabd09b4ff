"""Merged movies: one operation per audio sample, as the byte stream that the player reads.

The stream begins with a header of an operation's size. Each sample then gives a tick operation: the address of its
handler, which says how long the speaker stays on and which page is stored to, a content byte and four offsets. 2048
bytes are 292 operations and an acknowledgement, at which a two-bank mode changes the bank. The target advances when the
ticks of a video frame are over; a bank without work stores to the screen's first cell. The end mark comes when samples
or frames run out or the limit is reached, then zeros to a multiple of 2048.

Nulls and edges: a null or empty text has no frames, and a movie without samples no operations: header, end mark and
zeros; levels outside -15 to 16 are cut to that; movies with equal ids take the same samples.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.greedy import Encoder, frames
from rasterloom.session import ship

# Bytes of a stream frame and an operation, operations a frame, the player's video modes and bank switches.
FRAME, OP, OPS, MODES, SWITCH = 2048, 7, 292, {"HGR": 0, "DHGR": 1}, (0x54, 0x55)


def handlers(addresses: dict[str, int]) -> dict[str, int]:
    """The addresses of the operations, checked to be complete and not zero; names as in the player: ack, tick_4_page_32."""
    need = ["header", "terminate", "nop", "ack", *(f"tick_{t}_page_{p}" for t in range(4, 68, 2) for p in range(32, 64))]
    if missing := [n for n in need if not addresses.get(n)]:
        raise ValueError(f"no address for {missing[:5]}")
    return {n: addresses[n] for n in need}


def operations(text: str, levels: Iterable[int], mode: str, palette: int, ticks_per_frame: float, every: int, bank_of) -> Iterator[tuple[int, int, int, list[int]]]:
    """(tick, page, content, offsets) for each level; bank_of() is the bank that stores go to when an operation is asked for."""
    encoder = Encoder(mode, palette)
    source, number, target, work, last = frames(encoder.layout, text), 0, None, iter(()), bank_of()
    for tick, level in enumerate(levels, 1):
        bank = bank_of()
        if tick >= ticks_per_frame * number:
            number += 1
            new = next(source, None)
            if new is None:
                return
            if (number - 1) % every == 0:
                target, last = new, bank
                work = encoder.operations(target, number - 1, bank)
        if bank != last:
            last, work = bank, encoder.operations(target, number - 1, bank)
        page, content, offsets = next(work, None) or (32, int(target[0, bank, 0]), [0, 0, 0, 0])
        yield 2 * min(16, max(-15, level)) + 34, page, content, offsets


def stream(text: str, levels: Iterable[int], addresses: dict[str, int], mode: str = "HGR", palette: int = 5, ticks_per_frame: float = 490.0, every: int = 1, limit: int | None = None) -> Iterator[bytes]:
    """The stream's frames of 2048 bytes."""
    bank, banks = [0], 1 if mode == "HGR" else 2
    out = bytearray([255] * 6 + [MODES[mode]])
    sent = 0
    for tick, page, content, offsets in operations(text, levels, mode, palette, ticks_per_frame, every, lambda: bank[0]):
        if limit is not None and sent + len(out) >= limit:
            break
        out += addresses[f"tick_{tick}_page_{page}"].to_bytes(2, "big") + bytes([content, *offsets])
        if len(out) >= FRAME - 4:
            bank[0] = (bank[0] + 1) % banks
            out += addresses["ack"].to_bytes(2, "big") + bytes([SWITCH[bank[0]], 255])
            yield bytes(out)
            sent += FRAME
            out.clear()
    out += addresses["terminate"].to_bytes(2, "big")
    yield bytes(out).ljust(FRAME, b"\0")


def encode(docs: DataFrame, audio: DataFrame, addresses: dict[str, int], mode: str = "HGR", palette: int = 5, ticks_per_frame: float = 490.0, every: int = 1, limit: int | None = None) -> DataFrame:
    """(movie, frame, data): the streams of docs (doc_id, text) with audio (movie, idx, level), 2048 bytes a row."""
    ship(docs.sparkSession)
    table = handlers(addresses)
    tracks = audio.groupBy("movie").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("level").cast("tinyint").alias("level")))), lambda x: x["level"]).alias("levels"))
    movies = docs.select(F.col("doc_id").cast("long").alias("movie"), F.col("text").cast("string").alias("text")).join(tracks, "movie", "left")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for movie, text, levels in zip(b.column("movie").to_pylist(), b.column("text"), b.column("levels")):
                numbers = levels.values.to_pylist() if levels.is_valid else []
                made: list[bytes] = []
                at = 0
                for data in stream(text.as_py() or "", numbers, table, mode, palette, ticks_per_frame, every, limit):
                    made.append(data)
                    if len(made) == 512:
                        yield pa.record_batch([pa.array([movie] * len(made), pa.int64()), pa.array(range(at, at + len(made)), pa.int64()), pa.array(made, pa.binary())], ["movie", "frame", "data"])
                        at, made = at + len(made), []
                yield pa.record_batch([pa.array([movie] * len(made), pa.int64()), pa.array(range(at, at + len(made)), pa.int64()), pa.array(made, pa.binary())], ["movie", "frame", "data"])

    return movies.mapInArrow(run, "movie long, frame long, data binary")


def decode(frames_: DataFrame, addresses: dict[str, int]) -> DataFrame:
    """(movie, seq, name, content, offsets) of streams (movie, frame, data): every operation, the header first, until the end mark."""
    spark = frames_.sparkSession
    names = spark.createDataFrame([(n, a) for n, a in handlers(addresses).items()], "name string, address int")
    places = F.expr(f"transform(sequence(0, {OPS}), i -> struct(i AS i, hex(substring(data, {OP} * i + 1, {OP})) AS h))")
    each = frames_.select("movie", "frame", F.explode(places).alias("x")).select("movie", (F.col("frame") * (OPS + 1) + F.col("x.i")).alias("seq"), "x.h")
    byte = lambda i: F.conv(F.substring("h", 2 * i + 1, 2), 16, 10).cast("int")
    read = each.select("movie", "seq", F.conv(F.substring("h", 1, 4), 16, 10).cast("int").alias("address"), byte(2).alias("content"), F.array(*[byte(i) for i in range(3, OP)]).alias("offsets"))
    known = read.join(F.broadcast(names), "address", "left").select("movie", "seq", F.when(F.col("seq") == 0, "header").otherwise(F.col("name")).alias("name"), "content", "offsets")
    stop = known.where("name = 'terminate'").groupBy("movie").agg(F.min("seq").alias("stop"))
    kept = known.join(stop, "movie").where("seq <= stop").drop("stop")
    tick = F.col("name").startswith("tick")
    return kept.select("movie", "seq", "name", F.when(tick | (F.col("name") == "ack"), F.col("content")).alias("content"), F.when(tick, F.col("offsets")).alias("offsets"))


def save(frames_: DataFrame, movie: int, path: str) -> int:
    """Writes one movie's stream to a local file, frame by frame; gives the number of bytes."""
    n = 0
    with open(path, "wb") as out:
        for r in frames_.where(F.col("movie") == movie).orderBy("frame").toLocalIterator():
            n += out.write(r["data"])
    return n


def write(frames_: DataFrame, path: str) -> None:
    """Writes all streams as Parquet, each movie's frames together and in order."""
    frames_.repartition("movie").sortWithinPartitions("movie", "frame").write.mode("overwrite").parquet(path)
