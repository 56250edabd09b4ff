"""Queries of the opcode stream: rates, banks, framing, bytes, replay, audio."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.plans.book import both, query
from rasterloom.sources import files
from rasterloom.sources.screens import table

# A stream frame is 2048 bytes, 292 operations of 7 bytes and a four-byte acknowledgement; operation 0 is the header.
FRAME, OPS, OP_BYTES = 2048, 292, 7
# Audio ticks a second, machine cycles a tick, frames a second of the derived movies.
BITRATE, CYCLES, FPS = 14700, 73, 30
DIV = "cast(floor({} / {}) AS bigint)"
SEQ = "e.event_id + 1"  # operation 0 is the header
STORES = f"SELECT e.event_id + 1 AS seq, 32 + e.user_id % 32 AS page, (e.event_id * 7) % 256 AS off0, (e.event_id * 11) % 256 AS off1, (e.event_id * 13) % 256 AS off2, (e.event_id * 7) % 256 AS off3, cast(floor(e.value) AS bigint) & 127 AS content, {DIV.format('(e.event_id + 1)', OPS)} % 2 AS bank FROM {{events}} e"

both("opcode_dim", f"SELECT 4 + 2 * t.id AS tick, 32 + p.id AS page, concat('TICK_', 4 + 2 * t.id, '_PAGE_', 32 + p.id) AS name, CASE WHEN 4 + 2 * t.id IN (22, 40) THEN 4 + 2 * t.id - 1 ELSE 4 + 2 * t.id END AS cycles_high, {CYCLES} AS cycles FROM {{r32}} t CROSS JOIN {{r32}} p", ranges=(32,))
both("bank_schedule", f"SELECT {SEQ} AS tick, {DIV.format(f'({SEQ})', OPS)} % 2 AS bank FROM {{events}} e", tables=("events",))
both("stream_frames", f"SELECT {SEQ} AS seq, {DIV.format(f'({SEQ})', OPS)} AS frame, {DIV.format(f'({SEQ})', OPS)} * {FRAME} + ({SEQ}) % {OPS} * {OP_BYTES} AS pos, CASE WHEN ({SEQ}) % {OPS} = {OPS - 1} THEN 1 ELSE 0 END AS ack_follows FROM {{events}} e", tables=("events",))
both("ring_address", f"SELECT {SEQ} AS seq, ({DIV.format(f'({SEQ})', OPS)} * {FRAME} + ({SEQ}) % {OPS} * {OP_BYTES}) % 8192 AS ring, ({SEQ}) * {OP_BYTES} % 32768 AS pointer FROM {{events}} e", tables=("events",))
both("stream_limit", f"SELECT seq, pos FROM (SELECT {SEQ} AS seq, {DIV.format(f'({SEQ})', OPS)} * {FRAME} + ({SEQ}) % {OPS} * {OP_BYTES} AS pos FROM {{events}} e) WHERE pos < 40000", tables=("events",))
both("frame_sample", f"SELECT f.id AS frame_number, n.id + 1 AS every FROM {{r1000}} f CROSS JOIN {{r4}} n WHERE f.id > 0 AND (f.id - 1) % (n.id + 1) = 0", ranges=(1000, 4))
both("av_asof", f"SELECT {SEQ} AS tick, {DIV.format(f'({SEQ}) * {FPS}', BITRATE)} + 1 AS frame_number FROM {{events}} e", tables=("events",))
both("duty_cycle", "SELECT id - 15 AS level, (id - 15) * 2 + 34 AS duty FROM {r32}", ranges=(32,))
both("pad_offsets", "SELECT event_id AS seq, (event_id * 7) % 256 AS o0, CASE WHEN event_id % 3 > 0 THEN (event_id * 11) % 256 ELSE (event_id * 7) % 256 END AS o1, CASE WHEN event_id % 3 > 1 THEN (event_id * 13) % 256 ELSE (event_id * 7) % 256 END AS o2, (event_id * 7) % 256 AS o3 FROM {events}", tables=("events",))
both("pad_ops", "SELECT t.id AS seq, coalesce(s.page, 32) AS page, coalesce(s.content, 0) AS content, coalesce(s.off, 0) AS o0 FROM (SELECT event_id AS id FROM {events}) t LEFT JOIN (SELECT event_id AS seq, 32 + user_id % 32 AS page, cast(floor(value) AS bigint) & 255 AS content, (event_id * 7) % 256 AS off FROM {events} WHERE event_id % 5 <> 0) s ON s.seq = t.id", tables=("events",))
both("op_arity", "SELECT event_id AS seq, 1 + event_id % 5 AS n FROM {events} WHERE 1 + event_id % 5 <> 4", tables=("events",))
both("op_equality", f"WITH s AS ({STORES}) SELECT a.seq, CASE WHEN a.page = b.page AND a.content = b.content AND a.off0 = b.off0 AND a.off1 = b.off1 THEN 1 ELSE 0 END AS same FROM s a JOIN s b ON b.seq = a.seq + 256", tables=("events",))

both("av_zip", f"WITH o AS ({STORES}), a AS (SELECT e.event_id + 1 AS seq, 4 + 2 * (e.user_id % 32) AS tick FROM {{events}} e) SELECT o.seq, a.tick, o.page, o.content FROM o JOIN a ON a.seq = o.seq", tables=("events",))
both("duty_histogram", f"SELECT 4 + 2 * (user_id % 32) AS tick, count(*) AS ops, count(*) * {CYCLES} AS cycles FROM {{events}} GROUP BY 4 + 2 * (user_id % 32)", tables=("events",))
both("audio_src", "SELECT event_id AS idx, value AS sample FROM {events}", tables=("events",))
both("audio_mono", "SELECT idx, sum(sample) / count(sample) AS mono FROM (SELECT cast(floor(event_id / 2) AS bigint) AS idx, value AS sample FROM {events}) GROUP BY idx", tables=("events",))
#: (tick, page, address) of the handlers, as a debug file names them.
HANDLERS = [(int(t), int(p), int(a, 16)) for t, p, a in (re.search(r'op_tick_(\d+)_page_(\d+)".*val=0x(\w+)', line).groups() for _, line in files.handler_lines()[4:])]
_TICKS = ("tick long, page long, address long", HANDLERS)
NEXT_BYTE = "CASE b.id WHEN 0 THEN s.address >> 8 WHEN 1 THEN s.address & 255 WHEN 2 THEN s.content WHEN 3 THEN s.off0 WHEN 4 THEN s.off1 WHEN 5 THEN s.off2 ELSE s.off3 END"
TICKED = f"WITH s AS (SELECT x.*, o.tick, o.address FROM ({STORES}) x JOIN {{ops}} o ON o.tick = 4 + 2 * (x.seq % 32) AND o.page = x.page)"
POS = f"{DIV.format('s.seq', OPS)} * {FRAME} + s.seq % {OPS} * {OP_BYTES}"
both("op_bytes", f"{TICKED} SELECT s.seq, b.id AS at, {NEXT_BYTE} AS byte FROM s CROSS JOIN {{r7}} b", tables=("events",), ranges=(7,), ops=_TICKS)
both("stream_tail", f"WITH n AS (SELECT max({POS.replace('s.seq', '(event_id + 1)')}) + {OP_BYTES} AS stop FROM {{events}}) SELECT stop + b.id AS pos, CASE WHEN b.id = 0 THEN 129 WHEN b.id = 1 THEN 215 ELSE 0 END AS byte FROM n CROSS JOIN {{r4096}} b WHERE b.id < 2 + {FRAME} - (stop + 2) % {FRAME}", tables=("events",), ranges=(4096,))
both("byte_stream", f"{TICKED}, bytes AS (SELECT {POS} + b.id AS pos, {NEXT_BYTE} AS byte FROM s CROSS JOIN {{r7}} b UNION ALL SELECT b.id AS pos, CASE WHEN b.id < 6 THEN 255 ELSE 1 END AS byte FROM {{r7}} b UNION ALL SELECT {DIV.format('s.seq', OPS)} * {FRAME} + {FRAME - 4} + b.id AS pos, CASE b.id WHEN 0 THEN 129 WHEN 1 THEN 250 WHEN 2 THEN 84 + ({DIV.format('s.seq', OPS)} + 1) % 2 ELSE 255 END AS byte FROM s CROSS JOIN {{r4}} b WHERE s.seq % {OPS} = {OPS - 1}) SELECT cast(floor(pos / {FRAME}) AS bigint) AS frame, count(*) AS bytes, sum(byte) AS total, sum(byte * (pos % {FRAME} + 1)) AS weighted FROM bytes GROUP BY cast(floor(pos / {FRAME}) AS bigint)", tables=("events",), ranges=(7, 4), ops=_TICKS)
both("stream_decode", f"{TICKED}, bytes AS (SELECT {POS} + b.id AS pos, {NEXT_BYTE} AS byte FROM s CROSS JOIN {{r7}} b), parts AS (SELECT cast(floor(pos / {FRAME}) AS bigint) * {OPS} + cast(floor(pos % {FRAME} / {OP_BYTES}) AS bigint) AS seq, pos % {FRAME} % {OP_BYTES} AS place, byte FROM bytes) SELECT seq, sum(CASE place WHEN 0 THEN byte * 256 WHEN 1 THEN byte ELSE 0 END) AS address, sum(CASE WHEN place = 2 THEN byte ELSE 0 END) AS content, sum(CASE WHEN place = 3 THEN byte ELSE 0 END) AS off0, sum(CASE WHEN place = 6 THEN byte ELSE 0 END) AS off3 FROM parts GROUP BY seq", tables=("events",), ranges=(7,), ops=_TICKS)


@query(f"WITH s AS ({STORES.format(events='events')}), w AS (SELECT bank, page, unnest([off0, off1, off2, off3]) AS off, content, seq FROM s) SELECT bank, page, off, arg_max(content, seq) AS content, max(seq) AS seq FROM w GROUP BY ALL")
def replay_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen after all operations: the last store to each cell."""
    ops = spark.sql(STORES, events=table(spark, sf_dir, "events"))
    writes = ops.select("bank", "page", F.explode(F.array("off0", "off1", "off2", "off3")).alias("off"), "content", "seq")
    return writes.groupBy("bank", "page", "off").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))


@query(f"WITH s AS ({STORES.format(events='events')}), w AS (SELECT bank, page - 32 AS page, unnest([off0, off1, off2, off3]) AS off, content, seq FROM s), c AS (SELECT bank, page, off, arg_max(content, seq) AS v FROM w GROUP BY ALL), b AS (SELECT bank, page, off // 2 AS col, sum(v << (3 + 9 * (off % 2)))::BIGINT AS body FROM c GROUP BY ALL), g AS (SELECT p.bank, p.page, r.range AS col, coalesce(b.body, 0) AS body FROM (SELECT DISTINCT bank, page FROM c) p CROSS JOIN range(128) r LEFT JOIN b ON b.bank = p.bank AND b.page = p.page AND b.col = r.range) SELECT bank, page, col, body + ((coalesce(lag(body) OVER w, 0) >> 17) & 3) + ((coalesce(lead(body) OVER w, 0) >> 3 & 3) << 20) AS packed FROM g WINDOW w AS (PARTITION BY bank, page ORDER BY col)")
def apply_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed columns after all stores: the neighbours' headers and footers follow from the last state."""
    from rasterloom.sources import screens

    last = replay_screen(spark, sf_dir)
    pages = last.groupBy("bank", (F.col("page") - 32).alias("page")).agg(F.map_from_entries(F.collect_list(F.struct("off", "content"))).alias("m"))
    pages = pages.select("bank", "page", F.expr("transform(sequence(0L, 255L), o -> coalesce(m[o], 0L))").alias("cells"))
    return screens.packed_hgr(pages).select("bank", "page", F.posexplode("packed").alias("col", "packed")).withColumn("col", F.col("col").cast("long"))


@query("WITH p AS (SELECT quantile_cont(value, [0.005, 0.995]) AS q FROM events) SELECT round(16384 / greatest(abs(q[1]), abs(q[2])), 6) AS normalization FROM p")
def audio_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain that clips the loudest hundredth: exact interpolated percentiles over all samples."""
    q = table(spark, sf_dir, "events").agg(F.expr("percentile(value, array(0.005, 0.995))").alias("q"))
    return q.select(F.round(16384 / F.greatest(F.abs(F.col("q")[0]), F.abs(F.col("q")[1])), 6).alias("normalization"))


@query("SELECT event_id AS idx, greatest(least(trunc((value - 250) * 40 / 16384 * 16 * 1.25), 16), -15)::INTEGER AS level FROM events")
def audio_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred samples times a gain, truncated towards zero, in -15 to 16."""
    x = (F.col("value") - 250) * 40 / 16384 * 16 * 1.25
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.greatest(F.least(x.cast("int"), F.lit(16)), F.lit(-15)).alias("level"))


@query()
def audio_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk of 2048 samples resampled to three quarters of its rate in the frequency domain, scaled to keep its energy."""
    from rasterloom.operators.audio import resample

    pcm = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "value")
    return resample(pcm, chunk=2048, up=3, down=4)


@query()
def greedy_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store operations of every movie, most valuable cells first, as many a frame as audio ticks allow."""
    from rasterloom.operators.greedy import encode

    return encode(table(spark, sf_dir, "documents"), ops_per_frame=BITRATE // FPS).drop("bank")


@query()
def greedy_encode_dhgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.operators.greedy import encode

    return encode(table(spark, sf_dir, "documents"), ops_per_frame=BITRATE // FPS, mode="DHGR")


def _movies(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Streams of all documents; event e is a sample of the movie e % 8, its value the level."""
    from rasterloom.operators.movies import encode

    level = F.greatest(F.least(((F.col("value") - 250) * 40 / 16384 * 16 * 1.25).cast("int"), F.lit(16)), F.lit(-15))
    audio = table(spark, sf_dir, "events").select((F.col("event_id") % 8).alias("movie"), F.col("event_id").alias("idx"), level.alias("level"))
    found = files.opcode_addresses(spark.createDataFrame(files.handler_lines(), "line_no long, line string"))
    addresses = {r["opcode"]: r["address"] for r in found.collect()}  # one row per operation of the player
    return encode(table(spark, sf_dir, "documents"), audio, addresses, mode, ticks_per_frame=BITRATE / FPS)


def _sizes(size: int) -> str:
    """DuckDB: a movie's operations end with its samples or its frames; each 292 are a frame, and the end mark takes two bytes."""
    return f"""WITH m AS (SELECT doc_id AS movie, ceil(length(coalesce(text, '')) / {size}.0)::BIGINT AS frames, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT event_id % 8 AS movie, count(*) AS n FROM events GROUP BY 1) a ON a.movie = doc_id),
o AS (SELECT movie, 1 + CASE WHEN frames = 0 THEN 0 ELSE least(n, {BITRATE // FPS} * frames - 1) END AS ops FROM m)
SELECT movie, ops // {OPS} + 1 AS frames, ops - 1 AS ticks, ops // {OPS} AS acks, (ops // {OPS} + 1) * {FRAME} AS bytes FROM o"""


def _digest(frames: DataFrame, spark: SparkSession) -> DataFrame:
    """What the bytes of each stream decode to."""
    from rasterloom.operators.movies import decode

    found = files.opcode_addresses(spark.createDataFrame(files.handler_lines(), "line_no long, line string"))
    ops = decode(frames, {r["opcode"]: r["address"] for r in found.collect()})
    counts = ops.groupBy("movie").agg(F.count_if(F.col("name").startswith("tick")).alias("ticks"), F.count_if(F.col("name") == "ack").alias("acks"))
    sizes = frames.groupBy("movie").agg(F.count("*").alias("frames"), F.sum(F.length("data")).alias("bytes"))
    return sizes.join(counts, "movie")


@query(_sizes(7680))
def movie_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, tick operations and acknowledgements of each movie's byte stream, read back from its bytes."""
    return _digest(_movies(spark, sf_dir, "HGR"), spark)


@query(_sizes(15360))
def movie_encode_dhgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_movies(spark, sf_dir, "DHGR"), spark)


@query()
def movie_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams themselves, 2048 bytes a row."""
    return _movies(spark, sf_dir, "HGR")
