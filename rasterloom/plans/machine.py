"""Queries of symbols, memory regions, switches and paths; small fixtures stand inline, event logs come from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.regions import flatten
from rasterloom.plans.book import both, query, values
from rasterloom.sources import files
from rasterloom.sources.screens import table

#: A small debug file: names that come twice, quoted commas, missing attributes, other kinds of records.
SYMBOL_LINES = [
    (1, "version major=1,minor=7"),
    (2, 'sym     id=0,name="blit,row",addrsize=absolute,val=0x9010,type=lab'),
    (3, 'seg     id=0,name="UPPER",start=0x9000,size=0x0400'),
    (4, 'sym     id=1,name="op_ack",addrsize=absolute,val=0x9100,type=lab'),
    (5, 'sym     id=2,name="op_nop",addrsize=zeropage,val=0x0,type=equ'),
    (6, 'sym     id=3,name="wanted"'),
    (7, "line    file=0,line=12"),
    (8, 'sym     id=4,name="op_tick_4_page_32",val=0x9200,type=lab'),
    (9, 'sym     id=5,name="op_ack",addrsize=absolute,val=0x9108,type=lab'),
    (10, ""),
    (11, 'sym     id=6,name="op_terminate",val=0x9120,type=lab'),
]
_LINES = ("line_no long, line string", SYMBOL_LINES)
_HANDLERS = ("line_no long, line string", files.handler_lines())
# Memory regions in the order they are registered, and programme entry points.
REGIONS = [(1, "Zero page", 0x0000, 0x00FF, True), (2, "Stack", 0x0100, 0x01FF, True), (3, "Text page 1", 0x0400, 0x07FF, True), (4, "HiRes Page 1", 0x2000, 0x2FFF, True), (5, "HiRes Page 2", 0x4000, 0x4FFF, False), (6, "IO page", 0xC000, 0xC0FF, True), (7, "Slot 1 ROM", 0xC100, 0xC1FF, False), (8, "Slot 2 ROM", 0xC200, 0xC2FF, False), (9, "Slot 3 ROM", 0xC300, 0xC3FF, False), (10, "Slot 4 ROM", 0xC400, 0xC4FF, False), (11, "Slot 5 ROM", 0xC500, 0xC5FF, False), (12, "Slot 6 ROM", 0xC600, 0xC6FF, False), (13, "Slot 7 ROM", 0xC700, 0xC7FF, False), (14, "ROM", 0xD000, 0xFFFF, False), (15, "Overlay", 0x2800, 0x47FF, True)]
_REGIONS = ("ord int, name string, first int, last int, writable boolean", REGIONS)
ENTRYPOINTS = [(0xF3E2, "HGR"), (0xFCA8, "WAIT"), (0xFDED, "COUT"), (0xFE89, "IN#0"), (0xFDED, "COUT log")]
# Soft switches as (name, clear, set, status, access mode bits: 1 read, 2 write).
SWITCHES = [("80STORE", 0xC000, 0xC001, 0xC018, 2), ("80VID", 0xC00C, 0xC00D, 0xC01F, 2), ("TEXT", 0xC050, 0xC051, 0xC01A, 3), ("MIXED", 0xC052, 0xC053, 0xC01B, 3), ("PAGE2", 0xC054, 0xC055, 0xC01C, 3), ("HIRES", 0xC056, 0xC057, 0xC01D, 3)]
_SWITCHES = ("name string, clear_at int, set_at int, status_at int, mode int", SWITCHES)
ADDRESS = "(e.event_id * 8191 + e.user_id * 257) % 65536"
SWITCH_ADDRESS = "49152 + (e.event_id * 7 + e.user_id) % 96"

both("frame_rate_parse", "SELECT rate, cast(split_part(rate, '/', 1) AS double) / cast(split_part(rate, '/', 2) AS double) AS fps FROM {rates}", rates=("rate string", [("30/1",), ("30000/1001",), ("24000/1001",), ("25/1",), ("60/1",)]))
_SYMBOLS = "SELECT line_no, regexp_extract(line, 'name=(\"[^\"]*\"|[^,]*)', 1) AS name, regexp_extract(line, 'val=([^,]*)', 1) AS val, regexp_extract(line, 'type=([^,]*)', 1) AS type FROM {} WHERE line LIKE 'sym%'"


@query(f"SELECT name, nullif(arg_max(val, line_no), '') AS val, nullif(arg_max(type, line_no), '') AS type FROM ({_SYMBOLS.format(values(*_LINES))}) GROUP BY name")
def symbol_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.symbols(spark.createDataFrame(SYMBOL_LINES, _LINES[0]))
    return found.select("name", F.col("attributes")["val"].alias("val"), F.col("attributes")["type"].alias("type"))


@query(f"SELECT opcode, address, row_number() OVER (ORDER BY address, opcode)::INTEGER AS place FROM (SELECT substr(name, 5, length(name) - 5) AS opcode, val::INTEGER AS address FROM ({_SYMBOLS.format(values(*_HANDLERS))}) WHERE name LIKE '\"op_%')")
def opcode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation's handler, by address."""
    from pyspark.sql import Window

    found = files.opcode_addresses(spark.createDataFrame(_HANDLERS[1], _HANDLERS[0]))
    return found.withColumn("place", F.row_number().over(Window.orderBy("address", "opcode")))  # no more rows than there are operations


_OPS = [("HEADER",), ("TERMINATE",), ("NOP",), ("ACK",)] + [(f"TICK_{t}_PAGE_{p}",) for t in (4, 6) for p in (32, 33)]
_NAMES = "SELECT substr(name, 5, length(name) - 5) AS op, addr FROM (SELECT split_part(split_part(line, 'name=', 2), ',', 1) AS name, split_part(split_part(line, 'val=0x', 2), ',', 1) AS addr, line_no FROM {lines} WHERE line LIKE 'sym%') WHERE substr(name, 1, 4) = '\"op_'"
both("opcode_addr_join", f"SELECT o.name AS opcode, max(n.addr) AS addr FROM {{ops}} o JOIN ({_NAMES}) n ON lower(o.name) = n.op GROUP BY o.name", lines=_LINES, ops=("name string", _OPS))
both("opcode_missing", f"SELECT o.name AS opcode FROM {{ops}} o LEFT JOIN ({_NAMES}) n ON lower(o.name) = n.op AND n.addr <> '0' WHERE n.op IS NULL", lines=_LINES, ops=("name string", _OPS))
_PATHS = ("path string, mode string, palette string", [("/foo/bar.mp4", "DHGR", "NTSC"), ("/foo/bar.blee.mp4", "HGR", "IIGS"), ("/foo/bar blee.mp4", "DHGR", "IIGS"), ("a.webm", "HGR", "NTSC"), ("/x/b.ts", "HGR", "NTSC"), ("/x/none", "HGR", "IIGS")])


@query("SELECT path, mode, palette, concat(array_to_string(string_split(path, '.')[:-2], '.'), '/', mode, '/', palette) AS dir FROM " + values(*_PATHS))
def output_dir_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spark.createDataFrame(_PATHS[1], _PATHS[0])
    return paths.select("path", "mode", "palette", files.output_dir(F.col("path"), F.col("mode"), F.col("palette")).alias("dir"))


#: The region registered last wins where regions overlap; other addresses are the default region's.
_LOOKUP = f"SELECT e.event_id AS seq, {ADDRESS} AS addr, e.user_id % 256 AS op FROM {{events}} e"
#: DuckDB: each access with its region, by order of registration.
_FOUND = f"SELECT a.seq, a.addr, any_value(a.op) AS op, coalesce(arg_max(r.name, r.ord), 'default') AS region, coalesce(arg_max(r.writable, r.ord), true) AS writable FROM ({_LOOKUP.format(events='events')}) a LEFT JOIN {values(*_REGIONS)} r ON a.addr BETWEEN r.first AND r.last GROUP BY a.seq, a.addr"


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, addr, op, region, writable) of every access: one range of addresses each, so no row is doubled."""
    a = spark.sql(_LOOKUP, events=table(spark, sf_dir, "events"))
    ranges = F.broadcast(spark.createDataFrame(flatten(REGIONS), "first long, last long, name string, writable boolean"))
    found = a.join(ranges, (a["addr"] >= ranges["first"]) & (a["addr"] <= ranges["last"]), "left")
    return found.select("seq", "addr", "op", F.coalesce("name", F.lit("default")).alias("region"), F.coalesce("writable", F.lit(True)).alias("writable"))


@query(f"SELECT seq, addr, region FROM ({_FOUND})")
def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accesses(spark, sf_dir).select("seq", "addr", "region")


@query(f"SELECT seq, addr, region FROM ({_FOUND}) WHERE NOT writable")
def write_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accesses(spark, sf_dir).where("NOT writable").select("seq", "addr", "region")


@query(f"WITH t AS ({_FOUND}) SELECT t.seq, p.region AS old_region, t.region FROM t JOIN t p ON p.seq = t.seq - 1 WHERE t.region <> p.region AND p.op <> 96 AND t.addr NOT IN (62434, 64680, 65005, 65161)")
def region_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses in another region than the one before, unless a return or a known entry point led there."""
    t = _accesses(spark, sf_dir)
    p = t.select((F.col("seq") + 1).alias("seq"), F.col("region").alias("old_region"), F.col("op").alias("old_op"))
    known = [at for at, _ in ENTRYPOINTS]
    return t.join(p, "seq").where((F.col("region") != F.col("old_region")) & (F.col("old_op") != 96) & ~F.col("addr").isin(known)).select("seq", "old_region", "region")


both("softswitch_state", f"SELECT s.name, max(a.seq) AS seq, max(CASE WHEN a.seq = l.last_seq THEN CASE WHEN a.addr = s.set_at THEN 1 ELSE 0 END END) AS state FROM (SELECT e.event_id AS seq, {SWITCH_ADDRESS} AS addr, 1 + e.user_id % 2 AS access FROM {{events}} e) a JOIN {{switches}} s ON (a.addr = s.clear_at OR a.addr = s.set_at) AND (s.mode & a.access) <> 0 JOIN (SELECT s.name, max(a.seq) AS last_seq FROM (SELECT e.event_id AS seq, {SWITCH_ADDRESS} AS addr, 1 + e.user_id % 2 AS access FROM {{events}} e) a JOIN {{switches}} s ON (a.addr = s.clear_at OR a.addr = s.set_at) AND (s.mode & a.access) <> 0 GROUP BY s.name) l ON l.name = s.name GROUP BY s.name", tables=("events",), switches=_SWITCHES)
both("io_traps", f"SELECT a.seq, a.addr, a.access, CASE WHEN m.addr IS NULL THEN 'unknown' ELSE 'mode' END AS why FROM (SELECT e.event_id AS seq, {SWITCH_ADDRESS} AS addr, 1 + e.user_id % 2 AS access FROM {{events}} e) a LEFT JOIN (SELECT clear_at AS addr, mode FROM {{switches}} UNION ALL SELECT set_at, mode FROM {{switches}} UNION ALL SELECT status_at, 1 FROM {{switches}}) m ON m.addr = a.addr WHERE m.addr IS NULL OR (m.mode & a.access) = 0", tables=("events",), switches=_SWITCHES)


@query("SELECT pc, string_agg(handler, ',' ORDER BY handler) AS handlers, count(*) AS n FROM " + values("pc int, handler string", ENTRYPOINTS) + " GROUP BY pc")
def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers by programme counter."""
    rows = spark.createDataFrame(ENTRYPOINTS, "pc int, handler string")
    return rows.groupBy("pc").agg(F.array_join(F.array_sort(F.collect_list("handler")), ",").alias("handlers"), F.count("*").alias("n"))
