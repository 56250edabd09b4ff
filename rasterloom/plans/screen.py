"""Queries of screen geometry, packing and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import bits, colour
from rasterloom.operators import distances
from rasterloom.plans.book import both, query, values
from rasterloom.sources import screens
from rasterloom.sources.screens import SQL_CELLS, SQL_PACKED, SQL_PACKED_DHGR, table

BASE = "8192 * (p.id + 1) + 1024 * (y.id % 8) + 128 * ((y.id % 64) >> 3) + 40 * (y.id >> 6)"
both("base_addr", f"SELECT p.id AS screen, y.id AS y, {BASE} AS addr FROM {{r192}} y CROSS JOIN {{r2}} p", ranges=(192, 2))
both("screen_coords", f"SELECT y.id AS y, x.id AS x, (a.addr + x.id) >> 8 AS page, (a.addr + x.id) & 255 AS off FROM {{r192}} y CROSS JOIN {{r40}} x JOIN (SELECT y.id AS y, {BASE} - 8192 AS addr FROM {{r192}} y CROSS JOIN {{r1}} p) a ON a.y = y.id", ranges=(192, 40, 1))
both("screen_holes", f"SELECT a.id >> 8 AS page, a.id & 255 AS off FROM {{r8192}} a LEFT JOIN (SELECT {BASE} - 8192 + x.id AS addr FROM {{r192}} y CROSS JOIN {{r40}} x CROSS JOIN {{r1}} p) v ON v.addr = a.id WHERE v.addr IS NULL", ranges=(8192, 192, 40, 1))
both("reshape_pages", "SELECT a.id AS addr, a.id >> 8 AS page, a.id & 255 AS off, ((a.id >> 8) << 8) + (a.id & 255) AS back FROM {r8192} a", ranges=(8192,))
both("rol_ror", f"SELECT v.id AS v, n.id AS n, {bits.rol('v.id', 'n.id % 4')} AS rol, {bits.ror('v.id', 'n.id % 4')} AS ror FROM {{r16}} v CROSS JOIN {{r8}} n", ranges=(16, 8))
both("double_pixels", f"SELECT id AS v, {bits.double('id')} AS dots FROM {{r128}}", ranges=(128,))
both("hgr_dots", f"SELECT id AS masked, {bits.hgr_dots('id', 0)} AS even_dots, {bits.hgr_dots('id', 1)} AS odd_dots FROM {{r16384}}", ranges=(16384,))
both("byte_offset", "SELECT o.id AS off, a.id AS aux, CASE WHEN o.id % 2 = 0 THEN 0 ELSE 1 END AS hgr_byte, CASE WHEN o.id % 2 = 0 THEN CASE WHEN a.id = 1 THEN 0 ELSE 1 END ELSE CASE WHEN a.id = 1 THEN 2 ELSE 3 END END AS dhgr_byte FROM {r256} o CROSS JOIN {r2} a", ranges=(256, 2))
both("palette_dim", "SELECT * FROM {palettes}", palettes=("palette_id int, palette string, code int, name string, r int, g int, b int", colour.palette_rows()))
STORES = "SELECT event_id AS seq, 32 + user_id % 32 AS page, (event_id * 7) % 256 AS off, cast(floor(value) AS bigint) & 255 AS content, cast(floor(event_id / 292) AS bigint) % 2 AS bank FROM {events}"
both("masked_update", "SELECT v.id AS old_value, n.id AS new_value, " + ", ".join(f"{bits.stored('HGR', 'v.id * 4111', b, 'n.id')} AS hgr{b}" for b in (0, 1)) + ", " + ", ".join(f"{bits.stored('DHGR', 'v.id * 16777259', b, 'n.id')} AS dhgr{b}" for b in range(4)) + " FROM {r1000} v CROSS JOIN {r256} n", ranges=(1000, 256))
both("addr_violations", "SELECT event_id, event_id * 13 AS addr, CASE WHEN event_id * 13 BETWEEN 8192 AND 16383 THEN 'page 1' WHEN event_id * 13 BETWEEN 16384 AND 24575 THEN 'page 2' ELSE 'outside' END AS where_to FROM {events} WHERE NOT event_id * 13 BETWEEN 8192 AND 16383", tables=("events",))
both("priority_nonce", f"SELECT page.id AS page, off.id AS off, frame.id AS frame, {distances.NONCE.replace('page', 'page.id').replace('off', 'off.id').replace('frame', 'frame.id')} AS nonce FROM {{r32}} page CROSS JOIN {{r256}} off CROSS JOIN {{r4}} frame", ranges=(32, 256, 4))

def _digest(pages: DataFrame) -> DataFrame:
    """Order-sensitive digests of each page's packed columns."""
    cols = pages.select("movie", "frame", "page", F.posexplode("packed").alias("col", "packed"))
    return cols.groupBy("movie", "frame", "page").agg(F.sum("packed").alias("total"), F.sum(F.col("packed") * (F.col("col") + 1)).alias("weighted"), F.count_if(F.col("packed") != 0).alias("filled"))


@query(f"WITH {SQL_CELLS} SELECT movie, frame, count(DISTINCT page) AS pages, sum(value)::BIGINT AS total, sum(value * (page * 256 + off))::BIGINT AS weighted FROM cells GROUP BY movie, frame")
def src_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = screens.hgr_pages(table(spark, sf_dir, "documents")).select("movie", "frame", "page", F.posexplode("cells").alias("off", "value"))
    return cells.groupBy("movie", "frame").agg(F.countDistinct("page").alias("pages"), F.sum("value").alias("total"), F.sum(F.col("value") * (F.col("page") * 256 + F.col("off"))).alias("weighted"))


@query(f"WITH {SQL_PACKED} SELECT movie, frame, page, sum(packed)::BIGINT AS total, sum(packed * (col + 1))::BIGINT AS weighted, count_if(packed <> 0)::BIGINT AS filled FROM packed GROUP BY ALL")
def hgr_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(screens.packed_pages(table(spark, sf_dir, "documents")))


@query(f"WITH {SQL_PACKED_DHGR} SELECT movie, frame, page, sum(packed)::BIGINT AS total, sum(packed * (col + 1))::BIGINT AS weighted, count_if(packed <> 0)::BIGINT AS filled FROM packed GROUP BY ALL")
def dhgr_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(screens.packed_pages(table(spark, sf_dir, "documents"), "DHGR"))


@query(f"WITH {SQL_PACKED} SELECT {bits.masked('HGR', 'packed', 0)} AS even_value, {bits.masked('HGR', 'packed', 1)} AS odd_value, count(*) AS n FROM packed GROUP BY ALL")
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = screens.packed_pages(table(spark, sf_dir, "documents")).select(F.explode("packed").alias("p"))
    return cols.groupBy(F.expr(bits.masked("HGR", "p", 0)).alias("even_value"), F.expr(bits.masked("HGR", "p", 1)).alias("odd_value")).agg(F.count("*").alias("n"))


_LEFT, _RIGHT = (f"coalesce({f}(packed) OVER w, 0)" for f in ("lag", "lead"))


@query(
    f"""WITH {SQL_PACKED}, near AS (SELECT movie, frame, page, packed, {bits.hgr_header(_LEFT)} AS header, ({bits.hgr_footer(_RIGHT)}) AS footer FROM packed WINDOW w AS (PARTITION BY movie, frame, page ORDER BY col))
SELECT movie, frame, page, count_if((packed & 7) <> header OR (packed & {7 << 19}) <> footer)::BIGINT AS violations, count_if(header <> 0)::BIGINT AS headers, count_if(footer <> 0)::BIGINT AS footers FROM near GROUP BY ALL"""
)
def pack_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose header or footer isn't what the neighbour says (none), and how many have any."""
    pages = screens.packed_pages(table(spark, sf_dir, "documents"))
    left, right = "coalesce(get(packed, c - 1), 0L)", "coalesce(get(packed, c + 1), 0L)"
    count = lambda test: F.expr(f"size(filter(sequence(0, 127), c -> {test}))").cast("long")
    bad = count(f"(packed[c] & 7) <> ({bits.hgr_header(left)}) OR (packed[c] & {7 << 19}) <> ({bits.hgr_footer(right)})")
    return pages.select("movie", "frame", "page", bad.alias("violations"), count("(packed[c] & 7) <> 0").alias("headers"), count(f"(packed[c] & {7 << 19}) <> 0").alias("footers"))


_PIXELS = "list_transform(range({n}), lambda i: ((((dots >> i) & 15) << ((i + phase) % 4)) | (((dots >> i) & 15) >> (4 - (i + phase) % 4))) & 15)"


def _duck_pixels(mode: str) -> str:
    n, phases = 1 << bits.MASKED_BITS[mode], bits.PHASES[mode]
    dots = f"CASE WHEN byte = 0 THEN {bits.hgr_dots('masked', 0)} ELSE {bits.hgr_dots('masked', 1)} END" if mode == "HGR" else "masked"
    phase = "CASE byte " + " ".join(f"WHEN {b} THEN {p}" for b, p in enumerate(phases)) + " END"
    return f"SELECT byte, masked, {_PIXELS.format(n=bits.PIXELS[mode])} AS pixels FROM (SELECT range // {n} AS byte, range % {n} AS masked, masked AS m, {dots} AS dots, {phase} AS phase FROM range({len(phases) * n}))"


def _duck_distance(n: int, palette: int, pairs: str) -> str:
    """pairs (..., a, b) with dn, the distance of pixels a and b. One subquery a step: an alias reused in place would be spelled out each time."""
    costs = colour.costs(palette)
    low, high = ("'" + "".join(chr(c + 32) for c in part).replace("'", "''") + "'" for part in ([min(c, 90) for c in costs], [c - min(c, 90) for c in costs]))
    out = f"SELECT *, 0 AS d0 FROM ({pairs})"
    for i in range(1, n + 1):
        at = f"(a[{i}] * 16 + b[{i}] + 1)::INTEGER"
        step = f"d{i - 1} + ascii({low}[{at}]) + ascii({high}[{at}]) - 64"
        if i > 1:
            step = f"least({step}, CASE WHEN a[{i}] = b[{i - 1}] AND a[{i - 1}] = b[{i}] THEN d{i - 2} + 1 ELSE 1048576 END)"
        out = f"SELECT *, {step} AS d{i} FROM ({out})"
    return out


_HEX = "SELECT byte::INTEGER AS byte, masked, array_to_string(list_transform(pixels, lambda p: printf('%X', p)), '') AS pixels FROM ({})"


def _pixel_strings(spark: SparkSession, mode: str) -> DataFrame:
    return distances.masked_pixels(spark, mode).select("byte", "masked", F.array_join(F.transform("pixels", lambda p: F.hex(p)), "").alias("pixels"))


@query(_HEX.format(_duck_pixels("HGR")))
def colour_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every HGR masked value's colours, as a string of hex digits."""
    return _pixel_strings(spark, "HGR")


@query(_HEX.format(_duck_pixels("DHGR")))
def colour_pixels_dhgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel_strings(spark, "DHGR")


@query("SELECT p.palette_id, p.a, p.b, p.cost, 5 * p.cost AS error_cost FROM " + values("palette_id int, a int, b int, cost int", [(p, i // 16, i % 16, c) for p in colour.PALETTES for i, c in enumerate(colour.costs(p))]) + " p")
def substitute_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What it costs to show one colour for another: 512 numbers that follow from the palettes."""
    rows = [(p, i // 16, i % 16, c) for p in colour.PALETTES for i, c in enumerate(colour.costs(p))]
    return spark.createDataFrame(rows, "palette_id int, a int, b int, cost int").withColumn("error_cost", 5 * F.col("cost"))


def colour_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substitute_costs(spark, sf_dir).drop("error_cost")


query("SELECT palette_id, a, b, cost FROM " + values("palette_id int, a int, b int, cost int", [(p, i // 16, i % 16, c) for p in colour.PALETTES for i, c in enumerate(colour.costs(p))]))(colour_diff)

_NONCE = distances.NONCE
_SEEN = "SELECT m.*, x.pixels AS a, y.pixels AS b FROM (SELECT DISTINCT byte, least(src, dst) AS lo, greatest(src, dst) AS hi FROM moved) m JOIN shown x ON x.byte = m.byte AND x.masked = lo JOIN shown y ON y.byte = m.byte AND y.masked = hi"
_TRIED = "SELECT m.*, x.pixels AS a, y.pixels AS b FROM (SELECT DISTINCT byte, src, dst FROM tried WHERE src <> dst) m JOIN shown x ON x.byte = m.byte AND x.masked = src JOIN shown y ON y.byte = m.byte AND y.masked = dst"


def _by_byte(mode: str, text) -> str:
    return "CASE byte " + " ".join(f"WHEN {b} THEN {text(b)}" for b in range(len(bits.PHASES[mode]))) + " END"


def sql_changes(mode: str, palette: int) -> str:
    """DuckDB: cells of all pages, those that moved, the distances of the pairs, and the weights."""
    n = bits.PIXELS[mode]
    place = "0 AS bank, 2 * col + b.range AS off" if mode == "HGR" else "(b.range + 1) % 2 AS bank, 2 * col + b.range // 2 AS off"
    masked = lambda a: _by_byte(mode, lambda b: f"({bits.masked(mode, a, b)})")
    return f"""{SQL_PACKED if mode == "HGR" else SQL_PACKED_DHGR},
span AS (SELECT movie, max(frame) AS last FROM cells GROUP BY movie),
old AS (SELECT p.movie, p.frame + 1 AS frame, page, col, packed FROM packed p JOIN span s ON s.movie = p.movie AND p.frame < s.last),
side AS (SELECT coalesce(n.movie, o.movie) AS movie, coalesce(n.frame, o.frame) AS frame, coalesce(n.page, o.page) AS page, coalesce(n.col, o.col) AS col, coalesce(n.packed, 0) AS packed, coalesce(o.packed, 0) AS old FROM packed n FULL JOIN old o ON n.movie = o.movie AND n.frame = o.frame AND n.page = o.page AND n.col = o.col),
cell AS (SELECT movie, frame, page, {place}, b.range AS byte, packed, {masked("old").replace("CASE byte", "CASE b.range")} AS src, {masked("packed").replace("CASE byte", "CASE b.range")} AS dst FROM side CROSS JOIN range({len(bits.PHASES[mode])}) b),
moved AS (SELECT * FROM cell WHERE src <> dst AND (off & 127) < 120),
shown AS ({_duck_pixels(mode)}),
measured AS (SELECT byte, lo, hi, d{n} AS dist FROM ({_duck_distance(n, palette, _SEEN)})),
weights AS (SELECT m.*, d.dist FROM moved m JOIN measured d ON d.byte = m.byte AND d.lo = least(src, dst) AND d.hi = greatest(src, dst) WHERE d.dist > 0)"""


SQL_CHANGES = sql_changes("HGR", 5)
SQL_CHANGES_DHGR = sql_changes("DHGR", 5)


@query(f"WITH {SQL_CHANGES} SELECT movie, frame, page, count(*) AS cells, sum(dist)::BIGINT AS total, sum(dist * (off + 1))::BIGINT AS weighted, max(dist)::INTEGER AS most FROM weights GROUP BY ALL")
def diff_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: how far the new frame is from the one before, holes left out."""
    w = distances.diff_weights(table(spark, sf_dir, "documents"))
    return w.groupBy("movie", "frame", "page").agg(F.count("*").alias("cells"), F.sum("dist").alias("total"), F.sum(F.col("dist") * (F.col("off") + 1)).alias("weighted"), F.max("dist").alias("most"))


@query(f"WITH {SQL_CHANGES} SELECT byte::INTEGER AS byte, lo, hi, dist::INTEGER AS dist FROM measured")
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance table as far as the frames need it."""
    return distances.pair_distances(distances.changed_cells(table(spark, sf_dir, "documents")))


@query(f"WITH {SQL_CHANGES} SELECT byte::INTEGER AS byte, lo AS src, hi AS dst, dist::INTEGER AS dist FROM measured UNION ALL SELECT byte::INTEGER, hi, lo, dist::INTEGER FROM measured")
def dist_symmetrise(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = pair_distance(spark, sf_dir)
    swap = F.explode(F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst"))))
    return half.select("byte", swap.alias("x"), "dist").select("byte", "x.src", "x.dst", "dist")


@query(f"WITH {SQL_CHANGES} SELECT movie, frame, sum(dist)::DOUBLE / 8192 AS similarity, count(*) AS changed FROM weights GROUP BY ALL")
def frame_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean priority over a frame's 8192 cells, at its start."""
    w = distances.diff_weights(table(spark, sf_dir, "documents"))
    return w.groupBy("movie", "frame").agg((F.sum("dist").cast("double") / 8192).alias("similarity"), F.count("*").alias("changed"))


@query(f"WITH {SQL_CHANGES} SELECT movie, frame, count_if((off & 127) >= 120)::BIGINT AS in_holes, count(*) AS cells FROM weights GROUP BY ALL")
def diff_no_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = distances.diff_weights(table(spark, sf_dir, "documents"))
    return w.groupBy("movie", "frame").agg(F.count_if(F.col("off").bitwiseAND(F.lit(127)) >= 120).alias("in_holes"), F.count("*").alias("cells"))


@query(f"WITH {SQL_CELLS} SELECT movie, frame, count_if((off & 127) >= 120)::BIGINT AS leaks, count_if(value <> 0)::BIGINT AS filled FROM cells GROUP BY ALL")
def hole_leak_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in screen holes that aren't blank (none), and how many aren't in all."""
    cells = screens.hgr_pages(table(spark, sf_dir, "documents")).select("movie", "frame", "page", F.posexplode("cells").alias("off", "value"))
    return cells.groupBy("movie", "frame").agg(F.count_if((F.col("off").bitwiseAND(F.lit(127)) >= 120) & (F.col("value") != 0)).alias("leaks"), F.count_if(F.col("value") != 0).alias("filled"))


@query(
    f"""WITH {SQL_CHANGES}, every AS (SELECT DISTINCT w.movie, f.range AS frame, w.page, w.off FROM weights w JOIN span s ON s.movie = w.movie, range(s.last + 1) f),
filled AS (SELECT e.*, coalesce(w.dist, 0) AS dist FROM every e LEFT JOIN weights w ON w.movie = e.movie AND w.frame = e.frame AND w.page = e.page AND w.off = e.off),
runs AS (SELECT *, sum(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY movie, page, off ORDER BY frame) AS run FROM filled),
held AS (SELECT *, sum(dist) OVER (PARTITION BY movie, page, off, run ORDER BY frame) AS priority FROM runs)
SELECT movie, frame, page, sum(priority)::BIGINT AS priority, max(priority)::BIGINT AS most FROM held GROUP BY ALL HAVING sum(priority) > 0"""
)
def priority_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities add up over frames until a cell has nothing to do."""
    return distances.accumulated(table(spark, sf_dir, "documents"))


@query(f"WITH {SQL_CHANGES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY movie, frame ORDER BY dist DESC, {_NONCE}, page, off) AS place FROM weights) SELECT movie, frame, count(*) AS cells, sum(place * (page * 256 + off))::BIGINT AS checksum FROM ranked GROUP BY ALL")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a frame's cells would be stored; the digest weighs each cell by its place."""
    from pyspark.sql import Window

    w = distances.diff_weights(table(spark, sf_dir, "documents")).withColumn("nonce", F.expr(_NONCE))
    place = F.row_number().over(Window.partitionBy("movie", "frame").orderBy(F.desc("dist"), "nonce", "page", "off"))
    return w.withColumn("place", place).groupBy("movie", "frame").agg(F.count("*").alias("cells"), F.sum(F.col("place") * (F.col("page") * 256 + F.col("off"))).alias("checksum"))


def sql_gains(mode: str, changes: str, palette: int) -> str:
    """DuckDB: what storing each page's worst cell's content at the page's other cells of the bank would add to the error."""
    n, bank = bits.PIXELS[mode], "" if mode == "HGR" else " AND c.bank = w.bank"
    stored = _by_byte(mode, lambda b: f"({bits.masked(mode, bits.stored(mode, 'packed', b, 'content'), b)})")
    return f"""{changes},
valued AS (SELECT w.*, coalesce(c.value, 0) AS value FROM weights w LEFT JOIN cells c ON c.movie = w.movie AND c.frame = w.frame AND c.page = w.page AND c.off = w.off{bank}),
top AS (SELECT movie, frame, page, bank, off AS first, value AS content FROM valued QUALIFY row_number() OVER (PARTITION BY movie, frame, page, bank ORDER BY dist DESC, {_NONCE}, off) = 1),
tried AS (SELECT movie, frame, page, bank, content, off, byte, {stored} AS src, dst FROM cell JOIN top USING (movie, frame, page, bank) WHERE (off & 127) < 120 AND off <> first),
tried_far AS (SELECT byte, src, dst, d{n} AS error FROM ({_duck_distance(n, palette, _TRIED)})),
gains AS (SELECT t.movie, t.frame, t.page, t.bank, t.content, t.off, coalesce(f.error, 0) - coalesce(w.dist, 0) AS delta FROM tried t LEFT JOIN tried_far f ON f.byte = t.byte AND f.src = t.src AND f.dst = t.dst LEFT JOIN weights w ON w.movie = t.movie AND w.frame = t.frame AND w.page = t.page AND w.bank = t.bank AND w.off = t.off)"""


SQL_GAINS = sql_gains("HGR", SQL_CHANGES, 5)
SQL_GAINS_DHGR = sql_gains("DHGR", SQL_CHANGES_DHGR, 5)
_DELTA = "SELECT movie, frame, page, {bank}content, sum(delta)::BIGINT AS total, min(delta)::INTEGER AS best, count_if(delta < 0)::BIGINT AS gaining FROM gains GROUP BY ALL"
_TOP = "SELECT movie, frame, page, {bank}content, off, delta::INTEGER AS delta, row_number() OVER (PARTITION BY movie, frame, page, bank ORDER BY delta, " + _NONCE + ", off)::INTEGER AS rank FROM gains WHERE delta < 0 QUALIFY rank <= 2"
_BANK = "bank::INTEGER AS bank, "


def _delta_page(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    gains = distances.page_gains(table(spark, sf_dir, "documents"), mode=mode)
    return gains.groupBy("movie", "frame", "page", "bank", "content").agg(F.sum("delta").cast("long").alias("total"), F.min("delta").alias("best"), F.count_if(F.col("delta") < 0).alias("gaining"))


@query(f"WITH {SQL_GAINS} {_DELTA.format(bank='')}")
def delta_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What storing the content of each page's worst cell elsewhere on the page would gain."""
    return _delta_page(spark, sf_dir, "HGR").drop("bank")


@query(f"WITH {SQL_GAINS_DHGR} {_DELTA.format(bank=_BANK)}")
def delta_page_dhgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta_page(spark, sf_dir, "DHGR")


@query(f"WITH {SQL_GAINS} {_TOP.format(bank='')}")
def topk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.best_offsets(table(spark, sf_dir, "documents"), 2).drop("bank")


@query(f"WITH {SQL_GAINS_DHGR} {_TOP.format(bank=_BANK)}")
def topk_offsets_dhgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.best_offsets(table(spark, sf_dir, "documents"), 2, mode="DHGR")


@query(f"WITH {SQL_CHANGES_DHGR} SELECT movie, frame, page, bank::INTEGER AS bank, count(*) AS cells, sum(dist)::BIGINT AS total, sum(dist * (off + 1))::BIGINT AS weighted, max(dist)::INTEGER AS most FROM weights GROUP BY ALL")
def diff_weights_dhgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page and bank: how far the new frame is from the one before."""
    w = distances.diff_weights(table(spark, sf_dir, "documents"), mode="DHGR")
    return w.groupBy("movie", "frame", "page", "bank").agg(F.count("*").alias("cells"), F.sum("dist").alias("total"), F.sum(F.col("dist") * (F.col("off") + 1)).alias("weighted"), F.max("dist").alias("most"))


def _pair_table(mode: str, palette: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return distances.pair_distances(distances.changed_cells(table(spark, sf_dir, "documents"), mode), mode, palette)

    run.__name__ = f"pair_distance_{mode.lower()}_{colour.PALETTES[palette][0].lower()}"
    return run


for _mode, _palette in (("HGR", 0), ("DHGR", 0), ("DHGR", 5)):  # pair_distance is the fourth
    query(f"WITH {sql_changes(_mode, _palette)} SELECT byte::INTEGER AS byte, lo, hi, dist::INTEGER AS dist FROM measured")(_pair_table(_mode, _palette))


def _tables_sql() -> str:
    one = "SELECT '{m}' AS mode, '{name}' AS palette, count(*) AS pairs, sum(dist)::BIGINT AS total, max(dist)::INTEGER AS most FROM (WITH {changes} SELECT dist FROM measured)"
    return " UNION ALL ".join(one.format(m=m, name=name, changes=sql_changes(m, p)) for m in ("HGR", "DHGR") for p, (name, _) in colour.PALETTES.items())


@query(_tables_sql())
def distance_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four distance tables, as far as the frames need them: their sizes and sums."""
    out = None
    for mode in ("HGR", "DHGR"):
        cells = distances.changed_cells(table(spark, sf_dir, "documents"), mode)
        for palette, (name, _) in colour.PALETTES.items():
            one = distances.pair_distances(cells, mode, palette).agg(F.count("*").alias("pairs"), F.sum("dist").alias("total"), F.max("dist").alias("most")).select(F.lit(mode).alias("mode"), F.lit(name).alias("palette"), "*")
            out = one if out is None else out.unionByName(one)
    return out


_WALK = "SELECT byte, masked, (masked * 7 + 3) % 8192 AS other"


@query(f"WITH shown AS ({_duck_pixels('DHGR')}) SELECT byte::INTEGER AS byte, masked, other, d10::INTEGER AS dist FROM ({_duck_distance(10, 0, _WALK + ', x.pixels AS a, (SELECT y.pixels FROM shown y WHERE y.byte = x.byte AND y.masked = (x.masked * 7 + 3) % 8192) AS b FROM shown x')})")
def pixel_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each DHGR masked value against one other, in the IIGS palette."""
    shown = distances.masked_pixels(spark, "DHGR")
    pairs = shown.select("byte", "masked", ((F.col("masked") * 7 + 3) % 8192).alias("other"), F.col("pixels").alias("a"))
    both_ = pairs.join(shown.toDF("byte", "other", "b"), ["byte", "other"])
    return both_.select("byte", "masked", "other", colour.pixel_distance(F.col("a"), F.col("b"), 10, 0).alias("dist"))


@query(
    f"""WITH {SQL_CHANGES}, tried AS (SELECT m.movie, m.frame, m.page, m.off, m.byte, m.dst AS src, CASE WHEN m.byte = 0 THEN {bits.masked("HGR", bits.stored("HGR", "packed", 0, "content"), 0)} ELSE {bits.masked("HGR", bits.stored("HGR", "packed", 1, "content"), 1)} END AS dst FROM (SELECT m.*, (coalesce(c.value, 0) + 1) & 255 AS content FROM moved m LEFT JOIN cells c USING (movie, frame, page, off)) m),
far AS (SELECT byte, src, dst, d18 AS error FROM ({_duck_distance(18, 5, _TRIED)}))
SELECT movie, frame, page, count(*) AS cells, sum(coalesce(error, 0))::BIGINT AS total, max(coalesce(error, 0))::INTEGER AS most FROM tried LEFT JOIN far USING (byte, src, dst) GROUP BY ALL"""
)
def byte_pair_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What storing the next value instead of the right one would cost, over all cells that change."""
    cells = distances.changed_cells(table(spark, sf_dir, "documents")).withColumn("content", (F.col("value") + 1).bitwiseAND(F.lit(255)))
    dst = " ".join(f"WHEN byte = {b} THEN {bits.masked('HGR', bits.stored('HGR', 'packed', b, 'content'), b)}" for b in (0, 1))
    tried = cells.select("movie", "frame", "page", "byte", F.col("dst").alias("src"), F.expr(f"CASE {dst} END").alias("dst"))
    far = distances.with_distance(tried)
    return far.groupBy("movie", "frame", "page").agg(F.count("*").alias("cells"), F.sum("dist").alias("total"), F.max("dist").alias("most"))
