"""Raw screen files and debug symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BYTES = 8192


def screen_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, cells) of the 8192-byte screen dumps below path; files of any other size are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") == BYTES)
    page = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("page"), "content")
    cells = F.expr("transform(sequence(0, 255), o -> cast(conv(substr(h, 2 * o + 1, 2), 16, 10) as bigint))")
    return page.withColumn("h", F.hex(F.substring("content", F.col("page") * 256 + 1, F.lit(256)))).select("path", "page", cells.alias("cells"))


def symbols(lines: DataFrame) -> DataFrame:
    """(name, attributes) of a debug file's sym lines (line_no, line); the last line of a name counts. Quotes stay, and commas in them."""
    pair = lambda part: F.regexp_extract_all("line", F.lit(r'(\w+)=("[^"]*"|[^,]*)'), F.lit(part))
    sym = lines.where(F.col("line").startswith("sym")).select("line_no", F.map_from_arrays(pair(1), pair(2)).alias("kv"))
    return sym.groupBy(F.col("kv")["name"].alias("name")).agg(F.max_by("kv", "line_no").alias("attributes"))


def opcode_addresses(lines: DataFrame) -> DataFrame:
    """(opcode, address) of the operations' handlers in a debug file: symbols named "op_...", by ascending address."""
    named = symbols(lines).where(F.col("name").startswith('"op_')).select(F.expr("substring(name, 5, length(name) - 5)").alias("opcode"), F.conv(F.expr("substring(attributes['val'], 3)"), 16, 10).cast("int").alias("address"))
    return named.orderBy("address", "opcode")


def handler_lines(ticks: range = range(4, 68, 2), pages: range = range(32, 64)) -> list[tuple[int, str]]:
    """(line_no, line) of a debug file that names a handler for every operation: 16 bytes for each tick and page."""
    plain = [("header", 0x8100), ("terminate", 0x81D7), ("nop", 0x81EE), ("ack", 0x81FA)]
    fat = [(f"tick_{t}_page_{p}", 0x8200 + 16 * (len(pages) * i + j)) for i, t in enumerate(ticks) for j, p in enumerate(pages)]
    return [(i, f'sym     id={i},name="op_{name}",addrsize=absolute,scope=0,val=0x{address:X},type=lab') for i, (name, address) in enumerate(plain + fat)]


def output_dir(path: Column, mode: Column, palette: Column) -> Column:
    """The folder of a movie's converted frames: its name up to the last dot (nothing without one), mode, palette."""
    return F.concat(F.regexp_extract(path, r"(?s)^(.*)\.", 1), F.lit("/"), mode, F.lit("/"), palette)
