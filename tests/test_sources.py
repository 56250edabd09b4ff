from rasterloom.operators.regions import flatten
from rasterloom.plans.machine import SYMBOL_LINES
from rasterloom.sources.files import output_dir, screen_files, symbols


def test_screen_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(i % 251 for i in range(8192)))
    (tmp_path / "short.bin").write_bytes(b"123")
    rows = screen_files(spark, str(tmp_path)).orderBy("page").collect()
    assert len(rows) == 32 and [c for r in rows for c in r["cells"]] == [i % 251 for i in range(8192)]


def test_symbols(spark):
    got = {r["name"]: r["attributes"] for r in symbols(spark.createDataFrame(SYMBOL_LINES, "line_no long, line string")).collect()}
    assert set(got) == {'"blit,row"', '"op_ack"', '"op_nop"', '"wanted"', '"op_tick_4_page_32"', '"op_terminate"'}
    assert got['"op_ack"']["val"] == "0x9108" and got['"op_nop"']["type"] == "equ" and set(got['"wanted"']) == {"id", "name"}


def test_output_dir(spark):
    from pyspark.sql import functions as F

    paths = ["/foo/bar.blee.mp4", "a.webm", "/x/b.ts", "none"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(output_dir(F.col("path"), F.lit("HGR"), F.lit("IIGS"))).collect()
    assert [r[0] for r in rows] == ["/foo/bar.blee/HGR/IIGS", "a/HGR/IIGS", "/x/b/HGR/IIGS", "/HGR/IIGS"]


def test_regions_last_registered_wins():
    regions = [(1, "low", 0, 99, True), (2, "inner", 10, 19, False), (3, "high", 90, 200, True), (4, "low again", 12, 12, True)]
    flat = flatten(regions)
    for at in range(210):
        want = max(((o, n) for o, n, a, b, _ in regions if a <= at <= b), default=(0, None))[1]
        assert [n for a, b, n, _ in flat if a <= at <= b] == ([want] if want else [])
