"""The streaming encoder gives what the batch one gives."""

from rasterloom.operators import greedy
from rasterloom.sources import screens
from rasterloom.streaming.movies import encode_stream, replay_stream


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "to and fro " * 900), (2, "a b c d")], "doc_id long, text string")
    pages = screens.hgr_pages(docs)
    for frame in (0, 1):  # a file each, so frames come in order
        pages.where(f"frame = {frame}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = encode_stream(stream, 15).writeStream.format("memory").queryName("ops").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    order = ["movie", "seq"]
    got = spark.table("ops").orderBy(*order).collect()
    assert got == greedy.encode(docs, 15).orderBy(*order).collect() and len(got) > 30
    assert replay_stream(spark.table("ops")).count() > 30


def test_stream_equals_batch_dhgr(spark, tmp_path):
    docs = spark.createDataFrame([(1, "to and fro " * 1700), (2, "a b c d")], "doc_id long, text string")
    pages = screens.dhgr_pages(docs)
    for frame in (0, 1):
        pages.where(f"frame = {frame}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = encode_stream(stream, 15, mode="DHGR").writeStream.format("memory").queryName("dops").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("dops").orderBy("movie", "seq").collect()
    assert got == greedy.encode(docs, 15, mode="DHGR").orderBy("movie", "seq").collect() and {r["bank"] for r in got} == {0, 1}
