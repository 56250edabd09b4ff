"""Invariants of the greedy encoder and of merged movies, in both modes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.layouts import HOLE, Layout
from rasterloom.operators import distances, greedy, movies
from rasterloom.sources import files


def replay(ops, banks):
    screen = np.zeros((32, banks, 256), np.int64)
    for _, bank, page, content, offsets in ops:
        screen[page - 32, bank, offsets] = content
    return screen


@pytest.mark.parametrize("mode", ["HGR", "DHGR"])
def test_encoding_converges(mode):
    layout = Layout(mode)
    (frame,) = greedy.frames(layout, "a text that is long enough to fill some pages " * 40)
    encoder = greedy.Encoder(mode, 0)
    before = encoder.error(frame)
    few = list(greedy.budgeted(encoder, [frame], 20))
    assert len(few) == 20 and 0 < encoder.error(frame) < before and (replay(few, layout.banks) == encoder.screen).all()
    encoder = greedy.Encoder(mode, 0)
    ops = list(greedy.budgeted(encoder, [frame], 20_000))
    assert all(len(o[-1]) == 4 and len(set(o[-1])) <= 3 and not HOLE[o[-1]].any() for o in ops)
    assert encoder.error(frame) == 0 and (replay(ops, layout.banks) == encoder.screen).all()


def test_encode_by_movie(spark):
    docs = spark.createDataFrame([(1, "hello " * 50), (2, ""), (3, None), (4, "x" * 8000)], "doc_id long, text string")
    rows = greedy.encode(docs, 20).collect()
    assert {r["movie"] for r in rows} == {1, 4}
    assert {r["frame"] for r in rows if r["movie"] == 4} == {0, 1}
    assert all(32 <= r["page"] < 64 and r["bank"] == 0 for r in rows)
    for m in (1, 4):
        assert [r["seq"] for r in rows if r["movie"] == m] == list(range(sum(r["movie"] == m for r in rows)))
    both = greedy.encode(docs, 20, mode="DHGR").collect()
    assert {r["bank"] for r in both} == {0, 1} and max(sum(r["frame"] == 0 and r["bank"] == b and r["movie"] == 4 for r in both) for b in (0, 1)) == 10


ADDRESSES = {r[0]: r[1] for r in [("header", 0x8100), ("terminate", 0x81D7), ("nop", 0x81EE), ("ack", 0x81FA)] + [(f"tick_{t}_page_{p}", 0x8200 + 16 * (32 * (t - 4) // 2 + p - 32)) for t in range(4, 68, 2) for p in range(32, 64)]}


def test_handler_addresses(spark):
    found = files.opcode_addresses(spark.createDataFrame(files.handler_lines(), "line_no long, line string")).collect()
    assert {r["opcode"]: r["address"] for r in found} == ADDRESSES and [r["address"] for r in found] == sorted(ADDRESSES.values())
    with pytest.raises(ValueError):
        movies.handlers({k: v for k, v in ADDRESSES.items() if k != "ack"})


@pytest.mark.parametrize("mode", ["HGR", "DHGR"])
def test_movie_decodes_to_its_operations(spark, mode, tmp_path):
    text, levels = "to and fro and up and down " * 900, [i % 40 - 20 for i in range(1500)]
    bank = [0]
    wanted, seen = [], 0
    for op in movies.operations(text, levels, mode, 5, 490.0, 1, lambda: bank[0]):
        wanted.append(op)
        seen += 1
        if (seen + 1) % 292 == 0 and mode == "DHGR":
            bank[0] = 1 - bank[0]
    docs = spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, text string")
    audio = spark.createDataFrame([(1, i, v) for i, v in enumerate(levels)], "movie long, idx long, level int")
    frames = movies.encode(docs, audio, ADDRESSES, mode)
    rows = movies.decode(frames, ADDRESSES).where("movie = 1").orderBy("seq").collect()
    ticks = [(r["name"], r["content"], list(r["offsets"])) for r in rows if r["name"].startswith("tick")]
    assert ticks == [(f"tick_{t}_page_{p}", c, o) for t, p, c, o in wanted] and len(ticks) > 900
    assert rows[0]["name"] == "header" and rows[-1]["name"] == "terminate"
    acks = [r["content"] for r in rows if r["name"] == "ack"]
    assert acks == ([0x54] * len(acks) if mode == "HGR" else [0x55, 0x54, 0x55, 0x54, 0x55][: len(acks)]) and len(acks) == len(wanted) // 292
    data = {(r["movie"], r["frame"]): bytes(r["data"]) for r in frames.collect()}
    assert all(len(d) == 2048 for d in data.values()) and data[1, 0][:7] == bytes([255] * 6 + [int(mode == "DHGR")])
    assert data[2, 0] == data[3, 0] == data[1, 0][:7] + b"\x81\xd7" + bytes(2039)
    assert movies.save(frames, 1, str(tmp_path / "one")) == 2048 * (len(acks) + 1)
    assert (tmp_path / "one").read_bytes() == b"".join(data[1, i] for i in range(len(acks) + 1))
    movies.write(frames, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == len(data)


def test_movie_limit_and_padding():
    text, levels = "ab", [0] * 5000
    whole = list(movies.stream(text, levels, ADDRESSES, ticks_per_frame=5000.0))
    assert len(whole) == 5001 // 292 + 1
    # Out of work, it goes on storing to the first cell.
    assert whole[3][:7] == ADDRESSES["tick_34_page_32"].to_bytes(2, "big") + bytes([ord("a"), 0, 0, 0, 0])
    limited = list(movies.stream(text, levels, ADDRESSES, ticks_per_frame=5000.0, limit=5000))
    assert limited[:2] == whole[:2] and len(limited) == 3 and limited[2].rstrip(b"\0").endswith(b"\x81\xd7")
    assert len(limited[2].rstrip(b"\0")) == -(-(5000 - 4096) // 7) * 7 + 2


def test_every_other_frame():
    text = "x" * 7680 + "y" * 7680 + "z" * 7680
    ops = list(movies.operations(text, [0] * 1400, "HGR", 5, 490.0, 2, lambda: 0))
    assert {chr(c) for _, _, c, _ in ops} == {"x", "z"}


def test_priorities_add_up_across_batches(spark):
    """Movies of several frames, longer than a batch of pages too, against the rule cell by cell, without a shuffle."""
    rng = np.random.default_rng(8)
    movie = lambda n: "".join(chr(c) for c in rng.integers(97, 100, n))
    texts = [movie(500), movie(7680 * 70 + 900), movie(7680 * 3), movie(10), movie(7680 * 2 + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = distances.accumulated(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("Coalesce", "")
    weights = {}
    for r in distances.diff_weights(docs).collect():
        weights.setdefault((r["movie"], r["page"], r["off"]), {})[r["frame"]] = r["dist"]
    want = {}
    for (m, page, _), dist in weights.items():
        held = 0
        for frame in range((len(texts[m]) - 1) // 7680 + 1):
            held = held + dist[frame] if frame in dist else 0
            if held:
                total, most = want.get((m, frame, page), (0, 0))
                want[m, frame, page] = total + held, max(most, held)
    assert {(r["movie"], r["frame"], r["page"]): (r["priority"], r["most"]) for r in found.collect()} == want


@pytest.mark.parametrize("mode", ["HGR", "DHGR"])
def test_movies_side_by_side_are_encoded_as_alone(mode):
    """All operations equal the encoder's of each movie: frames that end in the middle of a page, errors that go back, wide characters."""
    rng = np.random.default_rng(41)
    text = lambda n, low, high: "".join(chr(c) for c in rng.integers(low, high, n))
    texts = [text(900, 97, 100), "", text(33_000, 97, 123), text(5, 0x2500, 0x2600), text(8000, 32, 255), "a" * 16_000, text(15_400, 60, 64)]
    got = {i: [] for i in range(len(texts))}
    for i, seq, frame, bank, page, content, offsets in (r for part in greedy.together(texts, 490, 5, mode) for r in zip(*(x.tolist() for x in part))):
        got[i].append((seq, frame, bank, page, content, offsets))
    for i, t in enumerate(texts):
        encoder = greedy.Encoder(mode, 5)
        assert sorted(got[i]) == [(n, *op) for n, op in enumerate(greedy.budgeted(encoder, greedy.frames(encoder.layout, t), 490))]


@pytest.mark.parametrize("mode", ["HGR", "DHGR"])
def test_movies_that_fill_their_last_group(spark, mode):
    """A batch whose last movie fills a group leaves none for a further one; no movies at all give no operations."""
    assert list(greedy.together([], 490, 5, mode)) == []
    banks = Layout(mode).banks
    text, n = "to and fro " * 9000, greedy.TOGETHER // (greedy.PAGES * banks)
    docs = spark.createDataFrame([(i, text[i : i + 7680 * banks]) for i in range(2 * n)], "doc_id long, text string").coalesce(1)
    got = {}
    for r in greedy.encode(docs, 4, mode=mode).collect():
        got.setdefault(r["movie"], []).append(tuple(r)[1:])
    encoder = greedy.Encoder(mode, 5)
    assert len(got) == 2 * n and {len(ops) for ops in got.values()} == {4}
    assert sorted(got[n]) == [(k, *op) for k, op in enumerate(greedy.budgeted(encoder, greedy.frames(encoder.layout, text[n : n + 7680 * banks]), 4))]
    assert greedy.encode(docs.where("doc_id < 0"), 4, mode=mode).collect() == []
