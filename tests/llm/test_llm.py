"""Operators against brute force and on odd rows: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import chat, decontam, embed, licenses, lm, near, packing, quality, sharding, simhash, suffix
from rasterloom.llm.common import Scratch
from rasterloom.llm.components import connected_components
from rasterloom.llm.deepshallow import classes
from rasterloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, fp string, block string, node string, old string, component string"
COMMON = "the quick brown fox jumps over the lazy dog while seven wizards watch from a tall and windy tower by the sea"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(30_000))
    texts = [(1, COMMON), (2, COMMON), (3, None), (4, ""), (5, "   \n\t "), (6, long), (7, "naïve café " * 40), (None, COMMON + " again"), (9, "Released under the MIT License. " + COMMON), (9, "Released under the MIT License. " + COMMON), (10, COMMON.replace("lazy", "sleepy")), (11, "x" * 500), (12, "x" * 700)]
    return spark.createDataFrame([(d, t, None if d == 3 else "en", None if d == 4 else "s", None, "a", "b", "c", "d", "e", "f") for d, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(odd, tokenizer_path(), capacity=256, windows=8).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 256
    for d, text in ((6, odd.where("doc_id = 6").first()["text"]), (7, "naïve café " * 40), (4, ""), (3, "")):
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["token_bytes"] for r in mine), "<u4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids + [1]
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_differencing():
    sizes = np.random.default_rng(0).integers(1, 500, 400).tolist()
    dealt = packing.difference(sizes, 20)
    sums = [sum(sizes[i] for i in w) for w in dealt]
    assert sorted(i for w in dealt for i in w) == list(range(400)) and max(sums) - min(sums) <= 10
    assert all(sum(sizes[i] for i in w) <= 600 for w in packing.deal(sizes, 600))


def test_simhash(spark, odd, none):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    prints = {}
    for r in odd.collect():
        prints.setdefault(simhash.majority(simhash.shingle_hashes((r["text"] or "").encode(), 3)), []).append(r["doc_id"])
    fps = list(prints)
    link = {f: {g for g in fps if bin((f ^ g) & (2**64 - 1)).count("1") <= 2} for f in fps}
    for f in fps:
        seen, todo = set(), [f]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += link[x]
        least = min((d for g in seen for d in prints[g] if d is not None), default=None)
        assert all(got[d, f] == least for d in prints[f])
    assert simhash.near_duplicates(none).count() == 0


def test_vantage_point_tree():
    from rasterloom.llm.vptree import forest, linked

    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x[:900] ^ (np.uint64(1) << rng.integers(0, 63, 900, dtype=np.uint64)), x[:400] ^ np.uint64(5)]))
    i, j = linked(x, 2, block=64)
    brute = {(a, int(b)) for a in range(len(x)) for b in np.flatnonzero(np.bitwise_count(x[a] ^ x) <= 2) if b > a}
    assert set(zip(i.tolist(), j.tolist())) == brute and len(brute) > 1000
    assert (forest(5, np.array([3, 1]), np.array([4, 3])) == [0, 1, 2, 1, 1]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7), (200, 150), (150, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(docs, n):
    out = []
    for d, t in docs:
        b, m = t.encode(), [0] * len(t.encode())
        earlier = {o.encode()[i : i + n] for e, o in docs if e < d for i in range(len(o.encode()) - n + 1)}
        for i in range(len(b) - n + 1):
            if b[i : i + n] in earlier:
                m[i : i + n] = [1] * n
        out.append((d, bytes(c for c, x in zip(b, m) if not x)))
    return out


def test_suffix_dedup(spark, none):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcé"), rng.integers(2, 9)))
    passages = [" ".join(word() for _ in range(15)) for _ in range(6)]
    docs = [(d, " ".join(passages[rng.integers(6)] if rng.random() < 0.3 else word() for _ in range(25)) + "é" * int(rng.integers(80))) for d in range(40)]
    docs += [(40, ""), (41, "a" * 300), (42, "a" * 200), (42, passages[0])]
    frame = spark.createDataFrame([(d, t, "en", "s", 1, "a", "b", "c", "d", "e", "f") for d, t in docs], SCHEMA)
    got = sorted((r["doc_id"], bytes(r["kept"])) for r in suffix.remove_repeats(frame).collect())
    assert got == sorted(brute_repeats(docs, 50))
    kept = suffix.cut_texts(frame)
    assert kept.columns == frame.columns and kept.count() == len(docs)
    suffix.SPREAD, before = 1, suffix.SPREAD  # every key counts as hot
    try:
        assert sorted((r["doc_id"], bytes(r["kept"])) for r in suffix.remove_repeats(frame).collect()) == got
    finally:
        suffix.SPREAD = before
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_dedup_spreads_hot_keys():
    docs = [(i, b"q" * i + b"the same long passage that every one of these documents has, word for word") for i in range(6)]
    keys = np.unique(np.concatenate([suffix._code(suffix.runs(np.frombuffer(t, np.uint8), 50)[2], 8) for _, t in docs]))
    outs = [suffix.block_runs([d], 50, 8, keys, keys)[0] for d in docs]
    gone = set()
    for bucket in range(8):
        rows = [o[bucket] for o in outs if bucket in o]
        if rows:
            doc, count, _, _, start, joined = zip(*rows)
            run, _, _ = suffix.verdicts(np.concatenate(doc), np.concatenate(count), b"".join(joined), 50)
            gone |= {(int(np.concatenate(doc)[r]), int(np.concatenate(start)[r])) for r in run}
    assert {d for d, _ in gone} == set(range(1, 6))


def test_suffix_verdicts_on_runs_that_repeat_themselves():
    """Long runs of one key in many documents: right strings, and memory that follows the runs' bytes."""
    import tracemalloc

    line = b"Is onhe. Is on the. "
    texts = [b"%03d" % (7 * i % 150) + (line * 140)[i % 13 :][: 2600 + i % 17] + b"%03d" % (i % 5) for i in range(150)]
    parts = []
    for i, t in enumerate(texts):
        start, count, _ = suffix.runs(np.frombuffer(t, np.uint8), 50)
        parts += [(i, n, t[a : a + n + 49]) for a, n in zip(start.tolist(), count.tolist())]
    doc, count, joined = zip(*parts)
    doc, count, joined = np.array(doc, np.int64), np.array(count, np.int32), b"".join(joined)
    tracemalloc.start()
    run, first, strings = suffix.verdicts(doc, count, joined, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {(r, s) for r, a, n in zip(run.tolist(), first.tolist(), strings.tolist()) for s in range(a, a + n)}
    seen, want = {}, set()
    for r, (d, n, b) in enumerate(parts):
        for s in range(n):
            if seen.setdefault(b[s : s + 50], d) < d:
                want.add((r, s))
    assert got == want and len(got) > 0.9 * count.sum()
    assert peak < 90 * len(joined), peak / len(joined)


def test_suffix_dedup_of_copies_and_largest_id(spark):
    """Copies of a whole text go without a sort; runs that a document repeats get their verdict everywhere."""
    line = "one line of more than fifty bytes that stands here again and again; "
    docs = [(5, "x" + line * 3), (6, "x" + line * 3), (6, "x" + line * 3), (2**63 - 1, "x" + line * 3), (9, line * 4 + "y"), (9, line * 4 + "y"), (10, line * 4 + "y"), (2**63 - 1, "short"), (11, "short")]
    got = sorted((r["doc_id"], bytes(r["kept"])) for r in suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(brute_repeats(docs, 50))


def test_suffix_odd_rows(spark, odd):
    rows = suffix.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    kept = {(r["doc_id"], r["n_bytes"]): r for r in rows}
    assert kept[1, len(COMMON)]["kept"] == COMMON.encode() and kept[2, len(COMMON)]["kept"] == b""
    assert sum(len(r["kept"]) > 100 for r in rows if r["doc_id"] == 9) == 0  # removed by 1 but not by each other


def test_deep_shallow():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2600] = data[300:900]
    at = np.arange(len(data) - 49)
    for length in (50, 13, rng.choice([9, 24, 77], 400)):
        at = rng.permutation(len(data) - 80)[: len(length) if np.ndim(length) else None]
        group = rng.integers(0, 3, len(at)) if np.ndim(length) else np.zeros(len(at), int)
        size = np.broadcast_to(length, at.shape)
        order = np.lexsort((size, group))
        at, size, group = at[order], size[order], group[order]
        item, cls = classes(data, at, size, np.unique(group * 100 + size, return_inverse=True)[1])
        groups = {}
        for i, (p, n, g) in enumerate(zip(at.tolist(), size.tolist(), group.tolist())):
            groups.setdefault((g, data[p : p + n].tobytes()), []).append(i)
        assert sorted(map(sorted, (item[cls == c].tolist() for c in np.unique(cls)))) == sorted(g for g in groups.values() if len(g) > 1)


def test_decontamination(spark, odd, none):
    words = COMMON.split()
    swapped = words[:4] + ["XX"] + words[5:9] + ["YY"] + words[10:]
    rows = [(1, "before " + COMMON + " after"), (2, " ".join(swapped[:13])), (3, " ".join(words[:8])), (4, " ".join(words[:3] + ["q"] + words[4:6] + ["q"] + words[7:9] + ["q"] + words[10:13])), (5, "nothing at all of it here to see"), (6, None), (None, COMMON)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "a", "b", "c", "d", "e", "f") for d, t in rows], SCHEMA)
    bench = spark.createDataFrame([(7, COMMON, "x"), (8, "too short", "x"), (9, None, "x")], "item_id long, text string, words string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontam.overlaps(docs, bench).collect()}
    assert got == {(1, 7): 13, (2, 7): 11, (None, 7): 13}
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontam.overlaps(none, bench).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == 7


def test_masks_hit_every_window():
    from itertools import combinations

    for width, misses in ((13, 2), (9, 1)):
        for bad in combinations(range(width), misses):
            assert any(not {s + o for o in m} & set(bad) for m in decontam.MASKS for s in range(width - m[-1]))


def test_licenses(spark, odd, none):
    texts = ["Released under the MIT License.", "mit license apache license mit license", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "licence", "Licensed under CC BY-NC 4.0.", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[0]["labels"] == ["mit"] and got[0]["places"] == [3] and 0 < got[0]["score"] <= 1
    assert got[1]["places"] == [0, 2, 4] and got[1]["base_labels"] == ["apache", "mit"]
    assert got[2]["labels"] == ["apache"] and got[3]["labels"] == ["gpl"] and got[5]["labels"] == ["cc-by-nc"] and got[5]["base_labels"] == []
    assert got[4]["labels"] == [] and got[4]["score"] == 0 and got[6]["n_words"] == 0
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def test_licenses_all_in_one_text(spark):
    """Every notice counts in full, however many index words the file has and however common they are."""
    every = " ... ".join(n for _, _, n in licenses.NOTICES)
    rows = [(0, every)] + [(i, n) for i, (_, _, n) in enumerate(licenses.NOTICES, 1)] + [(100 + i, licenses.NOTICES[8][2]) for i in range(30)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["labels"] == sorted({label for label, _, _ in licenses.NOTICES}) and got[0]["score"] == pytest.approx(1)
    for i, (label, _, _) in enumerate(licenses.NOTICES, 1):
        assert label in got[i]["labels"] and got[i]["score"] == pytest.approx(1)


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "a"), (0, 3, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "b"), (1, 3, "assistant", "bad"), (2, 0, None, None), (4, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "x"), (6, None, "user", "t"), (6, None, "user", "t"), (-1, 0, "user", "negative"), (-2, 0, "user", "neg2"), (8, 0, "user", "long " * 40_000), (9, 0, "user", "long " * 40_000)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, pair_id string")
    got = {r["pair_id"]: r for r in chat.preferences(turns, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1)) == 0).collect()}
    assert set(got) == {-1, 0, 1, 2, 3, 4}
    p = got[0]
    assert p["n_prompt_turns"] == 2 and p["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    (span,) = p["chosen_spans"]
    assert p["chosen"][span["start"] : span["stop"]] == "good<|end|>\n" and p["rejected"].startswith("<|user|>\nb")
    assert got[2]["n_prompt_turns"] == 1 and got[2]["chosen"] == "" and got[1]["chosen"].startswith("<|unknown|>\n<|end|>") and not got[1]["has_both"]
    assert "neg2" in got[-1]["chosen"] and "negative" in got[-1]["rejected"] and got[4]["n_prompt_turns"] == 1 and len(got[4]["prompt"]) > 200_000
    assert chat.preferences(turns.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_preferences_sql_has_the_same_rule(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from rasterloom.llm import queries

    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t}" if t else "same") for c in (None, -3, -2, -1, 0, 1, 7, 2**60 + 1, 2**60) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op4_preferences"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert got == sorted(c.execute(queries.SQL["op4_preferences"]).fetchall()) and len(got) == 5


def test_resharding(spark, odd, none):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, "é" * int(n)) for i, n in enumerate(rng.integers(0, 400, 3000))] + [(None, None), (5, "twice"), (5, "twice")], "doc_id long, text string")
    placed = sharding.reshard(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(6)), 6, 8).toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert len(placed) == 3003 and len(sizes) == 8 and sizes.max() - sizes.min() < 0.02 * sizes.mean()
    for _, s in placed.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    stay = placed[placed["old"] == placed["shard"]]["size"].sum()
    assert stay >= 0.73 * placed["size"].sum()  # six of eight parts can stay
    assert placed[placed["doc_id"].isna()]["text_crc32"].tolist() == [0]
    assert sharding.reshard(none, F.lit(0), 2, 3).count() == 0


def test_resharding_keeps_tiny_rows(spark):
    docs = spark.createDataFrame([(1, "five5"), (2, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in sharding.reshard(docs, F.lit(0), 1, 16).collect()) == [1, 2]


def test_resharding_around_a_large_row(spark):
    """One row larger than a shard's share: the others fill the other shards evenly."""
    docs = spark.createDataFrame([(0, "x" * 500_000)] + [(i, "tiny text") for i in range(1, 3000)], "doc_id long, text string")
    placed = sharding.reshard(docs, F.pmod(F.xxhash64("doc_id"), F.lit(12)), 12, 16).toPandas()
    assert len(placed) == 3000
    home = placed[placed["doc_id"] == 0]["shard"].iloc[0]
    sizes = placed[placed["shard"] != home].groupby("shard")["size"].sum()
    assert len(sizes) == 15 and sizes.max() - sizes.min() <= 60 and (placed["shard"] == home).sum() == 1


def test_level():
    assert sharding.level(10, [0, 0, 100]) == [5, 5, 0] and sharding.level(7, [4, 1, 0]) == [0, 3, 4] and sharding.level(0, [3, 1]) == [0, 0]


def test_resharding_keeps_what_need_not_move(spark):
    """Rows larger than a shard's share: one of each old shard stays, of two in one the smaller moves; the rest is level."""
    big = [(0, "x" * 90_000, 5), (1, "y" * 80_000, 5), (2, "z" * 70_000, 3)]
    docs = spark.createDataFrame(big + [(i, "w" * (20 if i % 9 else 200), i % 6) for i in range(3, 2000)], "doc_id long, text string, at int")
    placed = sharding.reshard(docs, F.col("at"), 6, 8).toPandas()
    home = placed.set_index("doc_id")["shard"]
    assert len(placed) == 2000 and home[0] == 5 and home[2] == 3 and home[1] not in (3, 5)
    sizes = placed[~placed["shard"].isin(home[[0, 1, 2]])].groupby("shard")["size"].sum()
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 500


def test_rewrite_touches_moved_shards_only(spark, tmp_path):
    rows = [(i, "text " * (i % 17), "clash") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    old = F.when(F.col("doc_id") < 300, F.pmod("doc_id", F.lit(3))).otherwise(F.lit(3)).cast("int")
    placed = sharding.reshard(docs, old, 4, 4)
    placed = spark.createDataFrame(placed.collect(), placed.schema)
    path = str(tmp_path / "shards")
    docs.withColumn("_rl_shard", old).withColumn("_rl_slot", F.col("doc_id")).write.partitionBy("_rl_shard").parquet(path)
    touched = sharding.rewrite(docs, placed, path)
    moved = placed.where("old <> shard").collect()
    assert touched == sorted({s for r in moved for s in (r["old"], r["shard"])}) and moved
    got = {(r["doc_id"], r["_rl_shard"]) for r in spark.read.parquet(path).collect()}
    assert got == {(r["doc_id"], r["shard"]) for r in placed.collect()} and spark.read.parquet(path).count() == 400


def test_min_cost_flow():
    flow = sharding.min_cost_flow([10, 2, 0], [4, 4, 4], [[int(i != j) for j in range(3)] for i in range(3)])
    assert [sum(c) for c in zip(*flow)] == [4, 4, 4] and [sum(r) for r in flow] == [10, 2, 0]
    assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 6


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.1 * rng.standard_normal((30, 16)), base[:10]])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 1), (204, base[0].tolist(), None), (205, [1.0], 1), (206, [2.0], 1), (207, [], 1)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, rid string")
    got = {r["vec_id"]: r for r in embed.near_vectors(frame).collect()}
    y = x.astype(np.float32).astype(float)
    near_ = (y @ y.T) / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1) >= 0.98
    near_ &= (np.arange(len(y)) % 2)[:, None] == np.arange(len(y)) % 2
    assert [got[i]["n_links"] for i in range(len(y))] == (near_.sum(1) - 1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (200, 201, 202, 203, 204, 207))
    assert got[205]["n_links"] == 1 and got[206]["component_id"] == 205 and len(got) == len(rows)
    assert embed.near_vectors(frame.limit(0)).count() == 0


def test_embedding_recall(spark):
    """Pairs planted just above the threshold among many others: links found, against all pairs."""
    rng = np.random.default_rng(14)
    base = rng.standard_normal((9000, 32))
    noise = rng.standard_normal((1500, 32))
    noise -= (noise * base[:1500]).sum(1, keepdims=True) / (base[:1500] ** 2).sum(1, keepdims=True) * base[:1500]
    angle = np.arccos(rng.uniform(0.9802, 0.995, 1500))[:, None]
    size = np.linalg.norm(base[:1500], axis=1, keepdims=True)
    x = np.concatenate([base, np.cos(angle) * base[:1500] + np.sin(angle) * size * noise / np.linalg.norm(noise, axis=1, keepdims=True)])
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embed.near_vectors(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = np.concatenate([(unit[i : i + 500] @ unit.T >= 0.98).sum(1) - 1 for i in range(0, len(x), 500)])
    assert wanted.sum() >= 3000 and all(got[i] <= n for i, n in enumerate(wanted))
    assert sum(got.values()) >= 0.99 * wanted.sum()


def test_embeddings_of_extreme_size(spark):
    rows = [(0, [1e200, 0.0], 1), (1, [1e200, 1e200], 1), (2, [1.0, 0.01], 1), (3, [1e-200, 1e-200], 1), (4, [3e-320, 0.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (2, 0), 2: (2, 0), 4: (2, 0), 1: (1, 1), 3: (1, 1)}


def test_embedding_blocks(spark):
    """A bucket larger than a block gives every pair once."""
    embed.BLOCK, before = 16, embed.BLOCK
    try:
        rng = np.random.default_rng(6)
        centre = rng.standard_normal(16)
        rows = [(i, (centre + 0.02 * rng.standard_normal(16)).tolist(), 1) for i in range(120)]
        got = embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    finally:
        embed.BLOCK = before
    assert (got["component_id"] == 0).all() and (got["n_links"] == 119).all()


def test_quality(spark, odd, none):
    rng = np.random.default_rng(1)
    good, bad = ["fine", "words", "here", "and", "there", "today"], ["awful", "horrid", "nasty"]
    rows = [(i, " ".join(rng.choice(good, 30)) + (" " + " ".join(rng.choice(bad, 3)) if i % 4 == 0 else ""), "s%d" % (i % 5), "en", "clash") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, host string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 300)] + [(7, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["p_bad"] for r in quality.score(docs, quality.bad_labels(labels), F.col("source"), F.col("lang")).collect()}
    assert all((got[i] > 0.4) == (i % 4 == 0) for i in range(300, 400))
    kept = quality.keep_good(docs, quality.bad_labels(labels), F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i in range(400) if i % 4}
    assert quality.keep_good(odd, quality.bad_labels(labels.limit(0)), F.col("source"), F.col("lang")).count() == odd.count()
    assert quality.score(none, quality.bad_labels(labels), F.col("source"), F.col("lang")).count() == 0


def test_lm(spark, odd, none):
    got = lm.score(odd, tokenizer_path()).collect()
    assert len(got) == odd.count() and all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in odd.collect()]
    train = [w for d, ws in rows if not lm.held_out(d) for w in ws]
    c = {w: train.count(w) for w in set(train)}
    small = {(d, len(ws)): ws for d, ws in rows if len(ws) < 1000}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["train_tokens"] == len(train)
        if (ws := small.get((r["doc_id"], r["n_tokens"]))) is not None:
            assert abs(r["base_score"] - sum(np.log10((c.get(w, 0) + 1) / (len(train) + len(c) + 1)) for w in ws)) < 1e-6
            assert r["n_known"] == sum(w in c for w in ws)
    assert lm.score(none, tokenizer_path()).count() == 0


def small_vocabulary(shape, follows=None):
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_path()).get_vocab_size()
    return lm.Vocabulary(np.ones(size + 1), shape, follows)


def training(docs):
    return lm._cut(docs.select(F.lit(0).cast("long").alias("rid"), "doc_id", "text"), tokenizer_path(), {}).where("NOT held_out")


def test_lm_learns_from_every_training_document(spark):
    from rasterloom.llm import attention

    shape = attention.Shape(4, 16, 64, 16, 8)
    docs = spark.range(0, 6000).select(F.col("id").alias("doc_id"), F.lit(" ".join(["the"] * 15)).alias("text"))
    before, lm.TRAINER_TOKENS = lm.TRAINER_TOKENS, 20_000  # several trainers
    try:
        _, seen = lm.learn(training(docs), small_vocabulary(shape), shape, 5100, 5100 * 16)
    finally:
        lm.TRAINER_TOKENS = before
    assert seen == 16 * sum(not lm.held_out(d) for d in range(6000))  # "the" is one subword; 15 and the end


def test_lm_learns_short_documents_and_ends(spark):
    from rasterloom.llm import attention

    shape = attention.Shape(4, 16, 64, 16, 8)
    ids = [d for d in range(30) if not lm.held_out(d)][:5]
    rows = list(zip(ids, ["the the", " ".join(["the"] * 20), None, " ".join(["the"] * 15), " ".join(["the"] * 16)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights, seen = lm.learn(training(docs), small_vocabulary(shape), shape, 5, 60)
    assert seen == 3 + 21 + 1 + 16 + 17 and np.isfinite(weights).all()
    _, seen = lm.learn(training(docs.where(F.col("doc_id") == ids[0])), small_vocabulary(shape), shape, 1, 3)
    assert seen == 3


def test_lm_counts_what_follows_in_every_training_document(spark):
    from rasterloom.llm import attention

    shape = attention.Shape(4, 16, 64, 16, 8)
    v = small_vocabulary(shape)
    texts = training(spark.range(0, 50).select(F.col("id").alias("doc_id"), F.concat(F.lit("the sea the "), F.col("id")).alias("text"))).collect()
    wanted = np.zeros((65, 64))
    for r in texts:
        s = lm._slots(v, lm._ids(r["ids"]))
        np.add.at(wanted, (s[:-1], s[1:]), 1)
    got = lm._follows(spark.createDataFrame(texts), v, shape)
    assert (got == wanted).all() and wanted.sum() == sum(r["n_subwords"] for r in texts)


def test_lm_tasks_get_little_to_store():
    """What functions bring along becomes files on the driver and each executor: counts travel compressed, the table is made again."""
    import pickle

    from rasterloom.llm import attention

    shape = attention.Shape()
    rng = np.random.default_rng(4)
    follows = np.zeros((shape.slots + 1, shape.slots))
    np.add.at(follows, (rng.zipf(1.3, 200_000) % (shape.slots + 1), rng.zipf(1.3, 200_000) % shape.slots), 1)
    v = small_vocabulary(shape, follows)
    table, sent = v.step, pickle.dumps(v)
    assert len(sent) < 0.2 * table.nbytes and len(pickle.dumps(v.places)) < 150_000
    again = pickle.loads(sent)
    assert np.array_equal(again.step, table) and np.array_equal(again.prior, v.prior) and np.array_equal(again.cls, v.cls)
    assert np.allclose(np.exp(table + v.prior[:, v.cls]).sum(1), 1, atol=1e-4)


def test_lm_scores_one_token_at_a_time():
    """The batched, masked windows give each token the probability it has alone, and these sum to one over all ids."""
    from rasterloom.llm import attention

    shape, rng = attention.Shape(4, 16, 64, 16, 8), np.random.default_rng(3)
    v = small_vocabulary(shape, rng.integers(0, 5, (65, 64)).astype(float))
    flat = attention.initial(shape, np.zeros(16))
    w = attention.unflatten(shape, flat + 0.2 * rng.standard_normal(len(flat)).astype(np.float32))
    texts = [rng.integers(0, len(v.slot) - 1, n) for n in (0, 1, 15, 16, 17, 60)]
    stride = shape.window - lm.OVERLAP
    for ids, got in zip(texts, lm.score_texts(w, v, shape, texts)):
        slots, total = lm._slots(v, ids).astype(int), 0.0
        for t in range(len(ids) + 1):
            first = 0 if t < shape.window else -(-(t - shape.window + 1) // stride) * stride
            context = slots[first : t + 1]
            logs = np.array([attention.log_probabilities(w, context[None], np.full((1, len(context)), c), v.prior)[0, -1] for c in range(16)])
            each = logs[v.cls[v.slot]] + v.step[slots[t], v.slot] + v.within
            assert np.exp(each).sum() == pytest.approx(1, abs=1e-4)
            total += each[np.append(ids, len(v.slot) - 1)[t]]
        assert got == pytest.approx(total, rel=1e-4)


def test_lm_does_not_depend_on_shuffle_partitions(spark):
    rows = [(d, " ".join(f"word{(d * 7 + i * i) % 23}" for i in range(d % 40))) for d in range(60)]
    docs, width = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("2", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({r["doc_id"]: r["score"] for r in lm.score(docs, tokenizer_path()).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", width)
    assert got[0] == got[1] and len(got[0]) == 60


def test_lm_scores_with_a_quarter_of_the_window_before():
    assert lm.OVERLAP >= 12


def test_padding_has_no_gradient():
    from rasterloom.llm import attention

    shape, rng = attention.Shape(4, 6, 10, 7, 5), np.random.default_rng(0)
    flat = rng.standard_normal(len(attention.initial(shape, np.zeros(7)))) * 0.5
    slots, targets = rng.integers(0, 11, (3, 6)), rng.integers(0, 7, (3, 6))
    targets[1, 4:] = -1
    other = slots.copy()
    other[1, 4:] = (other[1, 4:] + 3) % 11
    (a, g), (b, h) = (attention.loss_and_gradient(shape, flat, s, targets) for s in (slots, other))
    logs = attention.log_probabilities(attention.unflatten(shape, flat), slots, np.maximum(targets, 0))
    assert a == pytest.approx(b) and np.allclose(g, h, atol=1e-6) and a == pytest.approx(-logs[targets >= 0].mean())


def test_attention_gradient():
    from rasterloom.llm import attention

    shape, rng = attention.Shape(4, 6, 10, 7, 5), np.random.default_rng(0)
    flat = rng.standard_normal(len(attention.initial(shape, np.zeros(7)))) * 0.5
    slots, targets = rng.integers(0, 11, (3, 6)), rng.integers(0, 7, (3, 6))
    _, g = attention.loss_and_gradient(shape, flat, slots, targets)
    for i in range(0, len(flat), 7):
        a, b = flat.copy(), flat.copy()
        a[i] += 1e-5
        b[i] -= 1e-5
        slope = (attention.loss_and_gradient(shape, a, slots, targets)[0] - attention.loss_and_gradient(shape, b, slots, targets)[0]) / 2e-5
        assert abs(slope - g[i]) < 1e-3 * (1 + abs(slope))
    later = targets.copy()
    later[:, -1] = (later[:, -1] + 1) % 7
    w = attention.unflatten(shape, flat)
    changed = slots.copy()
    changed[:, -1] = (changed[:, -1] + 1) % 11
    same = attention.log_probabilities(w, slots, targets)[:, :-1] == attention.log_probabilities(w, changed, targets)[:, :-1]
    assert same.all()  # causal


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(9)
    text = " ".join(f"w{i}" for i in rng.integers(0, 5000, 400))
    words = text.split()
    copies = [(100 + k, " ".join(words[:k] + ["new"] + words[k + 1 :])) for k in (50, 150, 300)]
    rows = [(99, text), *copies, (200, " ".join(f"v{i}" for i in rng.integers(0, 5000, 400)))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "a", "b", "c", "d", "e", "f") for d, t in rows], SCHEMA)
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [99, 200]
    left = sorted(str(r["doc_id"]) for r in near.keep_first(odd).collect())
    assert "1" in left and "2" not in left and "3" in left and "4" not in left and "5" not in left and left.count("9") <= 1
    assert near.keep_first(none).count() == 0


def edited(rng, words, n):
    """n of the words changed, far enough apart that each changes five shingles."""
    at = rng.choice(np.arange(10, len(words) - 10, 10), n, replace=False)
    return [f"new{rng.integers(1 << 40)}" if i in at else w for i, w in enumerate(words)]


def test_near_duplicates_by_a_third(spark):
    """L is like x and x is like y, L and y are not: one stays, though L leads every group it is in."""
    rng, rows = np.random.default_rng(12), []
    for k in range(60):
        text = [f"w{i}" for i in rng.integers(0, 1 << 40, 304)]
        x = edited(rng, text, 4)
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join(x)), (10 * k + 2, " ".join(edited(rng, x, 4)))]
    kept = near.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [10 * k for k in range(60)]


def test_near_duplicates_in_salted_groups(spark):
    """A group over SPLIT texts is dealt to several; their leaders join them."""
    rng = np.random.default_rng(21)
    text = [f"w{i}" for i in rng.integers(0, 1 << 40, 304)]
    rows = [(i, " ".join(edited(rng, text, 1))) for i in range(60)] + [(100, " ".join(edited(rng, text, 20)))]
    near.SPLIT, before = 8, near.SPLIT
    try:
        kept = near.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r["doc_id"] for r in kept.collect()) == [0, 100]
    finally:
        near.SPLIT = before


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of 0.78 to 0.83: the exact similarity of the shingles decides."""
    rng, rows, like = np.random.default_rng(13), [], {}
    for k in range(80):
        text = [f"w{i}" for i in rng.integers(0, 1 << 40, 304)]
        other = edited(rng, text, 6)[: 304 - k % 4] if k % 2 else edited(rng, text, 7)[: 304 - k % 3]
        a, b = ({" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (text, other))
        like[k] = len(a & b) / len(a | b) >= 0.8
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join(other))]
    kept = {r["doc_id"] for r in near.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: 10 * k + 1 not in kept for k in like} == like and 20 < sum(like.values()) < 60


def test_pairs_apart_in_blocks(spark):
    """Every pair of a group over a block is compared."""
    near.BLOCK, before = 8, near.BLOCK
    try:
        same = np.zeros(near.SLOTS, np.uint8).tobytes()
        met = spark.createDataFrame([(0, 5, i, same) for i in range(40)], "band int, key long, node long, slots binary")
        with Scratch() as scratch:
            got = {tuple(sorted((r["a"], r["b"]))) for r in near._apart(met, spark.createDataFrame([(0, 0), (1, 0)], "node long, component long"), 0.8, scratch).collect()}
    finally:
        near.BLOCK = before
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40)} - {(0, 1)}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = a.copy()
    b[:111] = rng.integers(0, 1 << 63, 111, dtype=np.uint64)
    assert abs((near.sketch(a)[1] == near.sketch(b)[1]).mean() - 0.8) < 0.15


def test_kept_hash_of_query_matches_bytes(spark, odd):
    r = suffix.remove_repeats(odd).where("doc_id = 1").select("kept", F.sha2("kept", 256).alias("h")).first()
    assert r["h"] == hashlib.sha256(bytes(r["kept"])).hexdigest()


@pytest.mark.parametrize("block", [16, 1024])
def test_apart_links_join_parts_by_exact_similarity(block):
    """Of many near copies below and above the threshold, the links join what brute force joins, and are no more than texts."""
    import pyarrow as pa

    rng = np.random.default_rng(31)
    base = rng.integers(0, 1 << 62, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) < keep], rng.integers(0, 1 << 62, 5, dtype=np.uint64)])) for keep in rng.uniform(0.7, 1, 120)]
    slots = np.zeros(near.SLOTS, np.uint8).tobytes()
    blocks, mine = -(-len(sets) // block), [i % -(-len(sets) // block) for i in range(len(sets))]
    rows = [(0, 7, x, y, mine[i], i, i, slots, sets[i].tobytes()) for x in range(blocks) for y in range(x, blocks) for i in range(len(sets)) if mine[i] in (x, y)]
    names = ["band", "key", "x", "y", "mine", "node", "part", "slots", "shingles"]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], names)
    got = [p for b in near.apart_links([batch], 0.6, 0.8) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    true = {(i, j) for i in range(120) for j in range(i + 1, 120) if (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}

    def parts(links):
        part = list(range(120))
        for a, b in links:
            part = [part[a] if p == part[b] else p for p in part]
        return {frozenset(i for i in range(120) if part[i] == p) for p in part}

    assert {tuple(sorted(p)) for p in got} <= true and parts(got) == parts(true) and 2 < len(parts(true)) < 120
    assert len(got) < 120 * blocks * (blocks + 1) / 2 and len(true) > 500


def test_lm_cuts_groups_of_texts():
    """Words and subwords of groups of texts, each kind looked up once, are those of each text alone."""
    import pyarrow as pa

    from rasterloom.llm.common import utf8
    from rasterloom.llm.subwords import PartCache

    rng = np.random.default_rng(4)
    alphabet = ["a", "Be", "É", "ß", "÷", "'s", "'LL'", "12", ",", "...", "<|", " ", "  ", "\n", "\x0b", "\x1c", "\xa0", "中", "the "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(800)] + ["x" * (lm.GROUP + 1), None, " ", "the end " * 300_000]
    column, cache, seen = pa.array(texts, pa.string()), PartCache(tokenizer_path()), 0
    ends = list(lm._groups(column)) + [(100, 300), (301, 302)]  # and slices within a batch
    for lo, hi in ends:
        part = [t.lower() for t in utf8(column.slice(lo, hi - lo))]
        assert part == [(t or "").encode().lower() for t in texts[lo:hi]]
        who, codes, kinds = lm._words(part)
        names = kinds.to_pylist()
        assert [(i, names[c]) for i, c in zip(who, codes)] == [(i, w) for i, t in enumerate(part) for w in t.split()]
        ids, n = cache.encode_flat(part)
        stops = np.cumsum(n)
        assert [ids[b - k : b].tobytes() for b, k in zip(stops, n)] == [cache.encode(t.decode()) for t in part]
        seen += hi - lo
    assert seen == len(texts) + 201 and len(ends) > 3
