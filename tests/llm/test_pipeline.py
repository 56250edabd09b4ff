"""All stages of the corpus pipeline, each on what the one before kept, against brute force."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from rasterloom.llm import decontam, quality
from rasterloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, best string, mark string, rest string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, item = prose(60), prose(30)
    rows = [(i, prose(int(rng.integers(40, 200)))) for i in range(80)]
    rows += [(100 + i, "vile horrid filth " * 10 + prose(60)) for i in range(20)]
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, rows[4][1] + " one more word")]
    rows += [(210, prose(30) + " " + passage + " " + prose(30)), (211, prose(40) + " " + passage + " " + prose(20))]
    rows += [(220, prose(50) + " " + item + " " + prose(10)), (221, prose(50) + " " + " ".join("other" if i in (9, 15) else w for i, w in enumerate(item.split()) if 3 <= i < 20))]  # short enough runs to outlive the stage before
    rows += [(230, None), (231, ""), (232, " \n "), (None, prose(70)), (240, "long " + prose(9000)), (5, rows[5][1]), (5, rows[5][1])]
    full = [(d, t, "en", "s%d" % ((d or 0) % 3) if d != 6 else None, None if t is None else len(t), "a", "b", "c", "d") for d, t in rows]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(full, SCHEMA).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(12)] + [(None, 0, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_stages_against_brute_force(spark, corpus, tmp_path):
    docs, stages = spark.read.parquet(f"{corpus}/documents.parquet"), dict(corpus_pipeline.STAGES)
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "packing"]

    def step(name, docs):
        stages[name](spark, docs, corpus).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    kept = step("quality", docs)
    assert kept.columns == columns
    gone = {d for d, _ in texts(docs)} - {d for d, _ in texts(kept)}
    assert gone >= set(range(100, 120)) and not gone & {*range(80), 200, 201, 202, 210, 211, 220, 221}  # toxic ones, labelled or not

    kept = docs.where("doc_id IS NULL OR doc_id NOT BETWEEN 100 AND 119")  # with the odd rows, whatever became of them
    before, kept = texts(kept), step("near_duplicates", kept)
    assert kept.columns == columns
    key = lambda d: (d is None, d)
    rows = sorted(set(before), key=lambda x: (key(x[0]), x[1] or ""))
    like = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = like[i], like[j]
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    wanted = sorted({(r, t) for g, (r, t) in zip(group, rows) if r == rows[g][0]}, key=str)
    got = sorted(texts(kept), key=str)
    # Null and blank texts are copies, so one of the smallest id stays.
    assert [d for d, _ in got] == [d for d, _ in wanted]

    before, kept = texts(kept), step("repeated_passages", kept)
    assert kept.columns == columns
    rank = lambda d: 2**63 - 1 if d is None else d
    wanted = {}
    for d, t in before:
        b = (t or "").encode()
        earlier = {o.encode()[i : i + 50] for e, o in before if o and rank(e) < rank(d) for i in range(len(o.encode()) - 49)}
        hide = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if b[i : i + 50] in earlier:
                hide[i : i + 50] = True
        wanted[d] = None if t is None else bytes(np.frombuffer(b, np.uint8)[~hide]).decode(errors="ignore")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert {d: t for d, (t, _) in got.items()} == wanted and len(got) == len(before)
    assert all(n == (None if t is None else len(t)) for t, n in got.values()) and any(wanted[d] != t for d, t in before)

    before, kept = texts(kept), step("decontamination", kept)
    assert kept.columns == columns
    assert {d for d, _ in before} - {d for d, _ in texts(kept)} == {220, 221}

    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(tokenizer_path()), {}
    for r in step("packing", kept).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == {d for d, _ in texts(kept)}
    for d, t in texts(kept):
        ids, at = tokenizer.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            cut = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(cut) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    taken = sorted((r["sequence_id"], r["offset"], r["length"]) for rs in pieces.values() for r in rs)
    for (s, o, n), (s2, o2, _) in zip(taken, taken[1:]):
        assert o + n <= 2048 and (o2 == o + n if s2 == s else o2 == 0)


def test_run_and_no_rows(spark, corpus, tmp_path):
    whole = corpus_pipeline.run(spark, corpus)
    assert whole.count() > 80
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_site_rates_by_hand(spark):
    """Rates of sparse sites, each document without itself, against the formula written out."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        host, path = f"h{i % 12}", f"h{i % 12}/p{i % 5}"
        bad = rng.random() < (0.9 if i % 12 < 3 else 0.1)
        rows.append((i, "some words", host, path))
        labels.append((i, int(bad)))
    rows.append((600, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, bad int"), F.col("host"), F.col("path")).collect()}
    assert len(got) == 601
    e = np.array([b for _, b in labels] + [1 / (1 + np.exp(-got[600]["logit"]))])
    hosts = np.array([r[2] or "" for r in rows])
    paths = np.array([r[3] or "" for r in rows])
    prior = e.mean()

    def strength(sites, parent):
        inside = spread = k = 0
        for s in set(sites):
            x = e[sites == s]
            inside, spread, k = inside + ((x - x.mean()) ** 2).sum(), spread + len(x) * (x.mean() - parent(s)) ** 2, k + 1
        within = inside / (len(e) - k)
        between = (spread - k * within) / len(e)
        return min(1e6, max(1, within / between)) if between > 0 else 1e6

    s = strength(hosts, lambda _: prior)
    assert s < 20  # hosts differ, so their own documents count for much
    host_rate = lambda h: (e[hosts == h].sum() + s * prior) / ((hosts == h).sum() + s)
    t = strength(paths, lambda p: host_rate(hosts[paths == p][0]))
    for i in (0, 1, 5, 599, 600):
        others = hosts == hosts[i]
        others[i] = False
        h = (e[others].sum() + s * prior) / (others.sum() + s)
        near = paths == paths[i]
        near[i] = False
        p = (e[near].sum() + t * h) / (near.sum() + t)
        assert got[i]["host_rate"] == pytest.approx(h) and got[i]["path_rate"] == pytest.approx(p)
    assert np.mean([got[i]["path_rate"] for i in range(0, 600, 12)]) > 0.7 > 0.3 > np.mean([got[i]["path_rate"] for i in range(5, 600, 12)])


def test_decontamination_by_shuffle(spark, corpus):
    """Beyond the broadcast bound the same overlaps are found."""
    docs, bench = (spark.read.parquet(f"{corpus}/{n}.parquet") for n in ("documents", "benchmark"))
    order = lambda f: sorted(map(tuple, f.collect()), key=str)
    few = order(decontam.overlaps(docs, bench))
    decontam.BROADCAST_SEEDS, before = 0, decontam.BROADCAST_SEEDS
    try:
        assert order(decontam.overlaps(docs, bench)) == few and len(few) == 2
    finally:
        decontam.BROADCAST_SEEDS = before
