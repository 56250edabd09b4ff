"""SimHash near-duplicates, found exactly by vantage-point trees.

Fingerprints are made in one pass over the texts. Equal ones are grouped before anything else, so copies cost nothing.
A vantage-point tree fitted on a bounded sample parts the distinct fingerprints into shards; those near a boundary go
to both sides; each shard links its pairs by a tree of its own and gives only a spanning forest of them. Components
are found by distributed steps. Nothing is gathered by document.

Nulls and edges: a null or blank text has no words and the fingerprint zero, which links like any other; a null id
keeps its fingerprint and gets its group's component; repeated rows stay; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Scratch, columns, materialise, utf8, with_groups, with_least
from rasterloom.llm.components import connected_components

SEED = 42
#: Distinct fingerprints that the shard tree is fitted on, chosen by their hash: about SAMPLE + GROWTH * sqrt(all of them).
SAMPLE, GROWTH = 20_000, 64


def shingle_hashes(text: bytes, size: int):
    """XXH64 of each run of `size` words, repeats included; of the whole sequence if it has fewer words; none without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(blanks[: len(words) - size] + 1).tolist()]
    ends = [*blanks[size - 1 :].tolist(), len(joined)]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


def majority(hashes) -> int:
    """The fingerprint: each bit that is set in over half the hashes, as a signed 64-bit number."""
    import numpy as np

    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 8192):  # a very long text takes bounded memory
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    rows = columns(docs, **{id_col: "long", text_col: "string"})

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.record_batch([part.column(0), pa.array([majority(shingle_hashes(t, shingle)) for t in utf8(part.column(1))], pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect just those linked by distances up to the radius."""
    import numpy as np

    from rasterloom.llm.vptree import Tree

    half = (radius + 1) // 2
    n = distinct.count()
    share = int(2**40 * min(1.0, (SAMPLE + GROWTH * n**0.5) / max(n, 1)))
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(2**40)) < share).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    # A shard holds some 4096 fingerprints, whatever their number, down to the tree's bound on leaves.
    tree = Tree(picked, half, max(32, int(4096 * len(picked) / max(n, 1))))

    def route(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            at, leaf = tree.route(x.view(np.uint64))
            yield pa.record_batch([pa.array(leaf, pa.int64()), pa.array(x[at], pa.int64())], ["shard", "fp"])

    def link(key, t):
        import pyarrow as pa

        from rasterloom.llm.vptree import forest, linked

        x = np.unique(t.column("fp").to_numpy())
        root = forest(len(x), *linked(x.view(np.uint64), radius)) if len(x) > 1 else np.zeros(len(x), np.int64)
        moved = root != np.arange(len(x))
        return pa.table({"a": x[moved], "b": x[root[moved]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return distinct.mapInArrow(route, "shard long, fp long").groupBy("shard").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links of at most `radius` differing bits."""
    prints, _ = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    with Scratch() as scratch:
        groups = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_rl_n")), "groups")
        parts = connected_components(fingerprint_links(groups.select("fp"), radius))
        named = scratch.keep(groups.join(parts, groups["fp"] == parts["node"], "left").select("fp", "first", "_rl_n", F.coalesce("component", "fp").alias("component")), "named")
        by_print = materialise(with_least(named, "component", "first", "component_id", scratch).select("fp", "component_id", "_rl_n"), "prints")[0]
    return with_groups(prints, by_print, ["fp"]).select("doc_id", "fp", "component_id")
