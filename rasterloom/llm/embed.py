"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, distributed components.

Equal vectors of a label are one class from the start. Each class goes to one bucket per table, by its signs against
that table's hyperplanes. The number of bits follows the largest label's size and the number of tables follows from the
wanted recall at the threshold, so buckets stay small at any size. A bucket over BLOCK classes is dealt to pairs of
blocks, every pair of classes meeting in one of them. A link is counted in the first table in which its ends meet, so
counts add up without gathering links; each task passes on a spanning forest only.

Nulls and edges: a vector that is null, empty, zero or has a null or non-finite component, or whose label is null,
links with nothing (n_links 0, component its own id); vectors of different lengths are never compared; repeated rows
count as vectors; a null id keeps its row, its own component id being its class's; very large and very small components
are scaled by a power of two before they are multiplied; an empty table gives an empty result; further columns are not
read. Vectors travel as 32-bit floats where these hold them exactly, so the cosine is always that of the given numbers in
double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Scratch, columns, materialise, with_least
from rasterloom.llm.components import connected_components

BLOCK = 1024
#: Classes that a bucket of unrelated vectors should hold.
BUCKET = 32


def planes(dims: int, bits: int, tables: int, seed: int = 11):
    import numpy as np

    return np.random.default_rng([seed, dims, bits, tables]).standard_normal((dims, bits * tables))


def pack_vectors(x) -> list[bytes]:
    """Rows of a float64 array as bytes, with four bytes a component where that loses nothing; the first byte says which."""
    import numpy as np

    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
        fits = (short == x).all(1)
    return [b"f" + s.tobytes() if f else b"d" + d.tobytes() for f, s, d in zip(fits, short, x)]


def unpack_vectors(rows: list[bytes]):
    """The rows again, each scaled by a power of two so that its largest component is between a half and one."""
    import numpy as np

    x = np.array([np.frombuffer(r, np.float32 if r[:1] == b"f" else np.float64, offset=1).astype(np.float64) for r in rows])
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def parameters(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables): buckets of about BUCKET classes; pairs at the threshold found with the wanted probability."""
    bits = min(24, max(4, math.ceil(math.log2(max(largest, 1) / BUCKET + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.998, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id): n_links other vectors of its label have cosine >= threshold with it."""
    v = columns(vectors, **{id_col: "long", vector_col: "array<double>", label_col: "string"}).toDF("vec_id", "vector", "label")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    v = v.withColumn("label", F.when(valid, F.col("label")))
    classes = v.where("label is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes, _ = materialise(classes.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    largest = classes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    found = _links(classes, *parameters(largest, threshold, recall), threshold)
    found, _ = materialise(found, "links")
    parts = connected_components(found.where("root is not null").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    with Scratch() as scratch:
        named = classes.select("rid", "first", "weight").join(counts, "rid", "left").join(parts, F.col("rid") == parts["node"], "left").select("rid", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component"))
        named = scratch.keep(named, "named")
        named = materialise(with_least(named, "component", "first", "component_id", scratch).select("rid", "n_links", "component_id"), "classes")[0]
    by_vector = classes.select("rid", "label", "vector").join(named, "rid").select("label", "vector", "n_links", "component_id")
    linked = v.where("label is not null").join(by_vector, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = v.where("label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def _links(classes: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """(rid, links, root) rows: links to add to a class's count, and a class it is connected to (or null)."""

    def sign(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            vectors = b.column("vector").to_pylist()
            sigs, made = np.zeros((len(vectors), tables), np.int64), [b""] * len(vectors)
            for dims in {len(x) for x in vectors}:
                at = [i for i, x in enumerate(vectors) if len(x) == dims]
                x = np.array([vectors[i] for i in at])
                for i, p in zip(at, pack_vectors(x)):
                    made[i] = p
                signs = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) @ planes(dims, bits, tables) > 0
                sigs[at] = signs.reshape(len(at), tables, bits) @ (1 << np.arange(bits))
            packed, short = pa.array(made, pa.binary()), pa.array([s.astype(np.int32).tobytes() for s in sigs], pa.binary())
            for t in range(tables):
                yield pa.record_batch([b.column("label"), pa.array([t] * len(vectors), pa.int32()), pa.array(sigs[:, t]), b.column("rid"), b.column("weight"), pa.array([len(x) for x in vectors], pa.int32()), packed, short], ["label", "tab", "sig", "rid", "weight", "dims", "vector", "sigs"])

    signed = classes.select("label", "rid", "weight", "vector").mapInArrow(sign, "label string, tab int, sig long, rid long, weight long, dims int, vector binary, sigs binary")
    key = ["label", "dims", "tab", "sig"]
    sizes = signed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    mine = F.pmod(F.xxhash64("rid"), F.col("blocks"))
    # Block pair (x, y), x <= y: a class of block m goes to (m, m..) and to (0..m, m).
    both = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("x"), F.greatest(o, F.col("mine")).alias("y")))
    dealt = signed.join(sizes, key).withColumn("mine", mine).withColumn("to", F.explode(both)).select(*key, "to.x", "to.y", "mine", "rid", "weight", "vector", "sigs")

    def compare(key, t):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        tab, x, y = key[2].as_py(), key[4].as_py(), key[5].as_py()
        rid, weight = t.column("rid").to_numpy(), t.column("weight").to_numpy()
        mine, vectors = t.column("mine").to_numpy(), t.column("vector").to_pylist()
        sigs = np.array([np.frombuffer(s, np.int32) for s in t.column("sigs").to_pylist()])
        links, root = np.zeros(len(rid), np.int64), np.arange(len(rid))
        a, b = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        if len(a) and len(b):
            scaled = unpack_vectors(vectors)
            _compare(a, b, x == y, scaled[a], scaled[b], threshold, sigs[:, :tab], weight, links, root)
        on = (links > 0) | (root != np.arange(len(rid)))
        return pa.table([rid[on], links[on], np.where(root == np.arange(len(rid)), -1, rid[root])[on]], schema=schema)

    out = dealt.groupBy(*key, "x", "y").applyInArrow(compare, "rid long, links long, root long")
    return out.withColumn("root", F.when(F.col("root") >= 0, F.col("root")))


def _compare(a, b, same: bool, va, vb, threshold: float, earlier, weight, links, root) -> None:
    """Adds to links and root what the rows a and b (of one bucket) have with each other."""
    import numpy as np

    from rasterloom.llm.vptree import forest

    na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
    ends_i, ends_j = [], []
    for lo in range(0, len(a), 256):
        near = va[lo : lo + 256] @ vb.T >= threshold * (na[lo : lo + 256, None] * nb[None])
        if same:
            near = np.triu(near, lo + 1)
        i, j = np.nonzero(near)
        i, j = a[lo + i], b[j]
        ends_i.append(i)
        ends_j.append(j)
        new = ~(earlier[i] == earlier[j]).any(1)
        np.add.at(links, i[new], weight[j[new]])
        np.add.at(links, j[new], weight[i[new]])
    # Roots of the whole group so far, joined with the new links.
    i, j = np.concatenate(ends_i), np.concatenate(ends_j)
    root[:] = forest(len(root), np.concatenate([i, np.arange(len(root))]), np.concatenate([j, root]))
