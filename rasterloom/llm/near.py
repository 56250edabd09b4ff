"""Near-duplicate documents by word shingles: SimHash fingerprints over samples of them, then their similarity.

Two texts whose five-word shingles agree to 0.8 differ in some ten bits of a 64-bit SimHash. No vantage-point tree prunes
at such a radius (a level copies over 0.8 of the fingerprints to both sides), so one fingerprint per text, as
rasterloom.llm.simhash searches it at radius 2, finds only closer pairs. Here each text has BANDS more SimHash
fingerprints, each over the ROWS shingles that come first under a hash order of its own: similar texts share these
samples with a chance of similarity ** ROWS, and then the fingerprints are equal. Texts that meet in a fingerprint are
compared by SLOTS minimum hashes of a byte (standard error of the similarity at most 0.05). Those whose estimate is at
most MARGIN below the threshold are candidates, and the exact Jaccard similarity of their shingle sets decides: 0.8 or
more links them.

A group that meets is streamed past its leaders: a text is a candidate with each leader it resembles, and leads itself
if there is none. Most copies are joined by this. Then, in each group whose texts are not all joined, every pair of
texts that are still apart is compared; a group over BLOCK texts is dealt to pairs of blocks, where every two texts meet.
A block's texts bring their shingle sets, so the exact similarity is decided there, and what leaves the block is a link
for each two parts that it joins: many near copies that stay below the threshold make no rows.

Exact copies are one text from the start. Links of both kinds make components, and the smallest id of each stays.
Intermediate tables go as soon as the next one is written; minimum hashes are shuffled only for texts that meet others.

Nulls and edges: null and blank texts are copies of each other; a null id stays if its text's group has no id; of rows
with equal ids and texts one stays, of rows with equal ids and other texts those that are no copies of another stay; an
empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import HOT, Scratch, columns, materialise, release, utf8, with_groups, with_least
from rasterloom.llm.components import connected_components
from rasterloom.llm.simhash import fingerprint_links, majority

BANDS, ROWS, SLOTS = 12, 3, 64
#: Texts in a block of those compared pair by pair; texts that are streamed past the same leaders.
BLOCK, SPLIT = 1024, 1 << 14
#: How far below the threshold an estimate may lie: four standard errors at 0.8.
MARGIN = 0.2


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


FACTORS = _factors(BANDS + SLOTS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: A random number for each byte, an odd base of the polynomial that strings of them make, and its inverse.
_BYTES = np.random.default_rng(23).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Shingles that are hashed at once.
_AT_ONCE = 1 << 16


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, at least."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x, dtype=np.uint64)
    return _POWERS


def shingles(joined: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, of words joined by one blank; of all words if there are fewer; none without."""
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    blanks = np.flatnonzero(data == 32)
    size = min(size, len(blanks) + 1)
    starts = np.concatenate([[0], blanks[: len(blanks) + 1 - size] + 1])
    stops = np.concatenate([blanks[size - 1 :], [len(data)]])
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), _AT_ONCE):
        a, b = starts[at : at + _AT_ONCE], stops[at : at + _AT_ONCE]
        part = data[a[0] : b[-1]]
        powers, inverse = _powers(len(part) + 1)
        # A string's polynomial is a difference of prefix sums, moved to its start.
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * powers[: len(part)], dtype=np.uint64)])
        out[at : at + _AT_ONCE] = (sums[b - a[0]] - sums[a - a[0]]) * inverse[a - a[0]]
    return _mix(_mix(out) + np.uint64(size))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band fingerprints, minimum hashes) of a text's shingles; repeats count once."""
    h = np.unique(hashes)
    if not len(h):
        return np.zeros(BANDS, np.int64), np.zeros(SLOTS, np.uint8)
    (a, b), first = FACTORS, np.empty((BANDS, min(ROWS, len(h))), np.uint64)
    for i in range(BANDS):
        first[i] = h[np.argpartition((h ^ b[i]) * a[i], ROWS - 1)[:ROWS]] if len(h) > ROWS else h
    # The SimHash of up to three: bits that are set in over half of them.
    one, two, three = first[:, 0], first[:, min(1, len(h) - 1)], first[:, -1]
    most = (one & two) | (one & three) | (two & three) if len(h) > 2 else one & two
    bands = most ^ np.bitwise_xor.reduce(first * a[:BANDS, None], axis=1)
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 512):  # a very long text takes bounded memory
        np.minimum(low, ((h[at : at + 512, None] ^ b[BANDS:]) * a[BANDS:]).min(0), out=low)
    return bands.view(np.int64), (_mix(low * np.uint64(0x94D049BB133111EB)) >> np.uint64(56)).astype(np.uint8)


def _copy(joined: bytes) -> bytes:
    from xxhash import xxh128_digest

    return xxh128_digest(joined)


def _words(text: bytes) -> bytes:
    """A text's words, A-Z in lower case, joined by one blank; the six ASCII blanks part words."""
    return b" ".join(text.lower().split())


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, copy, fp, bands, slots): copy is equal for equal word sequences (128 bits)."""
    rows = columns(docs, doc_id="long", text="string")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [_words(t) for t in utf8(part.column(1))]
                hashes = [shingles(t, shingle) for t in texts]
                made = [sketch(h) for h in hashes]
                yield pa.record_batch(
                    [part.column(0), pa.array([_copy(t) for t in texts], pa.binary()), pa.array([majority(h) for h in hashes], pa.int64()), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1].tobytes() for m in made], pa.binary())],
                    ["doc_id", "copy", "fp", "bands", "slots"],
                )

    return rows.mapInArrow(run, "doc_id long, copy binary, fp long, bands array<long>, slots binary")


def stream_links(batches: Iterable, similarity: float) -> Iterator:
    """Rows (band, key, a, b) of sorted rows (band, key, salt, node, slots): each group's members with the leaders they resemble.

    A leader is given with itself. A group is a key's rows of one salt.
    """
    import pyarrow as pa

    group, leaders, sketch_of, out = None, [], np.zeros((0, SLOTS), np.uint8), []
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        for key, node, slots in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            mine = np.frombuffer(slots, np.uint8)
            if key != group:
                group, leaders, sketch_of = key, [node], mine[None].copy()
                out.append((*key[:2], node, node))
                continue
            near = np.flatnonzero((sketch_of[: len(leaders)] == mine).mean(1) >= similarity)
            out += [(*key[:2], node, leaders[i]) for i in near.tolist()]
            if not len(near):
                if len(leaders) == len(sketch_of):  # room for twice as many
                    sketch_of = np.concatenate([sketch_of, np.zeros_like(sketch_of)])
                sketch_of[len(leaders)] = mine
                leaders.append(node)
                out.append((*key[:2], node, node))
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["band", "key", "a", "b"])
        out = []


def _led(met: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): candidates of rows (band, key, salt, first, node, slots), by leaders.

    A key that very many texts have is dealt to several groups by salt; their leaders then meet in one.
    """
    order = ["band", "key", "salt"]
    stream = lambda rows: rows.repartition(*order).sortWithinPartitions(*order, "first", "node").select(*order, "node", "slots").mapInArrow(lambda batches: stream_links(batches, similarity), "band int, key long, a long, b long")
    made = scratch.keep(stream(met), "led")
    salted = met.where("salt > 0").select("band", "key").distinct()
    if not met.where("salt > 0").limit(1).count():
        return made.where("a <> b").select("a", "b")
    again = made.where("a = b").select("band", "key", F.col("a").alias("node")).join(F.broadcast(salted) if salted.count() < HOT else salted, ["band", "key"]).distinct()
    leaders = met.join(again, ["band", "key", "node"]).withColumn("salt", F.lit(0).cast("long"))
    return made.unionByName(stream(leaders)).where("a <> b").select("a", "b")


def _alike(one: list[np.ndarray], two: list[np.ndarray], i: int, rest: np.ndarray, similarity: float) -> np.ndarray:
    """Which of two's sets `rest` have a Jaccard similarity of at least `similarity` with one's i-th; sets are sorted hashes."""
    mine = one[i]
    if not len(rest):
        return rest
    sizes = np.array([len(two[j]) for j in rest])
    rest, sizes = (x[np.minimum(sizes, len(mine)) >= similarity * np.maximum(sizes, len(mine))] for x in (rest, sizes))
    on = np.zeros(len(rest), bool)
    for at in range(0, len(rest), 256):  # long texts take bounded memory
        theirs, n = [two[j] for j in rest[at : at + 256]], sizes[at : at + 256]
        every = np.concatenate(theirs)
        place = np.searchsorted(mine, every)
        hit = mine[np.minimum(place, len(mine) - 1)] == every if len(mine) else np.zeros(len(every), bool)
        hits = np.concatenate([[0], np.cumsum(hit)])
        stop = np.cumsum(n)
        both = hits[stop] - hits[stop - n]
        on[at : at + 256] = both >= similarity * (len(mine) + n - both)
    return rest[on]


def apart_links(batches: Iterable, similarity: float, exact: float | None = None) -> Iterator:
    """Links (a, b) of sorted rows (band, key, x, y, mine, node, part, slots): similar texts of blocks x and y whose parts differ.

    exact: rows have the shingle sets too; links reach this similarity of them, one for each part that a text joins.
    """
    import pyarrow as pa

    def compare(rows: list) -> list:
        (_, _, x, y), out = rows[0][0], []
        one, two = [r for r in rows if r[1] == x], [r for r in rows if r[1] == y]
        part = np.array([r[3] for r in two], np.int64)
        own = part if x == y else np.array([r[3] for r in one], np.int64)
        slots = np.frombuffer(b"".join(r[4] for r in two), np.uint8).reshape(-1, SLOTS)
        if exact is not None:
            mine, theirs = ([np.frombuffer(r[5], np.uint64) for r in side] for side in (one, two))
        for i, r in enumerate(one):
            rest = np.flatnonzero(part != own[i])
            if x == y:
                rest = rest[rest > i]
            near = rest[(slots[rest] == np.frombuffer(r[4], np.uint8)).mean(1) >= similarity] if len(rest) else rest
            if exact is not None and len(near):
                near = _alike(mine, theirs, i, near, exact)
                met, first = np.unique(part[near], return_index=True)
                near = near[first]
                for side in (part, own):  # the parts that it joins are one from here on
                    side[np.isin(side, met)] = own[i]
            out += [(r[2], two[j][2]) for j in near.tolist()]
        return out

    def made(out: list):
        cols = list(zip(*out)) or [[], []]
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    rows: list = []
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if rows and rows[0][0] != r[:4]:
                yield made(compare(rows))
                rows = []
            rows.append((r[:4], *r[4:]))
    if rows:
        yield made(compare(rows))


def _apart(met: DataFrame, parts: DataFrame, similarity: float, scratch: Scratch, sets=None, exact: float | None = None) -> DataFrame:
    """(a, b): similar texts of a fingerprint that the links so far leave in different parts.

    The texts of a group's largest part are compared with all others, not with each other. sets: gives (node, shingles)
    of a table of nodes; then the links are those of apart_links() with `exact`.
    """
    key = ["band", "key"]
    named = scratch.keep(met.join(parts, "node", "left").select(*key, "node", F.coalesce("component", "node").alias("part"), "slots"), "named")
    sizes = named.groupBy(*key, "part").agg(F.count("*").alias("n")).groupBy(*key).agg(F.expr("max_by(part, struct(n, part))").alias("bulk"), F.max("n").alias("most"), F.sum("n").alias("_rl_n"), F.count("*").alias("parts"))
    blocks = lambda n: F.ceil(n / BLOCK)
    mixed = scratch.keep(sizes.where("parts > 1").select(*key, "bulk", "_rl_n", blocks(F.col("_rl_n") - F.col("most")).alias("others"), blocks(F.col("most")).alias("alike")), "mixed")
    rows = with_groups(named, mixed, key).withColumn("in_bulk", F.col("part") == F.col("bulk"))
    # Block pair (x, y), x <= y, blocks of the others first: these go to (m, m..) and to (0..m, m), the rest to (0..others, m).
    spread = F.xxhash64("node")
    mine = F.when(F.col("in_bulk"), F.col("others") + F.pmod(spread, F.col("alike"))).otherwise(F.pmod(spread, F.col("others")))
    upto = F.col("others") + F.when(F.col("in_bulk"), F.lit(0)).otherwise(F.col("alike"))
    both = F.transform(F.sequence(F.lit(0).cast("long"), upto - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("x"), F.greatest(o, F.col("mine")).alias("y")))
    carried = ["mine", "node", "part", "slots"]
    if sets is not None:
        rows = scratch.keep(rows, "rows")
        rows, carried = rows.join(sets(rows.select("node").distinct()), "node"), [*carried, "shingles"]
    dealt = rows.withColumn("mine", mine).withColumn("to", F.explode(both)).select(*key, "to.x", "to.y", *carried)
    group = [*key, "x", "y"]
    return dealt.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(lambda batches: apart_links(batches, similarity, exact), "a long, b long").distinct()


def _sets(nodes: DataFrame, docs: DataFrame, texts: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(node, shingles): the sorted hashes of these texts' distinct shingles."""
    ends = scratch.keep(nodes.join(texts.select("node", "copy", "first"), "node"), "ends")
    rows = columns(docs, doc_id="long", text="string")
    first = ends.select(F.col("first").alias("_rl_first")).distinct()

    def spell(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                made = [_words(t) for t in utf8(batch.slice(at, 128).column(1))]
                yield pa.record_batch([pa.array([_copy(t) for t in made], pa.binary()), pa.array([np.unique(shingles(t, shingle)).tobytes() for t in made], pa.binary())], ["copy", "shingles"])

    # A text's first row has it, among rows of the same id.
    spelled = rows.join(first, rows["doc_id"].eqNullSafe(first["_rl_first"]), "left_semi").mapInArrow(spell, "copy binary, shingles binary")
    return scratch.keep(ends.join(spelled.dropDuplicates(["copy"]), "copy").select("node", "shingles"), "shingles")


def _exact(pairs: DataFrame, docs: DataFrame, texts: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The (a, b) of pairs whose texts' shingle sets have a Jaccard similarity of at least `similarity`."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, texts, shingle, scratch)

    def decide(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            on = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                on.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.record_batch([b.column("a").filter(pa.array(on, pa.bool_())), b.column("b").filter(pa.array(on, pa.bool_()))], ["a", "b"])

    met = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return met.mapInArrow(decide, "a long, b long")


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(doc_id, copy, component): component names the near-duplicate group."""
    near_enough = similarity - MARGIN
    with Scratch() as scratch:
        made = scratch.keep(sketches(docs, shingle), "sketches")
        texts = made.groupBy("copy").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("slots").alias("slots"))
        texts = scratch.keep(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
        # Fingerprints that several texts have, then these texts' minimum hashes.
        keys = texts.select(F.posexplode("bands").alias("band", "key"), "node")
        shared = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key", "n", F.col("n").alias("_rl_n"))
        meeting = with_groups(keys, scratch.keep(shared, "shared"), ["band", "key"]).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / SPLIT))).drop("n")
        met = scratch.keep(meeting.join(texts.select("node", "first", "slots"), "node"), "meeting")
        with Scratch() as first:
            by_sketch = _led(met, near_enough, first)
            # Links of the whole texts' fingerprints, and from each fingerprint's first text to its others.
            prints = first.keep(texts.groupBy("fp").agg(F.min("node").alias("node")), "prints")
            ends = fingerprint_links(prints.select("fp"), radius)
            named = ends.join(prints.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
            alike = with_least(texts.select("fp", F.col("node").alias("x")), "fp", "x", "y", first).where("x <> y").select("x", "y")
            pairs = named.select("x", "y").unionByName(alike)
            # A fingerprint can agree by chance where texts are short: these pairs must be similar too.
            slots = texts.select("node", "slots")
            close = pairs.join(slots.toDF("x", "sx"), "x").join(slots.toDF("y", "sy"), "y").mapInArrow(_agreeing(near_enough), "a long, b long")
            near = first.keep(by_sketch.unionByName(close).distinct(), "candidates")
            links = scratch.keep(_exact(near, docs, texts, shingle, similarity, first), "links")
        with Scratch() as second:
            parts = second.keep(connected_components(links), "parts")
            sets = lambda nodes: _sets(nodes, docs, texts, shingle, second)
            apart = scratch.keep(_apart(met, parts, near_enough, second, sets, similarity), "links")
        parts = connected_components(links.unionByName(apart))
        component = texts.join(parts, "node", "left").select("copy", F.coalesce("component", "node").alias("component"), "first")
        return materialise(made.select("doc_id", "copy").join(component, "copy"), "near")[0]


def _agreeing(similarity: float):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sx", "sy"))
            on = pa.array((x == y).mean(1) >= similarity)
            yield pa.record_batch([b.column("x").filter(on), b.column("y").filter(on)], ["a", "b"])

    return run


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id, with all its columns."""
    found = groups(docs, shingle, similarity)
    with Scratch() as scratch:
        best = with_least(found, "component", "doc_id", "best", scratch)
        # Ids that go. A group without ids has no smallest: its null ids stay.
        gone = materialise(best.where(~F.col("doc_id").eqNullSafe(F.col("best"))).select(F.col("doc_id").alias("_rl_id")).distinct(), "gone")[0]
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_rl_id"]), "left_anti")
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_rl_id"))
    if not twice.limit(1).count():
        return kept
    # Repeated rows: one of each stays. Only ids that occur more than once are ranked.
    again = kept.join(twice, kept["doc_id"].eqNullSafe(twice["_rl_id"]), "left_semi")
    once = kept.join(twice, kept["doc_id"].eqNullSafe(twice["_rl_id"]), "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text"))
    return once.unionByName(again.withColumn("_rl_rank", rank).where("_rl_rank = 1").drop("_rl_rank"))
