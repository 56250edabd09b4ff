"""Removal of byte strings that already start in an earlier document, by deep-shallow suffix sorting.

Equal whole texts are one text from the start: all but the smallest id of each are removed outright and take no part in
what follows. Each string of `length` bytes has a key: the smallest hash of the GRAM-byte strings in it. Equal strings
have equal keys, and neighbouring ones mostly share one, so a document is a row of runs of strings with one key. Blocks
of documents first exchange keys only (some three bytes each). Runs whose key another document has are sorted within
their block, and each distinct one is sent once, with its bytes, to the key's bucket. There the runs are sorted, and the
single strings of runs that share a key but differ; each class of equal ones takes its smallest id. Both sorts, in the
block and in the bucket, are deep-shallow, and what they find equal is all that is removed. Verdicts go back to the
blocks. The texts are shuffled once, by block.

The numbers of blocks and buckets follow the bytes of text. A key that very many blocks have does not gather in one
bucket: its strings are sent one by one, by their own bytes. No step samples or caps.

Nulls and edges: a null text is empty; shorter texts than `length` are kept whole; a null id counts as the largest id,
2^63 - 1; rows with equal ids do not remove from each other; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import hashlib
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import Scratch, materialise, release, with_groups
from rasterloom.llm.deepshallow import classes, words
from rasterloom.session import ship

GRAM = 24
#: Bytes of text in a block and for a bucket, about; blocks that share a key before its strings are spread; bytes hashed at once.
BLOCK_BYTES, BUCKET_BYTES, SPREAD, CHUNK = 4 << 20, 8 << 20, 1 << 15, 1 << 20
LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n first GRAM-byte strings."""
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(8, GRAM, 8):
        h = _mix(h + w[at : at + n])
    return h


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, strings, key) of each run of strings with one key."""
    starts, counts, keys = [], [], []
    total = len(data) - length + 1
    for lo in range(0, max(0, total), CHUNK):
        part = data[lo : lo + CHUNK + length - 1]
        low = _grams(words(part), len(part) - GRAM + 1)
        wide, width = length - GRAM + 1, 1
        while width * 2 <= wide:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if wide > width:
            low = np.minimum(low[: -(wide - width)], low[wide - width :])
        first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        starts.append(lo + first)
        counts.append(np.diff(np.append(first, len(low))))
        keys.append(low[first])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys)


def _code(keys: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 bits more of a key."""
    x = _mix(keys)
    return ((x & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32) | x >> np.uint64(32)).astype(np.int64)


def _documents(table) -> tuple[list[tuple[int, bytes]], list[int], list[tuple[int, int]]]:
    """A block's documents in an order that does not depend on how they came, the rows they stand in, and (row, bytes) of the copies.

    Rows with a mark are no documents: they name, by id and SHA-256, the copies of an earlier text.
    """
    from rasterloom.llm.common import utf8

    ids = [LAST if i is None else i for i in table.column("doc_id").to_pylist()]
    texts = [t for c in table.column("text").chunks for t in utf8(c)]
    marks = table.column("mark").to_pylist()
    copies_of: dict[int, set[bytes]] = {}
    for i, mark in zip(ids, marks):
        if mark is not None:
            copies_of.setdefault(i, set()).add(mark)
    rows = [r for r, mark in enumerate(marks) if mark is None]
    copies = [r for r in rows if ids[r] in copies_of and hashlib.sha256(texts[r]).digest() in copies_of[ids[r]]]
    order = sorted(set(rows).difference(copies), key=lambda r: (ids[r], texts[r]))
    return [(ids[r], texts[r]) for r in order], order, [(r, len(texts[r])) for r in copies]


def _pack(*parts) -> bytes:
    """Arrays (as differences, byte by byte, which compress well) and bytes, compressed."""
    import zstandard

    raw = []
    for p in parts:
        if not isinstance(p, bytes):
            p = np.diff(p, prepend=p.dtype.type(0)).view(np.uint8).reshape(-1, p.dtype.itemsize).T.tobytes()
        raw.append(p)
    head = np.array([len(r) for r in raw], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(len(raw).to_bytes(8, "little") + head + b"".join(raw))


def _unpack(data: bytes, *kinds) -> list:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    at, out = 8 + 8 * n, []
    for size, kind in zip(np.frombuffer(raw, np.int64, n, 8).tolist(), kinds):
        part = raw[at : at + size]
        if kind is not bytes:
            width = np.dtype(kind).itemsize
            part = np.cumsum(np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(width, -1).T).view(kind).ravel(), dtype=kind)
        out.append(part)
        at += size
    return out


def _codes(buckets: list[int], rests: list[bytes], which: int) -> np.ndarray:
    """Ascending codes of keys that came by bucket; which: of the two arrays that a reply holds."""
    parts = [_unpack(r, np.uint32, np.uint32)[which].astype(np.int64) | b << 32 for b, r in zip(buckets, rests)]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def block_keys(docs: list[tuple[int, bytes]], length: int, buckets: int) -> np.ndarray:
    """The distinct codes of a block's keys, ascending, so by bucket."""
    own = [np.unique(_code(runs(np.frombuffer(t, np.uint8), length)[2], buckets)) for _, t in docs if len(t) >= length]
    return np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)


def shared_keys(blocks: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's keys by block: (block, rest, spread) of those that several blocks have."""
    order = np.argsort(rests, kind="stable")
    rests, blocks = rests[order], blocks[order]
    _, group, counts = np.unique(rests, return_inverse=True, return_counts=True)
    n = counts[group]
    return blocks[n > 1], rests[n > 1], n[n > 1] > SPREAD


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., n numbers for each."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _equal(data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number for each run, the same for equal runs: sorted by key and size, then deep-shallow."""
    order = np.lexsort((size, key))
    k, n = key[order], size[order]
    start = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])[: len(k)]
    item, cls = classes(data, begin[order], n, np.cumsum(start) - 1)
    kind = -1 - np.arange(len(key))  # a run without an equal is a kind of its own
    kind[order[item]] = cls
    return np.unique(kind, return_inverse=True)[1]


def block_runs(docs: list[tuple[int, bytes]], length: int, buckets: int, known: np.ndarray, spread: np.ndarray):
    """What a block sends: ({bucket: (doc, strings, instances, index, start, bytes)}, [(index, start, stop), ...] removed already).

    doc, strings, instances: of each distinct run, the smallest id that has it, how many strings it holds and how often
    the documents of this id have it; index, start: where. known, spread: codes of the keys that other blocks have too,
    and of those whose strings are sent one by one.
    """
    found, keys = [], []
    for _, text in docs:
        start, count, key = runs(np.frombuffer(text, np.uint8), length)
        code = _code(key, buckets)
        found.append((start, count, code))
        keys.append(np.unique(code))
    everywhere, times = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    within = everywhere[times > 1]
    data, base, parts = np.frombuffer(b"".join(t for _, t in docs), np.uint8), 0, []
    for index, (_, text) in enumerate(docs):
        start, count, code = found[index]
        one = _in(code, spread)
        on = one | _in(code, known) | _in(code, within)
        start, count, code, one = start[on], count[on], code[on], one[on]
        n = np.where(one, count, 1)  # a spread run is as many runs of one string
        start, code, one = _ranges(start, n), np.repeat(code, n), np.repeat(one, n)
        parts.append((np.full(len(start), index), start, np.where(one, 1, np.repeat(count, n)), code, one, start + base))
        base += len(text)
    if not parts:
        return {}, np.zeros((0, 3), np.int64)
    index, start, count, code, one, begin = (np.concatenate(x) for x in zip(*parts))
    if not len(index):
        return {}, np.zeros((0, 3), np.int64)
    doc = np.array([d for d, _ in docs], np.int64)[index]
    kind = _equal(data, begin, count + length - 1, code)
    least = np.full(kind.max() + 1, LAST, np.int64)
    np.minimum.at(least, kind, doc)
    late = doc > least[kind]
    gone = np.stack([index, start, start + count + length - 1], 1)[late]
    out: dict[int, tuple] = {}
    order = np.flatnonzero(~late)
    order = order[np.argsort(kind[order], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], kind[order][1:] != kind[order][:-1]])[: len(order)])
    times = np.diff(np.append(first, len(order)))
    lead = order[first]
    where = code[lead] >> 32
    for i in np.flatnonzero(one[lead]).tolist():
        string = data[begin[lead[i]] : begin[lead[i]] + length].tobytes()
        where[i] = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little") % buckets
    # Bucket by bucket, each distinct run in the order of the texts.
    by = np.lexsort((begin[lead], where))
    bound = np.flatnonzero(np.concatenate([[True], where[by][1:] != where[by][:-1]])[: len(by)])
    for mine in np.split(by, bound[1:]):
        each = order[_ranges(first[mine], times[mine])]
        joined = data[_ranges(begin[lead[mine]], count[lead[mine]] + length - 1)].tobytes()
        out[int(where[mine[0]])] = (doc[lead[mine]], count[lead[mine]].astype(np.int32), times[mine].astype(np.int32), index[each].astype(np.int32), start[each].astype(np.int32), joined)
    return out, gone


def _run_keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The key of each run: the smallest hash in it; some CHUNK bytes of runs at once."""
    out = []
    for mine in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin // CHUNK)) + 1):
        part, at = data[begin[mine[0]] : begin[mine[-1]] + size[mine[-1]]], begin[mine] - begin[mine[0]]
        low = np.append(_grams(words(part), len(part) - GRAM + 1), np.full(GRAM, np.iinfo(np.uint64).max))
        out.append(np.minimum.reduceat(low, np.stack([at, at + size[mine] - GRAM + 1], 1).ravel())[::2])
    return np.concatenate(out)


def verdicts(doc: np.ndarray, count: np.ndarray, joined: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, strings): what is removed of each run that meets others in one bucket, as stretches of its strings.

    doc, count: each run's id and number of strings; joined: their bytes. Equal runs and strings share a key, so keys are
    judged some at a time, about CHUNK bytes of runs, all runs of a key together: a bucket's memory follows its runs.
    """
    data, size = np.frombuffer(joined, np.uint8), count.astype(np.int64) + length - 1
    begin = np.cumsum(size) - size
    key = _run_keys(data, begin, size)
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    before = (np.cumsum(size[order]) - size[order])[head]
    made = []
    for mine in np.split(order, head[np.flatnonzero(np.diff(before // CHUNK)) + 1]):
        mine = np.sort(mine)
        run, first, strings = _judged(doc[mine], count[mine], key[mine], data[_ranges(begin[mine], size[mine])], length)
        made.append((mine[run], first, strings))
    run, first, strings = (np.concatenate(x) for x in zip(*made))
    by = np.argsort(run, kind="stable")
    return run[by], first[by], strings[by]


def _judged(doc: np.ndarray, count: np.ndarray, key: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """verdicts() on runs with these keys and bytes."""
    size = count.astype(np.int64) + length - 1
    begin = np.cumsum(size) - size
    kind = _equal(data, begin, size, key)
    least = np.full(kind.max() + 1, LAST, np.int64)
    np.minimum.at(least, kind, doc)
    # One run of each kind stands for it. Runs of different bytes can share strings only if they share the key.
    lead = np.unique(kind, return_index=True)[1]
    lead = lead[np.argsort(key[lead], kind="stable")]
    group = np.cumsum(np.concatenate([[True], key[lead][1:] != key[lead][:-1]])) - 1
    mixed = np.bincount(group)[group] > 1
    n = count[lead].astype(np.int64)
    offset = np.zeros(len(least), np.int64)
    offset[kind[lead]] = np.cumsum(n) - n
    # The smallest id of each string: its run's, or less where another run has it.
    smallest = np.repeat(least[kind[lead]], n)
    some = np.flatnonzero(np.repeat(mixed, n))
    if len(some):
        root = _roots(data, begin[lead], n, length)
        own = some[root[some] == some]
        item, cls = classes(data, _ranges(begin[lead], n)[own], length, np.repeat(group, n)[own])
        if len(item):
            best = np.full(cls.max() + 1, LAST, np.int64)
            np.minimum.at(best, cls, smallest[own[item]])
            smallest[own[item]] = best[cls]
            smallest[some] = smallest[root[some]]
    out = []
    for mine in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(begin // (CHUNK // 4))) + 1):
        who, step = np.repeat(mine, count[mine]), _ranges(np.zeros(len(mine), np.int64), count[mine])
        hit = smallest[offset[kind[who]] + step] < doc[who]
        edge = np.concatenate([[True], (who[1:] != who[:-1]) | (hit[1:] != hit[:-1])])[: len(who)]
        lo = np.flatnonzero(edge)
        hi = np.append(lo[1:], len(who))
        lo, hi = lo[hit[lo]], hi[hit[lo]]
        out.append((who[lo], step[lo], hi - lo))
    return tuple(np.concatenate(x) for x in zip(*out))


def _roots(data: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """For each string of the runs (begin, n strings), counted through: the first one known to equal it in its run, or itself.

    A long run has the GRAM bytes of its key again and again, so most of its strings repeat after the same few bytes.
    """
    root = np.arange(n.sum())
    offset = np.cumsum(n) - n
    for i in np.flatnonzero(n > 2 * length).tolist():
        text = data[begin[i] : begin[i] + n[i] + length - 1]
        raw, middle = text.tobytes(), len(text) // 2
        step = raw.find(raw[middle : middle + GRAM], middle + 1) - middle
        if not 0 < step < n[i]:
            continue
        bad = np.append(np.flatnonzero(text[step:] != text[:-step]), len(text) - step)
        place = np.arange(n[i] - step)
        again = np.flatnonzero(bad[np.searchsorted(bad, place)] - place >= length)  # the string a step on is equal
        mine = np.arange(n[i])
        mine[again + step] = again
        while (further := mine[mine]).tobytes() != mine.tobytes():
            mine = further
        root[offset[i] : offset[i] + n[i]] = offset[i] + mine
    return root


def union(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals."""
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), stop.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", rest: Column | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed runs of each document, and its other bytes joined.

    rest: a value of each row that comes through unchanged, as the column rest; kept is then text, without broken characters.
    """
    import pyarrow as pa

    if length < GRAM:
        raise ValueError(f"strings of {GRAM} bytes at least")
    ship(docs.sparkSession)
    text, carried = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), rest is not None
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *([rest.alias("rest")] if carried else []))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    # Null ids are spread by their texts.
    rows = rows.withColumn("block", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks)).cast("int"))
    marks = rows.withColumn("mark", F.lit(None).cast("binary")).unionByName(_copies(rows, length), allowMissingColumns=True)
    by_block = marks.groupBy("block")

    def offer(key, t):
        release()
        codes = block_keys(_documents(t)[0], length, buckets)
        cut = np.flatnonzero(np.diff(codes >> 32)) + 1
        parts = [c for c in np.split(codes, cut) if len(c)]
        return pa.table([pa.array([int(c[0] >> 32) for c in parts], pa.int32()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array([_pack(c.astype(np.uint32)) for c in parts], pa.binary())], ["bucket", "block", "rests"])

    def answer(key, t):
        rests = [_unpack(r, np.uint32)[0] for r in t.column("rests").to_pylist()]
        block, rest, spread = shared_keys(np.repeat(t.column("block").to_numpy(), [len(r) for r in rests]), np.concatenate(rests))
        order = np.lexsort((rest, block))
        block, rest, spread = block[order], rest[order], spread[order]
        cut = np.flatnonzero(np.diff(block)) + 1
        out = [(int(b[0]), key[0].as_py(), _pack(r[~s], r[s])) for b, r, s in zip(np.split(block, cut), np.split(rest, cut), np.split(spread, cut)) if len(b)]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["block", "bucket", "known"])

    sent_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("gone", pa.bool_()), ("data", pa.binary())])

    def send(key, t, replies):
        release()
        docs, _, _ = _documents(t)
        known, spread = (_codes(replies.column("bucket").to_pylist(), replies.column("known").to_pylist(), i) for i in (0, 1))
        out, gone = block_runs(docs, length, buckets, known, spread)
        me = key[0].as_py()
        made = [(bucket, me, False, _pack(*found)) for bucket, found in out.items()]
        if len(gone):
            made.append((me % buckets, me, True, _pack(*(np.ascontiguousarray(c).astype(np.int32) for c in gone.T))))
        cols = list(zip(*made)) or [[], [], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, sent_schema)], schema=sent_schema)

    def judge(key, t):
        release()
        flags, sources, data = (t.column(c).to_pylist() for c in ("gone", "block", "data"))
        made = [(b, d) for g, b, d in zip(flags, sources, data) if g]
        parts = [(b, *_unpack(d, np.int64, np.int32, np.int32, np.int32, np.int32, bytes)) for g, b, d in zip(flags, sources, data) if not g]
        if parts:
            sources, doc, count, times, index, start, joined = zip(*parts)
            run, first, strings = verdicts(np.concatenate(doc), np.concatenate(count), b"".join(joined), length)
            upto = np.cumsum([0, *(len(d) for d in doc)])
            for i, b in enumerate(sources):
                lo, hi = np.searchsorted(run, upto[i : i + 2])
                mine = run[lo:hi] - upto[i]
                # A run's verdict holds wherever its document has it.
                n, at = times[i][mine], (np.cumsum(times[i]) - times[i])[mine]
                each = _ranges(at, n)
                begin = start[i][each] + np.repeat(first[lo:hi], n).astype(np.int32)
                if len(each):
                    made.append((b, _pack(index[i][each], begin, begin + np.repeat(strings[lo:hi], n).astype(np.int32) + np.int32(length - 1))))
        cols = list(zip(*made)) or [[], []]
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], ["block", "data"])

    kept_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])

    def apply(key, t, replies):
        release()
        docs, order, copies = _documents(t)
        parts = [_unpack(d, np.int32, np.int32, np.int32) for d in replies.column("data").to_pylist()]
        index, start, stop = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 3
        by = np.argsort(index, kind="stable")
        index, start, stop = index[by], start[by], stop[by]
        out = []
        for i, (_, text) in enumerate(docs):
            lo, hi = np.searchsorted(index, [i, i + 1])
            spans = union(start[lo:hi], stop[lo:hi])
            ends = [0, *(x for span in spans for x in span), len(text)]
            out.append((len(text), [{"start": a, "stop": b} for a, b in spans], b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))))
        out += [(n, [{"start": 0, "stop": n}], b"") for _, n in copies]
        rows = pa.array([*order, *(r for r, _ in copies)], pa.int64())
        cols = list(zip(*out)) or [[], [], []]
        made = [t.column("doc_id").take(rows), *(pa.array(c, f.type) for c, f in zip(cols[:2], list(kept_schema)[1:3]))]
        if not carried:
            return pa.table([*made, pa.array(cols[2], pa.binary())], schema=kept_schema)
        return pa.table([*made, pa.array([k.decode(errors="ignore") for k in cols[2]], pa.string()), t.column("rest").take(rows)], [*kept_schema.names, "rest"])

    result = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))).add("kept", "binary" if rest is None else "string")
    if rest is not None:
        result = result.add("rest", rows.schema["rest"].dataType)
    offered = by_block.applyInArrow(offer, "bucket int, block int, rests binary")
    answered = offered.groupBy("bucket").applyInArrow(answer, "block int, bucket int, known binary")
    sent = by_block.cogroup(answered.groupBy("block")).applyInArrow(send, "bucket int, block int, gone boolean, data binary")
    judged = sent.groupBy("bucket").applyInArrow(judge, "block int, data binary")
    return by_block.cogroup(judged.groupBy("block")).applyInArrow(apply, result)


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, block, mark): ids and SHA-256 of the texts that a smaller id has too, of at least `length` bytes."""
    with Scratch() as scratch:
        sums = rows.where(F.octet_length("text") >= length).select("doc_id", "block", F.unhex(F.sha2("text", 256)).alias("mark"))
        sums = scratch.keep(sums, "sums")
        firsts = sums.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("_rl_n")).where("_rl_n > 1")
        late = F.coalesce(F.col("doc_id"), F.lit(LAST)) > F.col("first")
        found = with_groups(sums, scratch.keep(firsts, "firsts"), ["mark"]).where(late).select("doc_id", "block", "mark").distinct()
        return materialise(found, "copies")[0]


def cut_texts(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns, its texts less the repeated passages; what a cut leaves of a character goes too.

    A null text stays null. A column n_chars, where there is one, is counted anew.
    """
    rest = F.struct(F.col(f"`{text_col}`").isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])
    found = remove_repeats(docs, length, id_col, text_col, rest)
    text = F.when(~F.col("rest.none"), F.col("kept"))
    out = {c: text if c == text_col else F.col(f"rest.c{i}") for i, c in enumerate(docs.columns)}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[x.alias(c) for c, x in out.items()])
