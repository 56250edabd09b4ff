"""Language-model scores of whole texts: a causal self-attention model on subword ids, and a word unigram base.

Two passes over the texts: one counts the training documents' words, one cuts all texts into subword ids, which are kept
in the shared folder, and adds up the base. What follows reads ids only.

Each id has a slot (the frequent ones alone, the others some to a slot by their number); how often each slot follows each
in training documents is counted in full. Slots with like neighbours make a class. A subword's probability is
P(class | all that stood before) * P(slot | class, slot before) * P(id | slot). The last two are smoothed counts. The
first is the attention model's: what the counts say of the classes after this slot is its prior, and the network learns
what the rest of the window adds. So a text's score is the log of a proper probability of its subwords and an end, and
all that goes into it is learned from all training documents.

The network is trained on the windows of all training documents, once. A pass over a sample of them gives the start;
then parallel trainers, one for each TRAINER_TOKENS of training text, go on from there and their weights are averaged. A
document's last window is padded, its padding (class -1) left out of the loss, so each of its subwords and its end are
learned. A trainer streams past its windows in hash order, so its memory does not depend on their number. Neither the
weights nor the scores depend on the session's number of shuffle partitions.

Texts are scored in windows that overlap, each token once, where it has the most context.

Words of at least 1/MOST of all training tokens (so MOST of them at most) are looked up in each task; the others are
joined by word.

Nulls and edges: a null text is empty and consists of its end; a null id is a training document; repeated rows count as
often as they occur; without training documents every word is unknown and the base's logs are of 1; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import attention
from rasterloom.llm.common import columns, hold, materialise, release, utf8

MOST = 500_000
#: Training documents of the first pass (about, in all), where the trainers start from; they see all documents.
PILOT, BATCH = 1500, 64
TRAINER_TOKENS = 1 << 21
OVERLAP = 12
GROUP = 2 << 20  # bytes of texts that are cut at once
END = b""  # the end's place among words: no word is empty


def held_out(doc) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def _groups(column) -> Iterator[tuple[int, int]]:
    """(first, end) of groups of texts of about GROUP bytes."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GROUP, "right")))
        yield lo, hi
        lo = hi


def _words(texts: list[bytes]):
    """(each word's text, its kind, the kinds: an Arrow array) of UTF-8 texts; each kind is there once.

    The array is made anew: of a slice of one, Arrow's functions on strings give other places.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    kinds = split.flatten().dictionary_encode()
    codes, who = kinds.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
    kinds = kinds.dictionary.cast(pa.large_binary()).cast(pa.binary())
    # Blanks at a text's ends leave an empty piece, which is no word.
    if (empty := kinds.index(pa.scalar(END, pa.binary())).as_py()) >= 0:
        there = codes != empty
        codes, who = codes[there], who[there]
    return who, codes, kinds


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the training documents, ends included; summed in each task before the shuffle."""

    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def total(tables: list):
            return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        held, n = [], 0
        for b in batches:
            for lo, hi in _groups(b.column(1)):
                part = b.slice(lo, hi - lo)
                learned = np.array([not held_out(d) for d in part.column(0).to_pylist()], bool)
                who, codes, kinds = _words([t.lower() for t in utf8(part.column(1))])
                c = np.bincount(codes[learned[who]], minlength=len(kinds))
                some = np.flatnonzero(c)
                held.append(pa.table({"word": kinds.take(pa.array(some)), "c": pa.array(c[some], pa.int64())}))
                held.append(pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([int(learned.sum())], pa.int64())}))
                n += len(some)
                if n > 1_000_000:
                    held = [total(held)]
                    n = held[0].num_rows
                    if n > 500_000:
                        yield from held[0].combine_chunks().to_batches()
                        held, n = [], 0
        if held:
            yield from total(held).combine_chunks().to_batches()

    return rows.mapInArrow(count, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Each id's slot and log share of it, each slot's class, and what the counts say of the slot that follows.

    counts: of all ids and the end (the last id). follows: [slots + 1, slots] counts of slots after slots; the last row is
    of a text's beginning, whose slot is `begin`. Without it, slots are expected by their own counts.

    Tasks get the counts, compressed, in place of `step`, which they make again: Spark keeps what a function brings along
    as files on the driver and on each executor.
    """

    def __init__(self, counts: np.ndarray, shape: attention.Shape, follows: np.ndarray | None = None):
        order = np.lexsort((np.arange(len(counts)), -counts))
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        own, self.begin = shape.slots * 3 // 4, shape.slots
        self.slot = np.where(rank < own, rank, own + np.arange(len(counts)) % (shape.slots - own)).astype(np.int16)
        mass = counts + 0.5
        by_slot = np.bincount(self.slot, mass, shape.slots)
        self.within = np.log(mass / np.maximum(by_slot[self.slot], 1e-9))
        self.share = (by_slot + 1e-3) / (by_slot + 1e-3).sum()
        follows = np.zeros((shape.slots + 1, shape.slots)) if follows is None else np.asarray(follows, np.float64)
        self.cls = _alike(follows, self.share, shape.classes)
        after = self._after(follows)
        prior = np.stack([after[:, self.cls == c].sum(1) for c in range(shape.classes)], 1)
        self.prior = np.log(np.maximum(prior, 1e-30)).astype(np.float32)
        self._follows, self._step = _squeeze(follows), None

    def _after(self, follows: np.ndarray) -> np.ndarray:
        """P(slot | slot before), smoothed towards the slots' own shares: the more kinds follow, the more weight these have."""
        trust = np.maximum(0.5, 0.5 * (follows > 0).sum(1, keepdims=True))
        return (follows + trust * self.share) / (follows.sum(1, keepdims=True) + trust)

    @property
    def step(self) -> np.ndarray:
        """ln P(slot | its class, slot before)."""
        if self._step is None:
            follows = _spread(self._follows, len(self.share))
            self._step = np.empty(follows.shape, np.float32)
            for at in range(0, len(follows), 256):
                self._step[at : at + 256] = np.log(self._after(follows[at : at + 256])) - self.prior[at : at + 256][:, self.cls]
        return self._step

    @property
    def places(self) -> SimpleNamespace:
        """As much of it as _slots() needs."""
        return SimpleNamespace(begin=self.begin, slot=self.slot)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_step": None}


def _squeeze(table: np.ndarray) -> bytes:
    """A table of floats, byte by byte of them, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(table.view(np.uint8).reshape(-1, 8).T).tobytes())


def _spread(packed: bytes, wide: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.float64).reshape(-1, wide)


def _alike(follows: np.ndarray, share: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """A class for each slot, by what it follows and what follows it: k-means on a random projection, weighted by share."""
    rng = np.random.default_rng(6)
    square = np.sqrt(follows)
    around = np.concatenate([square.T, square[: follows.shape[1]]], 1)
    size = np.sqrt((around * around).sum(1, keepdims=True))
    place = (around / np.maximum(size, 1e-9)) @ rng.standard_normal((around.shape[1], 24))
    centre = place[np.argsort(-share, kind="stable")[:classes]].copy()
    cls = np.arange(len(share)) % classes
    for _ in range(rounds):
        far = (centre * centre).sum(1) - 2 * place @ centre.T
        cls = far.argmin(1)
        weight = np.bincount(cls, share, classes)
        for i in range(place.shape[1]):
            centre[:, i] = np.where(weight > 0, np.bincount(cls, share * place[:, i], classes) / np.maximum(weight, 1e-30), centre[:, i])
    return cls


def _slots(v: Vocabulary | SimpleNamespace, ids: np.ndarray) -> np.ndarray:
    """The slots of the beginning, of a text's ids and of its end."""
    return np.concatenate([[v.begin], v.slot[ids], v.slot[-1:]]).astype(np.int16)


def _pack_ids(ids: np.ndarray, squeeze) -> bytes:
    return squeeze(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes())


@cache
def _spreader():
    """This worker's; making one for each text takes longer than its text."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _ids(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_spreader()(packed), np.uint8).reshape(3, -1).astype(np.int64)
    planes[1] <<= 8
    planes[2] <<= 16
    planes[0] |= planes[1]
    planes[0] |= planes[2]
    return planes[0]


def _cut(rows: DataFrame, tokenizer: str, logs: dict[bytes, float]) -> DataFrame:
    """(rid, doc_id, held_out, n_tokens, known, base, n_subwords, ids, rare, times) of rows (rid, doc_id, text).

    known, base: over the words that logs has; rare, times: the others and how often they occur.
    """

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import zstandard

        from rasterloom.llm.subwords import encoder

        encode, get, squeeze = encoder(tokenizer).encode_flat, logs.get, zstandard.ZstdCompressor(level=1).compress
        end = get(END)
        for b in batches:
            for lo, hi in _groups(b.column(2)):
                part = b.slice(lo, hi - lo)
                texts = [t.lower() for t in utf8(part.column(2))]
                ids, n = encode(texts)
                stops = np.cumsum(n)
                packed = [_pack_ids(ids[i:j], squeeze) for i, j in zip((stops - n).tolist(), stops.tolist())]
                who, codes, kinds = _words(texts)
                log = np.array([get(w, np.nan) for w in kinds.to_numpy(zero_copy_only=False).tolist()], np.float64)
                common = ~np.isnan(log)
                told = common[codes]
                tokens = np.bincount(who, minlength=len(n)) + 1
                known, base = np.bincount(who[told], minlength=len(n)), np.bincount(who[told], log[codes[told]], len(n))
                # The other words, each once a text; the end is a word of each.
                rare, times = np.unique(who[~told] * np.int64(len(kinds)) + codes[~told], return_counts=True)
                of, word = (rare // max(1, len(kinds))), kinds.take(pa.array(rare % max(1, len(kinds))))
                if end is None:
                    of = np.append(of, np.arange(len(n)))
                    order = np.argsort(of, kind="stable")
                    of, times = of[order], np.append(times, np.ones(len(n), np.int64))[order]
                    word = pa.concat_arrays([word, pa.array([END] * len(n), pa.binary())]).take(pa.array(order))
                else:
                    known, base = known + 1, base + end
                at = pa.array(np.searchsorted(of, np.arange(len(n) + 1)), pa.int32())
                out = [pa.array([held_out(d) for d in part.column(1).to_pylist()], pa.bool_()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(n + 1, pa.int64()), pa.array(packed, pa.binary()), pa.ListArray.from_arrays(at, word), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))]
                yield pa.record_batch([part.column(0), part.column(1), *out], ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "n_subwords", "ids", "rare", "times"])

    return rows.mapInArrow(cut, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, n_subwords long, ids binary, rare array<binary>, times array<long>")


def _id_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the texts (ids), their ends (the last id) included."""

    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        total, held, n = np.zeros(size + 1, np.int64), [], 0
        for b in batches:
            for packed in b.column(0).to_pylist():
                held.append(_ids(packed))
                n += len(held[-1])
                total[size] += 1
                if n > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=size + 1)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size + 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "c"])

    out = np.zeros(size + 1)
    for r in texts.select("ids").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():  # no more than the tokenizer has
        out[r["id"]] = r["c"]
    return out


def _follows(texts: DataFrame, v: Vocabulary, shape: attention.Shape) -> np.ndarray:
    """[slots + 1, slots]: how often each slot follows each; summed in each task, a row of counts per slot shuffled."""
    import zstandard

    wide, v = shape.slots, v.places

    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        total, held, n = np.zeros((wide + 1) * wide, np.int64), [], 0

        def add():
            np.add.at(total, np.concatenate(held), 1)

        for b in batches:
            for packed in b.column(0).to_pylist():
                s = _slots(v, _ids(packed)).astype(np.int64)
                held.append(s[:-1] * wide + s[1:])
                n += len(s)
                if n > 2_000_000:
                    add()
                    held, n = [], 0
        if held:
            add()
        rows = total.reshape(wide + 1, wide)
        some = np.flatnonzero(rows.any(1))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for lo in range(0, len(some), 256):
            yield pa.record_batch([pa.array(some[lo : lo + 256], pa.int64()), pa.array([squeeze(rows[i].tobytes()) for i in some[lo : lo + 256]], pa.binary())], ["slot", "counts"])

    def add_up(key, t):
        import pyarrow as pa

        total = np.zeros(wide, np.int64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64)
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})

    out = np.zeros((wide + 1, wide))
    schema = "slot long, counts binary"
    for r in texts.select("ids").mapInArrow(count, schema).groupBy("slot").applyInArrow(add_up, schema).collect():  # no more than there are slots
        out[r["slot"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), np.int64)
    return out


def _windows(texts: DataFrame, v: Vocabulary, shape: attention.Shape, trainers: int) -> DataFrame:
    """(trainer, turn, slots): the windows of texts (doc_id, ids), dealt by hash; turn is a hash of 31 bits.

    A window's slots are the one before it and its own, -1 where it is padded.
    """
    v = v.places

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, out = b.slice(lo, 256), []
                for doc, packed in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    slots = _slots(v, _ids(packed))
                    slots = np.pad(slots, (0, -(len(slots) - 1) % shape.window), constant_values=-1)
                    for at in range(0, len(slots) - 1, shape.window):
                        name = f"{doc} {at}".encode()
                        out.append((zlib.crc32(name) % trainers, zlib.crc32(b"turn " + name) >> 1, slots[at : at + shape.window + 1].tobytes()))
                cols = list(zip(*out)) or [[], [], []]
                yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["trainer", "turn", "slots"])

    return texts.select("doc_id", "ids").mapInArrow(cut, "trainer int, turn int, slots binary")


def _train(windows: DataFrame, v: Vocabulary, shape: attention.Shape, start: np.ndarray, rate: float, trainers: int) -> tuple[np.ndarray, int]:
    """(the mean of the trainers' weights by their numbers of tokens, these in all); `start` without windows.

    A trainer passes its windows once, in the order of their hashes, while the rate falls to a tenth.
    """
    parts, schema = max(1, int(trainers**0.5)), "part int, n long, weights binary"
    prior, classes = v.prior, v.cls

    def fit(batches: Iterable) -> Iterator:
        import pyarrow as pa

        release()
        hold()
        adam, n, part, held = attention.Adam(shape, start, prior), 0, 0, []

        def learn(turn: int) -> int:
            both = np.frombuffer(b"".join(held), np.int16).reshape(-1, shape.window + 1).astype(np.int64)
            there = both[:, 1:] >= 0
            adam.step(np.maximum(both[:, :-1], 0), np.where(there, classes[both[:, 1:]], -1), rate * (1 - 0.9 * turn / (1 << 31)))
            held.clear()
            return int(there.sum())

        turn = 0
        for b in batches:
            for trainer, turn, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                part = trainer % parts
                held.append(s)
                if len(held) == BATCH:
                    n += learn(turn)
        if held:
            n += learn(turn)
        if n:
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([adam.flat.astype(np.float32).tobytes()], pa.binary())], ["part", "n", "weights"])

    def mean(key, t):
        import pyarrow as pa

        # In the order of what they hold, so that the sum does not depend on how they came.
        each = sorted(zip(t.column("n").to_pylist(), t.column("weights").to_pylist()))
        n = sum(x for x, _ in each)
        w = sum(x * np.frombuffer(b, np.float32).astype(np.float64) for x, b in each) / n
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    # A partition is a trainer's own; equal turns are put in order by what they hold.
    dealt = windows.repartitionById(trainers, F.col("trainer")).sortWithinPartitions("turn", "slots")
    got = dealt.mapInArrow(fit, schema).groupBy("part").applyInArrow(mean, schema).orderBy("part").collect()
    if not got:
        return start, 0
    n = sum(r["n"] for r in got)
    return (sum(r["n"] * np.frombuffer(r["weights"], np.float32).astype(np.float64) for r in got) / n).astype(np.float32), n


def learn(texts: DataFrame, v: Vocabulary, shape: attention.Shape, n_docs: int, n_subwords: int) -> tuple[np.ndarray, int]:
    """(weights, tokens they were learned from, the pilot's not counted again) of training texts (doc_id, ids)."""
    weights = attention.initial(shape, np.zeros(shape.classes))
    pilot = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1 << 30)) < int(min(1.0, PILOT / max(1, n_docs)) * (1 << 30)))
    weights, _ = _train(_windows(pilot, v, shape, 1), v, shape, weights, 0.01, 1)
    trainers = max(1, -(-n_subwords // TRAINER_TOKENS))
    return _train(_windows(texts, v, shape, trainers), v, shape, weights, 0.002, trainers)


def score_texts(w: dict, v: Vocabulary, shape: attention.Shape, texts: list[np.ndarray]) -> np.ndarray:
    """ln P of each text of a batch, given by its ids."""
    made = [_slots(v, x).astype(np.int64) for x in texts]
    sizes = np.array([len(s) - 1 for s in made])
    before, own = np.concatenate([s[:-1] for s in made]), np.concatenate([s[1:] for s in made])
    base = np.cumsum(sizes) - sizes
    stride = shape.window - OVERLAP
    n = 1 + np.maximum(0, -(-(sizes - shape.window) // stride))
    who = np.repeat(np.arange(len(sizes)), n)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (turn * stride)[:, None] + np.arange(shape.window)
    inside = at < sizes[who][:, None]
    # Each token counts once: in its first window, as all later ones have less before it.
    counts = inside & ((turn == 0)[:, None] | (np.arange(shape.window) >= OVERLAP))
    place = base[who][:, None] + np.where(inside, at, 0)
    cls, ids = v.cls[own], np.concatenate([np.append(x, len(v.slot) - 1) for x in texts])
    out = np.bincount(np.repeat(np.arange(len(sizes)), sizes), v.within[ids] + v.step[before, own], len(sizes))
    for lo in range(0, len(place), BATCH):
        p = place[lo : lo + BATCH]
        logs = attention.log_probabilities(w, before[p], cls[p], v.prior)
        out += np.bincount(who[lo : lo + BATCH], np.where(counts[lo : lo + BATCH], logs, 0).sum(1, dtype=np.float64), len(sizes))
    return out


def score(docs: DataFrame, tokenizer: str, shape: attention.Shape | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords); logs are to the base 10."""
    from tokenizers import Tokenizer

    shape, size = shape or attention.Shape(), Tokenizer.from_file(tokenizer).get_vocab_size()
    rows = columns(docs, **{id_col: "long", text_col: "string"}).toDF("doc_id", "text")
    counts, _ = materialise(word_counts(rows), "words")  # what the result reads stays until the application ends
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, kinds = whole["n"] or 0, whole["v"]
    floor = max(1, -(-total // MOST))
    logs = {bytes(r["word"]): float(np.log10((r["c"] + 1) / (total + kinds + 1))) for r in counts.where(F.col("c") >= floor).collect()}
    texts, _ = materialise(_cut(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text"), tokenizer, logs), "subwords")

    training = texts.where("NOT held_out")
    n_docs, n_subwords = training.agg(F.count("*"), F.sum("n_subwords")).first()
    subwords = _id_counts(training, size)
    v = Vocabulary(subwords, shape)
    v = Vocabulary(subwords, shape, _follows(training, v, shape))
    weights, _ = learn(training, v, shape, n_docs, n_subwords or 0)

    def judge(batches: Iterable) -> Iterator:
        import pyarrow as pa

        release()
        hold()
        w = attention.unflatten(shape, weights)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                made = score_texts(w, v, shape, [_ids(x) for x in part.column(1).to_pylist()]) / np.log(10)
                yield pa.record_batch([part.column(0), pa.array(made, pa.float64())], ["rid", "score"])

    judged = texts.select("rid", "ids").mapInArrow(judge, "rid long, score double")
    unknown = float(np.log10(1 / (total + kinds + 1)))
    each = texts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = each.join(counts.where(F.col("c") < floor), "word", "left")
    log = F.when(F.col("c").isNull(), F.lit(unknown)).otherwise(F.log10((F.col("c") + 1) / F.lit(float(total + kinds + 1))))
    more = found.groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(F.lit(0))).alias("known_more"), F.sum(F.col("times") * log).alias("base_more"))
    zero = F.lit(0)
    plain = texts.select("rid", "doc_id", "held_out", "n_tokens", "known", "base", "n_subwords").join(judged, "rid").join(more, "rid", "left")
    return plain.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_more", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), "score", "n_subwords")
