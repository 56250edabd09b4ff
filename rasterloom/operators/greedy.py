"""Greedy store selection: the one step of encoding that depends on its own past, so a kernel runs per movie.

Movies are independent. State within one: the shown screen, each bank's priorities and the frame's weights. A movie's
text is read frame by frame and its operations leave in batches, so a long movie takes no more memory than its text.
Encoder takes one movie; together() steps through many at once, one operation of each at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.layouts import HOLE, Layout, distances
from rasterloom.session import ship

PAGES = 32


def nonce(page, off, frame: int):
    """Fixed arithmetic for ties: spreads equal priorities over a frame."""
    return (page * 131 + off * 29 + frame * 17) % 256


class Encoder:
    """What a movie's screen shows, and each bank's priorities: [page, bank, 256]. extra: further offsets of one operation."""

    def __init__(self, mode: str, palette: int, extra: int = 2):
        self.distance, self.extra = distances(mode, palette), extra
        self.layout = self.distance.layout
        self.screen = np.zeros((PAGES, self.layout.banks, 256), np.int64)
        self.priority = np.zeros_like(self.screen)

    def error(self, target: np.ndarray) -> int:
        """How far the screen is from the target in all."""
        have, want = (self.layout.mask(self.layout.pack(x)) for x in (self.screen, target))
        return int(self.distance(np.broadcast_to(self.layout.byte, have.shape).ravel(), have.ravel(), want.ravel()).sum())

    def operations(self, target: np.ndarray, frame: int, bank: int = 0) -> Iterator[tuple[int, int, list[int]]]:
        """(page, content, four offsets) that bring a bank closer to the target, the most valuable cells first, until none is left.

        Up to `extra` more cells take the same content where that brings them closer; what error is left there goes back
        to the queue, behind all fresh cells. Such an error compares the target with itself after the store.
        """
        layout, byte = self.layout, self.layout.byte[bank]
        goal = layout.pack(target)
        want, have = layout.mask(goal)[:, bank], layout.mask(layout.pack(self.screen))[:, bank]
        weight = self.distance(np.tile(byte, PAGES), have.ravel(), want.ravel()).reshape(PAGES, 256).astype(np.int64)
        weight[:, HOLE] = 0
        screen, priority = self.screen[:, bank], self.priority[:, bank]
        priority[weight == 0] = 0
        priority += weight
        page, off = np.nonzero(priority)
        queue = list(zip([0] * len(page), (-priority[page, off]).tolist(), nonce(page, off, frame).tolist(), page.tolist(), off.tolist()))
        heapq.heapify(queue)
        errors: dict[tuple[int, int], np.ndarray] = {}
        while queue:
            _, _, _, p, o = heapq.heappop(queue)
            if not priority[p, o]:
                continue
            content = int(target[p, bank, o])
            priority[p, o] = weight[p, o] = 0
            screen[p, o] = content
            offsets = [o]
            if (p, content) not in errors:  # the same within a frame
                stored = layout.store(goal[p], np.full(layout.banks, content))[bank]
                errors[p, content] = self.distance(byte, stored, want[p]).astype(np.int64)
            error = errors[p, content]
            delta = np.where(HOLE, 0, error - weight[p])
            delta[o] = 0
            near = np.flatnonzero(delta < 0)
            for q in near[np.lexsort((near, nonce(p, near, frame), delta[near]))].tolist():
                if not priority[p, q]:
                    continue
                priority[p, q] = error[q]
                screen[p, q] = content
                if error[q]:
                    heapq.heappush(queue, (1, -int(error[q]), int(nonce(p, q, frame)), p, q))
                offsets.append(q)
                if len(offsets) > self.extra:
                    break
            yield p + PAGES, content, offsets + [o] * (4 - len(offsets))


def frames(layout: Layout, text: str) -> Iterator[np.ndarray]:
    """The frames of a movie's text, each [page, bank, 256]."""
    size = 240 * PAGES * layout.banks
    for at in range(0, len(text), size):
        pages = layout.pages(text[at : at + size])
        yield np.concatenate([pages, np.zeros((PAGES - len(pages), *pages.shape[1:]), pages.dtype)])


def budgeted(encoder: Encoder, targets: Iterable[np.ndarray], ops_per_frame: int, first: int = 0) -> Iterator[tuple]:
    """(frame, bank, page, content, offsets), at most so many a frame, the banks in turn with equal shares."""
    banks = encoder.layout.banks
    for frame, target in enumerate(targets, first):
        for bank in range(banks):
            share = ops_per_frame * (bank + 1) // banks - ops_per_frame * bank // banks
            for _, op in zip(range(share), encoder.operations(target, frame, bank)):
                yield (frame, bank, *op)


#: Pages of the movies that are encoded side by side.
TOGETHER = 3072


class Errors:
    """What storing a content instead of its own would cost a cell, by (content, byte, wanted masked value); filled as needed."""

    def __init__(self, mode: str, palette: int):
        self.distance = distances(mode, palette)
        self.layout = self.distance.layout
        self.size = len(self.layout.phases) << self.layout.bits
        self.known = np.zeros((256, self.size), np.int32)
        self.places, self.contents = np.zeros(self.size, bool), np.zeros(256, bool)
        #: How far a blank screen is from each place.
        place = np.arange(self.size)
        self.blank = self.distance(place >> self.layout.bits, np.zeros_like(place), place & ((1 << self.layout.bits) - 1)).astype(np.int64)

    def place(self, byte: np.ndarray, want: np.ndarray) -> np.ndarray:
        return (byte << self.layout.bits) + want

    def learn(self, places: np.ndarray, contents: np.ndarray) -> None:
        """Measures every one of the contents at every one of the places, as far as that is new."""
        place, content = np.zeros_like(self.places), np.zeros_like(self.contents)
        place[places], content[contents] = True, True
        content |= self.contents
        self._fill(np.flatnonzero(place & ~self.places), np.flatnonzero(content))
        self._fill(np.flatnonzero(self.places), np.flatnonzero(content & ~self.contents))
        self.places |= place
        self.contents = content

    def _fill(self, places: np.ndarray, contents: np.ndarray) -> None:
        for at in range(0, len(places) if len(contents) else 0, 256):
            place, content = np.repeat(places[at : at + 256], len(contents)), np.tile(contents, len(places[at : at + 256]))
            byte, want = place >> self.layout.bits, place & ((1 << self.layout.bits) - 1)
            if self.layout.banks == 2:
                stored = (want & ~(127 << 3)) | (content & 127) << 3
            else:  # the palette bit comes first in the odd byte
                stored = (want & ~(255 << 3)) | np.where(byte == 0, content, ((content & 127) << 1) + (content >> 7)) << 3
            self.known[content, place] = self.distance(byte, want, stored) << 16

    def __call__(self, places: np.ndarray, contents: np.ndarray) -> np.ndarray:
        """65536 times the errors of a content for each row of places; both must be learned."""
        return self.known.take(places + (contents * self.size)[:, None], mode="clip")  # all are within the table: no check of bounds


_ERRORS: dict[tuple[str, int], Errors] = {}


def together(texts: list[str], ops_per_frame: int, palette: int = 5, mode: str = "HGR", extra: int = 2) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, seq, frame, bank, page, content, offsets) arrays: what budgeted(Encoder(..), frames(..)) gives each text, all texts side by side.

    The queue of Encoder.operations() is one order: all cells with a priority are in it from the start, ahead of all that
    went back, so each comes up once, in its first place, with what error is left there then.
    """
    if not texts:
        return
    if (mode, palette) not in _ERRORS:
        _ERRORS[mode, palette] = Errors(mode, palette)
    errors = _ERRORS[mode, palette]
    layout = errors.layout
    banks, wide = layout.banks, 240 * layout.banks
    lengths = [min(PAGES, -(-len(t) // wide)) for t in texts]
    base = np.cumsum([0, *lengths])
    whose, seq = np.repeat(np.arange(len(texts)), lengths), np.zeros(len(texts), np.int64)
    sheet = np.arange(base[-1]) - base[whose]
    screen = np.zeros((base[-1], banks, 256), np.int64)
    owed = np.zeros_like(screen)
    last = np.array([-(-len(t) // (wide * PAGES)) for t in texts])
    off = np.arange(256)
    for frame in range(last.max(initial=0)):
        on = np.flatnonzero(last[whose] > frame)
        spot = np.cumsum([0, *(lengths[i] if last[i] > frame else 0 for i in range(len(texts)))])
        target = np.zeros((len(on), banks, 256), np.int64)
        for i in np.flatnonzero(last > frame):
            made = layout.pages(texts[i][frame * wide * PAGES : (frame + 1) * wide * PAGES])
            target[spot[i] : spot[i] + len(made)] = made
        want, page, movie = layout.mask(layout.pack(target)), sheet[on], whose[on]
        for bank in range(banks):
            share = ops_per_frame * (bank + 1) // banks - ops_per_frame * bank // banks
            byte, goal = np.broadcast_to(layout.byte[bank], (len(on), 256)), want[:, bank]
            places = errors.place(byte, goal).astype(np.intp)
            if frame or bank:
                have = layout.mask(layout.pack(screen[on]))[:, bank]
                weight = errors.distance(byte.ravel(), have.ravel(), goal.ravel()).reshape(-1, 256).astype(np.int64)
            else:
                weight = errors.blank.take(places)
            weight[:, HOLE] = 0
            priority = np.ascontiguousarray(np.where(weight == 0, 0, owed[on, bank] + weight))
            shown, content = np.ascontiguousarray(screen[on, bank]), target[:, bank]
            ties = nonce(page[:, None], off, frame)
            # By delta, nonce and offset: 65536 * error + rank is below 0 where a content brings a cell closer.
            far = np.int32(1 << 16)
            rank = np.where(weight > 0, (ties << 8) + off - (weight << 16), far).astype(np.int32)
            errors.learn(places, content)
            # By movie, falling priority, nonce, page and offset, as one number: a movie's first row (in encode() some TOGETHER)
            # times a priority (below 2^30, as texts are below 2^31) stays below 2^42.
            cells, top = np.flatnonzero(priority), priority.max(initial=0) + 1
            key = np.repeat(spot[movie] * top + top - 1, 256).take(cells)
            key -= priority.take(cells)
            key <<= 21
            key += ((ties << 13) + (page << 8)[:, None] + off).take(cells)
            key.sort()
            queue = (key // (top << 21) + (key >> 8 & 31) << 8) + (key & 255)
            stop = np.cumsum(np.bincount(movie.take(cells >> 8), minlength=len(texts)))
            at = np.concatenate([[0], stop[:-1]])
            left, flat, ranks, pixels, wanted = np.flatnonzero(at < stop), priority.reshape(-1), rank.reshape(-1), shown.reshape(-1), content.reshape(-1)
            out = []
            for _ in range(share):
                check = left
                while len(check):  # past cells that have nothing left
                    check = check[at[check] < stop[check]]
                    check = check[flat[queue[at[check]]] == 0]
                    at[check] += 1
                left = left[at[left] < stop[left]]
                if not len(left):
                    break
                best = queue[at[left]]
                at[left] += 1
                c, line = wanted[best], best >> 8
                flat[best], ranks[best], pixels[best] = 0, far, c
                offsets = np.repeat((best & 255)[:, None], 4, 1)
                wrong = errors(places.take(line, 0), c)
                keys, rows = rank.take(line, 0), np.arange(len(line))
                keys += wrong
                for k in range(1, extra + 1):
                    near = keys.argmin(1)
                    good = np.flatnonzero(keys[rows, near] < 0)
                    if not len(good):
                        break
                    q = near[good]
                    error, to = wrong[good, q] >> 16, line[good] * 256 + q
                    offsets[good, k], keys[good, q] = q, far
                    flat[to], pixels[to] = error, c[good]
                    ranks[to[error == 0]] = far
                out.append((left, seq[left], page[line] + PAGES, c, offsets))
                seq[left] += 1
            owed[on, bank], screen[on, bank] = priority, shown
            if out:
                text, number, pages, contents, offsets = (np.concatenate(x) for x in zip(*out))
                yield text, number, np.full(len(text), frame), np.full(len(text), bank), pages, contents, offsets


SCHEMA = "movie long, seq long, frame int, bank int, page int, content int, offsets array<int>"


def encode(docs: DataFrame, ops_per_frame: int, palette: int = 5, mode: str = "HGR") -> DataFrame:
    """(movie, seq, frame, bank, page, content, offsets) of every movie; a null or empty text gives none. No shuffle."""
    ship(docs.sparkSession)
    movies = docs.select(F.col("doc_id").cast("long").alias("movie"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["movie", "seq", "frame", "bank", "page", "content", "offsets"]
        wide = 240 * Layout(mode).banks

        def take(ids, texts):
            for text, seq, *rest, offsets in together(texts, ops_per_frame, palette, mode):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * 4), pa.array(offsets.astype(np.int32).ravel()))
                yield pa.record_batch([pa.array(ids, pa.int64()).take(pa.array(text)), pa.array(seq), *(pa.array(x.astype(np.int32)) for x in rest), lists], names)

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            movie, held, pages = b.column(0).to_pylist(), [], 0
            # Movies of like numbers of frames go side by side.
            for i in sorted(range(len(texts)), key=lambda i: -(-len(texts[i]) // (wide * PAGES))):
                held.append(i)
                pages += min(PAGES, -(-len(texts[i]) // wide))
                if pages * (wide // 240) >= TOGETHER:
                    yield from take([movie[j] for j in held], [texts[j] for j in held])
                    held, pages = [], 0
            yield from take([movie[j] for j in held], [texts[j] for j in held])

    return movies.mapInArrow(run, SCHEMA)
