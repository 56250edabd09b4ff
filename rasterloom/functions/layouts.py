"""The screen layouts of rasterloom.functions.bits over numpy arrays, many pages at once.

A page is an array [bank, 256] of bytes: one bank (HGR), or the main bank and the auxiliary one (DHGR). Packed columns are
[128] numbers a page; masked values are [bank, 256] again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from rasterloom.functions import bits, colour

HOLE = (np.arange(256) & 127) >= 120
#: Visible cells of a page and bank, and characters of a frame's page and bank.
VISIBLE = np.flatnonzero(~HOLE)


def _hgr_dots(m: np.ndarray, byte: int) -> np.ndarray:
    """Display dots of masked values: previous byte's last dots, the byte's own, the next byte's first."""
    late, own = ((m >> 10) & 1, (m >> 3) & 127) if byte == 0 else ((m >> 3) & 1, (m >> 4) & 127)
    first = np.where(m & 4, (m & 1) * 3 + (m & 2) * 14, (m & 1) + (m & 2) * 7)
    twice = sum(((own >> i) & 1) * ((7 if i == 6 else 3) << 2 * i) for i in range(7))
    out = (first & ((8 << late) - 1)) + (twice << (3 + late))
    at = 17 + ((m >> 11) & 1)
    return ((out & ~(15 << at)) + ((((m >> 12) & 1) * 3 + ((m >> 13) & 1) * 12) << at)) & 0x1FFFFF


class Layout:
    """How a mode places bytes in packed columns."""

    def __init__(self, mode: str):
        self.mode, self.banks = mode, 1 if mode == "HGR" else 2
        self.bits, self.pixels, self.phases = bits.MASKED_BITS[mode], bits.PIXELS[mode], bits.PHASES[mode]
        off = np.arange(256)
        #: Which byte of its column a cell is: [bank, 256]. In DHGR the auxiliary byte comes before the main one.
        self.byte = off[None] % 2 if self.banks == 1 else 2 * (off % 2)[None] + np.array([[1], [0]])
        self.value = 255 if self.banks == 1 else 127

    def pages(self, text: str) -> np.ndarray:
        """[page, bank, 256] of a text: 240 characters a page and bank; the last page is filled with blanks."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32) & self.value
        n = -(-len(codes) // (240 * self.banks))
        cells = np.zeros((n, self.banks, 2, 128), np.int64)
        full = np.zeros(n * 240 * self.banks, np.int64)
        full[: len(codes)] = codes
        cells[..., :120] = full.reshape(n, self.banks, 2, 120)
        return cells.reshape(n, self.banks, 256)

    def pack(self, cells: np.ndarray) -> np.ndarray:
        """[..., 128] of [..., bank, 256]."""
        if self.banks == 1:
            even, odd = cells[..., 0, 0::2], cells[..., 0, 1::2]
            body = (even << 3) + ((odd & 127) << 12) + ((odd & 128) << 4)
            out = body.copy()
            out[..., 1:] += ((body[..., :-1] >> 17) & 3) + ((body[..., :-1] >> 9) & 4)
            out[..., :-1] += (((body[..., 1:] >> 10) & 1) + ((body[..., 1:] >> 2) & 6)) << 19
            return out
        main, aux = cells[..., 0, :], cells[..., 1, :]
        body = sum((b & 127) << (3 + 7 * i) for i, b in enumerate((aux[..., 0::2], main[..., 0::2], aux[..., 1::2], main[..., 1::2])))
        out = body.copy()
        out[..., 1:] += (body[..., :-1] >> 28) & 7
        out[..., :-1] += ((body[..., 1:] >> 3) & 7) << 31
        return out

    def _each(self, columns) -> np.ndarray:
        """[..., bank, 256] of the values that columns(byte) gives for each column."""
        if self.banks == 1:
            return np.stack([columns(0), columns(1)], -1).reshape(*columns(0).shape[:-1], 1, 256)
        main, aux = (np.stack([columns(b), columns(b + 2)], -1) for b in (1, 0))
        return np.stack([x.reshape(*x.shape[:-2], 256) for x in (main, aux)], -2)

    def _mask(self, packed: np.ndarray, byte: int) -> np.ndarray:
        return (packed >> ((8 if self.banks == 1 else 7) * byte)) & ((1 << self.bits) - 1)

    def mask(self, packed: np.ndarray) -> np.ndarray:
        """Masked values of packed columns."""
        return self._each(lambda b: self._mask(packed, b))

    def store(self, packed: np.ndarray, content: np.ndarray) -> np.ndarray:
        """Masked values if content (one number a page and bank, [..., bank]) were stored at each cell alone."""
        def columns(byte: int) -> np.ndarray:
            c = np.asarray(content)[..., 0 if self.banks == 1 or byte % 2 else 1, None]
            if self.banks == 2:
                at = 7 * byte + 3
                return self._mask((packed & ~(127 << at)) + ((c & 127) << at), byte)
            if byte == 0:
                return self._mask((packed & ~(255 << 3)) + (c << 3), 0)
            return self._mask((packed & ~(255 << 11)) + ((((c & 127) << 1) + (c >> 7)) << 11), 1)  # the palette bit comes first

        return self._each(columns)

    def shown(self) -> np.ndarray:
        """Colours of every masked value: [byte, masked, pixel]."""
        m = np.arange(1 << self.bits)
        out = np.empty((len(self.phases), len(m), self.pixels), np.int32)
        for byte, phase in enumerate(self.phases):
            d = _hgr_dots(m, byte) if self.banks == 1 else m
            for i in range(self.pixels):
                v, n = (d >> i) & 15, (i + phase) % 4
                out[byte, :, i] = ((v << n) | (v >> (4 - n))) & 15
        return out


class Distances:
    """Distances of masked values: by colour, swaps of neighbours for 1. Each distinct pair of a call is measured once."""

    def __init__(self, mode: str, palette: int):
        self.layout = Layout(mode)
        self.cost, self.shown = np.array(colour.costs(palette), np.int32), self.layout.shown()

    def __call__(self, byte: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        out = np.zeros(len(src), np.int32)
        on = np.flatnonzero(src != dst)
        if 0 < len(on) < 4096:
            out[on] = self._measure(byte[on], src[on], dst[on])
        elif len(on):
            low, high = np.minimum(src[on], dst[on]).astype(np.int64), np.maximum(src[on], dst[on]).astype(np.int64)
            pair, which = np.unique(((byte[on] << 14) + low << 14) + high, return_inverse=True)
            out[on] = self._measure(pair >> 28, pair >> 14 & 16383, pair & 16383)[which]
        return out

    def _measure(self, byte: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        out = np.empty(len(src), np.int32)
        for at in range(0, len(src), 1 << 16):
            part = slice(at, at + (1 << 16))
            a, b = (np.ascontiguousarray(self.shown[byte[part], m[part]].T) for m in (src, dst))
            last, before = self.cost[a[0] * 16 + b[0]], np.zeros(a.shape[1], np.int32)
            for i in range(1, len(a)):
                swap = np.where((a[i] == b[i - 1]) & (a[i - 1] == b[i]), before + 1, 1 << 20)
                last, before = np.minimum(last + self.cost[a[i] * 16 + b[i]], swap), last
            out[part] = last
        return out


_CACHE: dict[tuple[str, int], Distances] = {}


def distances(mode: str, palette: int) -> Distances:
    """This worker's distances; kept between tasks."""
    if (mode, palette) not in _CACHE:
        _CACHE[mode, palette] = Distances(mode, palette)
    return _CACHE[mode, palette]


def page_batches(layout: Layout, movies: list, texts: list[str | None], size: int = 2048) -> Iterator[tuple]:
    """(movie indices, places, now, before) of some `size` pages each, of those that have text now or in the frame before.

    place: 32 * frame + page. A movie's first frame follows a blank screen.
    """
    made, held = [], 0
    for i, text in enumerate(texts):
        pages, slice_ = -(-len(text or "") // (240 * layout.banks)), 32 * (size // 32 or 1)
        stop = pages if pages <= 32 else min(pages + 32, 32 * -(-pages // 32))
        last = np.zeros((32, layout.banks, 256), np.int64)
        for at in range(0, stop, slice_):
            now = np.zeros((min(slice_, 32 * -(-stop // 32) - at), layout.banks, 256), np.int64)
            some = layout.pages(text[at * 240 * layout.banks : (at + slice_) * 240 * layout.banks])
            now[: len(some)] = some
            n = min(len(now), stop - at)
            made.append((np.full(n, i), np.arange(at, at + n), now[:n], np.concatenate([last, now])[:n]))
            last, held = now[-32:], held + n
            if held >= size:
                yield tuple(np.concatenate(x) for x in zip(*made))
                made, held = [], 0
    if made:
        yield tuple(np.concatenate(x) for x in zip(*made))
