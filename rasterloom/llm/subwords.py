"""Token ids of a tokenizers file, by cached parts of words: the same ids as Tokenizer.encode(text, add_special_tokens=False)."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

#: Texts of these characters are lower-cased and cut here; others go to the library, word by word.
_LETTERS = "!-~ß-öø-ÿÀ-ÖØ-Þ"
_PLAIN = re.compile(rf"[{_LETTERS} \n\r\t]*\Z")
_BLANK = re.compile(r"[ \n\r\t]+")
#: Characters that are cut into parts at once.
_SLICE = 1 << 20
_LAST: dict[str, "PartCache"] = {}

#: The same on UTF-8 bytes: lower-cased ASCII and plain blanks, and each byte's kind, that of a part but for DIGIT.
BLANK, LETTER, DIGIT, OTHER, STRANGE = range(5)
_LOWER = bytes(32 if b in b"\n\r\t" else b | 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.full(256, STRANGE, np.uint8)
_KIND[33:127] = OTHER
_KIND[32] = BLANK
_KIND[48:58] = DIGIT
_KIND[[*range(97, 123), *range(128, 192), 0xC3]] = LETTER
#: What "'" begins a part with, if no part of OTHER runs into it.
_SHORT = re.compile(rb"'(?:s|t|re|ve|m|ll|d)")


def _plain_parts(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, number of parts of each text, whether each text is plain) of UTF-8 texts.

    The buffer is the texts lower-cased, a blank after each; a part goes on to the next one's start, so blanks end it. Texts
    that are not plain have parts too, which mean nothing.
    """
    buffer = b" ".join([*texts, b""]).translate(_LOWER)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    at = np.frombuffer(buffer, np.uint8).copy()
    kind = _KIND[at]
    strange = np.flatnonzero(kind == STRANGE)
    cross = np.flatnonzero(at == 0xC3) + 1  # multiplication and division signs are no letters
    cross = cross[(at[cross] == 0x97) | (at[cross] == 0xB7)]
    special = np.flatnonzero((at[:-1] == 60) & (at[1:] == 124))  # "<|"
    plain = np.ones(len(texts), bool)
    plain[np.searchsorted(ends, np.concatenate([strange, cross, special]), "right")] = False
    capital = (at >= 0x80) & (at <= 0x9E)
    at[capital] += 0x20
    begins = np.empty(len(kind), bool)
    begins[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == DIGIT
    begins &= kind != BLANK
    buffer = at.tobytes()
    for i in np.flatnonzero((at == 39) & begins).tolist():
        if (short := _SHORT.match(buffer, i)) is not None:
            begins[i + 1] = False
            j = short.end()
            begins[j] = kind[j] != BLANK
    starts = np.flatnonzero(begins)
    upto = np.searchsorted(starts, ends)
    return buffer, starts, np.diff(upto, prepend=0), plain


class PartCache:
    """Encodes texts as little-endian uint32 ids.

    Such a tokenizer lower-cases, cuts at blanks, which it drops, and cuts what is between them into parts by a pattern;
    a text's ids are its parts' ids in order. Parts that were not used while `limit` others came are forgotten, which
    bounds the memory.
    """

    def __init__(self, path: str, limit: int = 160_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known, self.before = Tokenizer.from_file(path), limit, {}, {}
        self.known_bytes, self.before_bytes, self.joined = {}, {}, None
        self.splits, self.letters = self._splitter()
        if self.splits is not None:  # the same model alone, for parts that are normalised and cut already
            spec = json.loads(self.tokenizer.to_str())
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))

    def _splitter(self):
        """(compiled pattern, byte alphabet) if this tokenizer is of the kind whose words can be cut in Python, else (None, None)."""
        spec = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"]:
            return None, None
        if (pre[0]["behavior"], pre[0]["invert"], pre[1]["add_prefix_space"], pre[1]["use_regex"]) != ("Removed", True, False, False):
            return None, None
        pattern = pre[0]["pattern"].get("Regex", "").replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9")
        if "\\p" in pattern:
            return None, None
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters, more = {b: chr(b) for b in kept}, 256
        for b in range(256):
            if b not in letters:
                letters[b] = chr(more)
                more += 1
        return re.compile(pattern), letters

    def _join(self) -> None:
        """Lets many parts be encoded in one call, where the last id of each can be told; only who calls it holds what this takes."""
        from tokenizers import Tokenizer

        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        if self.joined is None and spec["model"]["type"] == "BPE" and suffix:
            self.joined = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            self.last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _learn(self, new: set[str]) -> None:
        """Adds the ids of parts, and of words that the library must cut, that aren't known; one library call encodes all parts."""
        known, before = self.known, self.before
        parts = []
        for p in new:
            if p in before:
                known[p] = before[p]
            elif p[0] == " ":
                known[p] = array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes()
            else:
                parts.append(p)
        if parts:
            spell = self.letters.__getitem__
            spelled = [p if p.isascii() else "".join(map(spell, p.encode())) for p in parts]
            known.update(zip(parts, self._spelled_ids(spelled)))

    def _spelled_ids(self, spelled: list[str]) -> list[bytes]:
        """The ids of each part, given in the letters for bytes."""
        out: list[bytes] = []
        for lo in range(0, len(spelled), 4096):
            some = spelled[lo : lo + 4096]
            if self.joined is not None:
                ids = np.array(self.joined.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                stops = (np.flatnonzero(self.last[ids]) + 1) * 4
                if len(stops) == len(some):
                    flat, stops = ids.tobytes(), stops.tolist()
                    out += [flat[a:b] for a, b in zip([0, *stops], stops)]
                    continue
            out += [array("I", e.ids).tobytes() for e in self.bare.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def _cut(self, text: str) -> Iterator[list[str]]:
        """The parts of a text, some at a time; a word that the library must cut is one, after a blank."""
        at = 0
        while at < len(text):
            stop = at + _SLICE
            if stop < len(text):  # a slice ends at a blank
                blank = _BLANK.search(text, stop)
                stop = blank.end() if blank else len(text)
            piece = text[at:stop]
            at = stop
            if self.splits is None:
                yield [" " + w for w in _BLANK.split(piece) if w]
            elif "<|" not in piece and _PLAIN.match(piece):
                yield self.splits.findall(piece.lower())
            else:
                out = []
                for w in _BLANK.split(piece):
                    if "<|" not in w and _PLAIN.match(w):
                        out += self.splits.findall(w.lower())
                    else:
                        out.append(" " + w)
                yield out

    def encode(self, text: str) -> bytes:
        out = []
        for parts in self._cut(text):
            if len(self.known) > self.limit:
                self.before, self.known = self.known, {}
            if new := set(parts).difference(self.known):
                self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, parts)))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of UTF-8 texts one after another, how many each has); each kind of part is looked up once in all texts."""
        import pyarrow as pa

        if self.splits is None:
            each = [np.frombuffer(self.encode(t.decode()), "<u4") for t in texts]
            return np.concatenate([np.empty(0, "<u4"), *each]), np.array([len(x) for x in each], np.int64)
        short = np.array([len(t) <= _SLICE for t in texts], bool)  # long ones are cut into slices
        buffer, starts, n, plain = _plain_parts([t if s else b"" for t, s in zip(texts, short.tolist())])
        plain &= short
        of_plain = np.repeat(plain, n)
        n[~plain] = 0
        offsets = np.append(starts, len(buffer)).astype(np.int32)
        kinds = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).dictionary_encode()
        codes, kinds = kinds.indices.to_numpy(zero_copy_only=False), kinds.dictionary
        if not plain.all():  # what is not plain isn't looked up
            codes = codes[of_plain]
            used = np.zeros(len(kinds), bool)
            used[codes] = True
            codes, kinds = (np.cumsum(used) - 1)[codes], kinds.filter(pa.array(used))
        parts = [p.rstrip(b" ") for p in kinds.to_numpy(zero_copy_only=False).tolist()]
        if len(self.known_bytes) > self.limit:
            self.before_bytes, self.known_bytes = self.known_bytes, {}
        known, before = self.known_bytes, self.before_bytes
        if new := set(parts).difference(known):
            if old := new.intersection(before):
                known.update((p, before[p]) for p in old)
                new -= old
            if self.joined is None:
                self._join()
            spell = self.letters.__getitem__
            new = list(new)
            known.update(zip(new, self._spelled_ids([p.decode("ascii") if p.isascii() else "".join(map(spell, p)) for p in new])))
        made = [known[p] for p in parts]
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat = np.frombuffer(b"".join(made), "<u4")
        each = size[codes]
        stops = np.cumsum(each)
        place = np.repeat((np.cumsum(size) - size)[codes] - (stops - each), each)
        place += np.arange(len(place))
        ids = flat[place]
        stops = np.append(0, stops)[np.cumsum(n)]
        counts = np.diff(stops, prepend=0)
        if not plain.all():
            pieces, at = [], 0
            for i in np.flatnonzero(~plain).tolist():
                begin = int(stops[i])
                other = np.frombuffer(self.encode(texts[i].decode()), "<u4")
                pieces += [ids[at:begin], other]
                at, counts[i] = begin, len(other)
            ids = np.concatenate([*pieces, ids[at:]])
        return ids, counts

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new parts of all short ones are looked up together."""
        cut = [next(self._cut(t), []) if len(t) <= _SLICE else None for t in texts]
        if len(self.known) > self.limit:
            self.before, self.known = self.known, {}
        new: set[str] = set()
        new.update(*(c for c in cut if c))
        if new := new.difference(self.known):
            self._learn(new)
        get = self.known.__getitem__
        short = [None if c is None else b"".join(map(get, c)) for c in cut]
        return [self.encode(t) if s is None else s for t, s in zip(texts, short)]


def encoder(path: str) -> PartCache:
    """This worker's encoder for the file; kept between tasks."""
    if path not in _LAST:
        _LAST.clear()
        _LAST[path] = PartCache(path)
    return _LAST[path]
