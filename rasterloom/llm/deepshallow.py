"""Deep-shallow sorting of suffixes in numpy, all groups of a stage at once.

Shallow: multikey quicksort with eight-byte characters. Each group is parted by a pivot character into the suffixes that
are less, equal and greater; equal ones go on with the next character, the others with the same one, until a group has
one suffix or agrees to the shallow depth. Deep: what still agrees goes to blind tries, which hold branch depths and
branch bytes only. A group's trie branches where a member first differs from the group's first suffix; equal branches go
on, single ones are done.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x[: len(data)]


def classes(data: np.ndarray, at: np.ndarray, length, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices into `at`, class): the strings that equal another one of their group, with a number for each such string.

    length: bytes of each string, one number or one per string, the same within a group; data has them at each position.
    group: ascending group numbers; without, all strings are one group.
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, size = words(data), np.broadcast_to(np.asarray(length, np.int64), at.shape)
    item, gid, depth = np.arange(len(at)), np.zeros(len(at), np.int64) if group is None else group, np.zeros(len(at), np.int64)
    item, gid, depth = _pairs(item, depth, _starts(gid))
    deep, turn = [], 0
    while len(item):
        done = depth >= np.minimum(size[item], SHALLOW)
        if done.any():
            deep.append((item[done], gid[done]))
            item, gid, depth = _pairs(item[~done], depth[~done], _starts(gid[~done]))
            continue
        item, gid, depth = _part(w, at, size, item, gid, depth, turn)
        turn += 1
    if not deep:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    upto = np.cumsum([0] + [g[-1] + 1 for _, g in deep])
    return _tries(data, w, at, size, np.concatenate([i for i, _ in deep]), np.concatenate([g + u for (_, g), u in zip(deep, upto)]))


def _part(w, at, size, item, gid, depth, turn: int):
    """One round of quicksort: every group parted by its pivot, a median of three of its characters."""
    c = _char(w, at[item], depth, size[item])
    first = np.flatnonzero(_starts(gid))
    count = np.diff(np.append(first, len(item)))
    gid = np.repeat(np.arange(len(first)), count)
    picks = [c[first + ((np.arange(len(first)) * 7919 + turn * 104729 + k * 15485863) % count)] for k in range(3)]
    pivot = np.maximum(np.minimum(picks[0], picks[1]), np.minimum(np.maximum(picks[0], picks[1]), picks[2]))[gid]
    side = (c >= pivot).astype(np.int64) + (c > pivot)
    key = 3 * gid + side
    begin = np.cumsum(np.bincount(key, minlength=3 * len(first)))
    begin = np.concatenate([[0], begin[:-1]])
    place = np.empty(len(item), np.int64)
    for s in range(3):  # a stable partition by counting
        mine = np.flatnonzero(side == s)
        g, turn_ = gid[mine], np.arange(len(mine))
        place[mine] = begin[3 * g + s] + turn_ - np.maximum.accumulate(np.where(_starts(g), turn_, 0))
    order = np.empty(len(item), np.int64)
    order[place] = np.arange(len(item))
    return _pairs(item[order], (depth + 8 * (side == 1))[order], _starts(key[order]))


def _starts(gid: np.ndarray) -> np.ndarray:
    """Where a group begins."""
    return np.concatenate([[True], gid[1:] != gid[:-1]]) if len(gid) else np.zeros(0, bool)


def _groups(start: np.ndarray) -> np.ndarray:
    """Numbers of the groups that begin where start is true."""
    return np.cumsum(start) - 1


def _pairs(item: np.ndarray, depth: np.ndarray, start: np.ndarray):
    """(item, group, depth) without groups of one."""
    gid = _groups(start)
    more = np.bincount(gid, minlength=1)[gid] > 1
    return item[more], _groups(_starts(gid[more])), depth[more]


def _tries(data, w, at, size, item, gid) -> tuple[np.ndarray, np.ndarray]:
    done_item, done_gid, numbered = [], [], 0
    while len(item):
        start = _starts(gid)
        first, gid = np.flatnonzero(start), _groups(start)
        agree = _agreement(w, at[item], at[item[first]][gid], size[item])
        branch = np.minimum.reduceat(agree, first)
        equal = (branch >= size[item[first]])[gid]
        done_item.append(item[equal])
        done_gid.append(numbered + gid[equal])
        numbered += len(first)
        item, gid, depth = item[~equal], gid[~equal], branch[gid][~equal]
        byte = data[at[item] + depth]
        order = np.lexsort((byte, gid))
        key = (gid * 256 + byte)[order]
        item, gid, _ = _pairs(item[order], depth[order], _starts(key))
    return np.concatenate(done_item), np.concatenate(done_gid)


def _char(w: np.ndarray, pos: np.ndarray, depth, size) -> np.ndarray:
    """The eight-byte character at this depth of each string, without what lies beyond its size."""
    over = np.clip(depth + 8 - size, 0, 7)
    return w[pos + depth] >> (over * 8).astype(np.uint64)


def _agreement(w: np.ndarray, pos: np.ndarray, leader: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many bytes, up to its size, each string shares with its leader; the shallow depth at least is known to agree."""
    out = size.copy()
    open_ = np.arange(len(pos))
    depth = 0 if not len(size) else int(min(SHALLOW, size.min())) // 8 * 8
    while len(open_):
        open_ = open_[size[open_] > depth]
        x = _char(w, pos[open_], depth, size[open_]) ^ _char(w, leader[open_], depth, size[open_])
        bad = np.flatnonzero(x)
        # The highest differing byte is the first one; 64 bits don't fit a float, so halves are compared.
        y, byte = x[bad], np.minimum(8, size[open_[bad]] - depth) - 1
        for half in (4, 2, 1):
            big = y >= np.uint64(1 << (8 * half))
            byte -= half * big
            y = np.where(big, y >> np.uint64(8 * half), y)
        out[open_[bad]] = depth + byte
        open_ = np.delete(open_, bad)
        depth += 8
    return out
