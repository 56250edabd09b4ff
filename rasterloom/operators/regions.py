"""Address ranges where the region that was registered last counts."""

from __future__ import annotations


def flatten(regions: list[tuple[int, str, int, int, bool]]) -> list[tuple[int, int, str, bool]]:
    """(first, last, name, writable) without overlaps, of regions (order, name, first, last, writable): the last one registered wins.

    Neighbouring ranges of one region are one. There are as many ranges as regions have ends, so a lookup can broadcast them.
    """
    cuts = sorted({at for _, _, first, last, _ in regions for at in (first, last + 1)})
    out: list[tuple[int, int, str, bool]] = []
    for first, stop in zip(cuts, cuts[1:]):
        over = [r for r in regions if r[2] <= first and stop - 1 <= r[3]]
        if not over:
            continue
        _, name, _, _, writable = max(over, key=lambda r: r[0])
        if out and out[-1][1] == first - 1 and out[-1][2:] == (name, writable):
            out[-1] = (out[-1][0], stop - 1, name, writable)
        else:
            out.append((first, stop - 1, name, writable))
    return out
