"""Bit layouts as SQL expressions over BIGINT operands, valid in Spark SQL and in DuckDB alike.

An HGR column packs two screen bytes with two dots' and a palette bit's worth of each neighbour (22 bits); a DHGR column
packs four 7-bit bytes with three bits of each neighbour (34 bits). Fields never overlap, so sums replace exclusive ors.
"""

from __future__ import annotations

# Colour phase at each byte's first masked bit, masked width, dots that get a colour, per mode.
PHASES = {"HGR": (1, 3), "DHGR": (1, 0, 3, 2)}
MASKED_BITS = {"HGR": 14, "DHGR": 13}
PIXELS = {"HGR": 18, "DHGR": 10}


def rol(v: str, n: str) -> str:
    """v, of four bits, rotated left."""
    return f"((({v}) << ({n})) | (({v}) >> (4 - ({n})))) & 15"


def ror(v: str, n: str) -> str:
    return f"((({v}) >> ({n})) | (({v}) << (4 - ({n})))) & 15"


def hgr_body(even: str, odd: str) -> str:
    """Even byte whole from bit 3; odd byte's palette bit at 11, its dots from 12."""
    return f"(({even}) << 3) + ((({odd}) & 127) << 12) + ((({odd}) & 128) << 4)"


def hgr_header(before: str) -> str:
    """The two last dots of the column before (bits 17, 18) and their palette bit (11), as bits 0 to 2."""
    return f"((({before}) >> 17) & 3) + ((({before}) >> 9) & 4)"


def hgr_footer(after: str) -> str:
    """The palette bit (10) and the two first dots (3, 4) of the column after, as bits 19 to 21."""
    return f"(((({after}) >> 10) & 1) + ((({after}) >> 2) & 6)) << 19"


def dhgr_body(aux_even: str, main_even: str, aux_odd: str, main_odd: str) -> str:
    return " + ".join(f"((({b}) & 127) << {3 + 7 * i})" for i, b in enumerate((aux_even, main_even, aux_odd, main_odd)))


def dhgr_header(before: str) -> str:
    return f"(({before}) >> 28) & 7"


def dhgr_footer(after: str) -> str:
    return f"((({after}) >> 3) & 7) << 31"


def masked(mode: str, packed: str, byte: int) -> str:
    """What influences or is influenced by one byte of a column."""
    shift = 8 * byte if mode == "HGR" else 7 * byte
    return f"(({packed}) >> {shift}) & {2 ** MASKED_BITS[mode] - 1}"


def stored(mode: str, packed: str, byte: int, value: str) -> str:
    """The column after a store at one of its bytes; neighbours are not patched."""
    if mode == "DHGR":
        at = 7 * byte + 3
        return f"(({packed}) - (({packed}) & {127 << at})) + ((({value}) & 127) << {at})"
    if byte == 0:
        return f"(({packed}) - (({packed}) & {255 << 3})) + (({value}) << 3)"
    # An odd byte's palette bit comes first.
    return f"(({packed}) - (({packed}) & {255 << 11})) + (((({value}) & 127) << 1) + (({value}) >> 7) << 11)"


def double(v: str) -> str:
    """Seven bits as fifteen dots: each twice, the last three times."""
    return " + ".join(f"((({v}) & {1 << i}) * {(7 if i == 6 else 3) << i})" for i in range(7))


def hgr_dots(m: str, byte: int) -> str:
    """21 dots of a masked value. A palette bit delays its byte by one dot; a byte's start hides what it meets."""
    late, bits = (f"((({m}) >> 10) & 1)", f"((({m}) >> 3) & 127)") if byte == 0 else (f"((({m}) >> 3) & 1)", f"((({m}) >> 4) & 127)")
    before = f"(CASE WHEN (({m}) & 4) = 0 THEN (({m}) & 1) + (({m}) & 2) * 7 ELSE (({m}) & 1) * 3 + (({m}) & 2) * 14 END)"
    own = f"(({before} & ((8 << {late}) - 1)) + (({double(bits)}) << (3 + {late})))"
    next_late = f"((({m}) >> 11) & 1)"
    after = f"(((({m}) >> 12) & 1) * 3 + ((({m}) >> 13) & 1) * 12)"
    hidden = f"({own} & (15 << (17 + {next_late})))"
    return f"({own} - {hidden} + ({after} << (17 + {next_late}))) & 2097151"
