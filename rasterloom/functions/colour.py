"""Palettes, CIEDE2000 differences and the cost of changing one pixel sequence into another."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 4-bit dot patterns of the nominal colours, and two palettes' sRGB values.
CODES = {"BLACK": 0, "MAGENTA": 1, "BROWN": 8, "ORANGE": 9, "DARK_GREEN": 4, "GREY1": 5, "GREEN": 12, "YELLOW": 13, "DARK_BLUE": 2, "VIOLET": 3, "GREY2": 10, "PINK": 11, "MED_BLUE": 6, "LIGHT_BLUE": 7, "AQUA": 14, "WHITE": 15}
NTSC = {"BLACK": (0, 0, 0), "MAGENTA": (148, 12, 125), "BROWN": (99, 77, 0), "ORANGE": (249, 86, 29), "DARK_GREEN": (51, 111, 0), "GREY1": (126, 126, 126), "GREEN": (67, 200, 0), "YELLOW": (221, 206, 23), "DARK_BLUE": (32, 54, 212), "VIOLET": (188, 55, 255), "GREY2": (126, 126, 126), "PINK": (255, 129, 236), "MED_BLUE": (7, 168, 225), "LIGHT_BLUE": (158, 172, 255), "AQUA": (93, 248, 133), "WHITE": (255, 255, 255)}
IIGS = {"BLACK": (0, 0, 0), "MAGENTA": (221, 0, 51), "BROWN": (136, 85, 34), "ORANGE": (255, 102, 0), "DARK_GREEN": (0, 119, 0), "GREY1": (85, 85, 85), "GREEN": (0, 221, 0), "YELLOW": (255, 255, 0), "DARK_BLUE": (0, 0, 153), "VIOLET": (221, 0, 221), "GREY2": (170, 170, 170), "PINK": (255, 153, 136), "MED_BLUE": (34, 34, 255), "LIGHT_BLUE": (102, 170, 255), "AQUA": (0, 255, 153), "WHITE": (255, 255, 255)}
PALETTES = {0: ("IIGS", IIGS), 5: ("NTSC", NTSC)}
# sRGB to XYZ, and the D65 white point.
TO_XYZ = ((0.412424, 0.357579, 0.180464), (0.212656, 0.715158, 0.0721856), (0.0193324, 0.119193, 0.950444))
WHITE = (0.95047, 1.0, 1.08883)


def palette_rows() -> list[tuple]:
    """(palette_id, palette, code, name, r, g, b)."""
    return [(p, label, CODES[n], n, *rgb) for p, (label, colours) in PALETTES.items() for n, rgb in colours.items()]


def lab(rgb: tuple) -> tuple:
    """CIE Lab of an sRGB colour, under D65."""
    line = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb]
    xyz = [sum(k * c for k, c in zip(row, line)) / w for row, w in zip(TO_XYZ, WHITE)]
    x, y, z = (v ** (1 / 3) if v > 216 / 24389 else 7.787 * v + 16 / 116 for v in xyz)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def ciede2000(one: tuple, two: tuple) -> float:
    """The CIEDE2000 difference of two Lab colours, by the published formula, with unit weights."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    mean_c7 = ((math.hypot(a1, b1) + math.hypot(a2, b2)) / 2) ** 7
    g = 0.5 * (1 - math.sqrt(mean_c7 / (mean_c7 + 25**7)))
    a1, a2 = (1 + g) * a1, (1 + g) * a2
    c1, c2 = math.hypot(a1, b1), math.hypot(a2, b2)
    h1, h2 = (math.degrees(math.atan2(b, a)) % 360 for a, b in ((a1, b1), (a2, b2)))
    grey = c1 * c2 == 0
    turn = 0.0 if grey else (h2 - h1 + 180) % 360 - 180
    if grey:
        hue = h1 + h2
    elif abs(h1 - h2) <= 180:
        hue = (h1 + h2) / 2
    else:
        hue = (h1 + h2 + (360 if h1 + h2 < 360 else -360)) / 2
    cos = lambda deg: math.cos(math.radians(deg))
    t = 1 - 0.17 * cos(hue - 30) + 0.24 * cos(2 * hue) + 0.32 * cos(3 * hue + 6) - 0.2 * cos(4 * hue - 63)
    light, chroma = (l1 + l2) / 2, (c1 + c2) / 2
    off = (light - 50) ** 2
    dl = (l2 - l1) / (1 + 0.015 * off / math.sqrt(20 + off))
    dc = (c2 - c1) / (1 + 0.045 * chroma)
    dh = 2 * math.sqrt(c1 * c2) * math.sin(math.radians(turn / 2)) / (1 + 0.015 * chroma * t)
    spread = 30 * math.exp(-(((hue - 275) / 25) ** 2))
    twist = -2 * math.sqrt(chroma**7 / (chroma**7 + 25**7)) * math.sin(math.radians(2 * spread))
    return math.sqrt(dl * dl + dc * dc + dh * dh + twist * dc * dh)


def costs(palette: int) -> list[int]:
    """The truncated differences of all pairs of codes, at a * 16 + b; 256 numbers, from the palette."""
    names = {CODES[n]: rgb for n, rgb in PALETTES[palette][1].items()}
    return [int(ciede2000(lab(names[a]), lab(names[b]))) for a in range(16) for b in range(16)]


def pixel_distance(a: Column, b: Column, length: int, palette: int) -> Column:
    """The cost of turning pixels a into b: substitutions by colour, swaps of neighbours for 1; both of one length.

    Insertions cost more than any such path, so the distance of a prefix depends on the two before it only.
    """
    table = F.array(*[F.lit(c) for c in costs(palette)])
    start = F.struct(F.lit(0).alias("last"), F.lit(1 << 20).alias("before"))

    def step(acc: Column, i: Column) -> Column:
        x, y, px, py = F.get(a, i), F.get(b, i), F.get(a, i - 1), F.get(b, i - 1)
        change = acc["last"] + F.get(table, x * 16 + y)
        swap = F.when((i > 0) & (x == py) & (px == y), acc["before"] + 1).otherwise(F.lit(1 << 20))
        return F.struct(F.least(change, swap).alias("last"), acc["last"].alias("before"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), start, step)["last"]


def pixels(dots: Column, length: int, phase: Column) -> Column:
    """Colours of the four-dot windows that start at each dot; the phase advances by one a dot."""
    def colour(i: Column) -> Column:
        v = F.call_function("shiftright", dots, i).bitwiseAND(F.lit(15))
        n = (i + phase) % 4
        return F.call_function("shiftleft", v, n).bitwiseOR(F.call_function("shiftright", v, 4 - n)).bitwiseAND(F.lit(15))

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), colour)
