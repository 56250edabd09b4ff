"""Published bit patterns of packed columns, dots and colours."""

import numpy as np

from rasterloom.functions import bits, colour, layouts


def one(spark, *expressions):
    return list(spark.sql("SELECT " + ", ".join(f"({e}) AS c{i}" for i, e in enumerate(expressions))).first())


def test_hgr_body(spark):
    cases = {(0b01000011, 0b01000011): 0b0001000011001000011000, (0b01000011, 0b11000011): 0b0001000011101000011000, (0b11000011, 0b01000011): 0b0001000011011000011000, (0b11000011, 0b11000011): 0b0001000011111000011000}
    assert one(spark, *[bits.hgr_body(f"{a}L", f"{b}L") for a, b in cases]) == list(cases.values())


def test_hgr_apply(spark):
    cells = [0] * 256
    cells[197:201] = [128, 143, 192, 128]
    row = spark.createDataFrame([(cells,)], "cells array<bigint>")
    from rasterloom.sources import screens

    assert screens.packed_hgr(row).first()["packed"][99] == 0b0011000000110001111100
    assert layouts.Layout("HGR").pack(np.array([cells]))[99] == 0b0011000000110001111100


def test_dhgr_pack(spark):
    from rasterloom.sources import screens

    for at, expected in ((0, {0: 0b0001000011111010110000111110101000, 1: 0b100}), (2, {0: 0b1010 << 30, 1: 0b0001000011111010110000111110101000, 2: 0b100}), (254, {126: 0b1010 << 30, 127: 0b0001000011111010110000111110101000})):
        main, aux = [0] * 256, [0] * 256
        aux[at], main[at], aux[at + 1], main[at + 1] = 0b11110101, 0b01000011, 0b11110101, 0b01000011
        row = spark.createDataFrame([(1, 0, 0, main, aux)], "movie long, frame int, page int, main array<bigint>, aux array<bigint>")
        packed = screens.packed_dhgr(row).first()["packed"]
        assert {i: p for i, p in enumerate(packed) if p} == expected
        packed = layouts.Layout("DHGR").pack(np.array([main, aux]) & 127)
        assert {i: int(p) for i, p in enumerate(packed) if p} == expected


def test_dhgr_masked_update(spark):
    expected = [0b1111111000, 0b11111110000000000, 0b111111100000000000000000, 0b1111111000000000000000000000000]
    assert one(spark, *[bits.stored("DHGR", "0L", b, "255L") for b in range(4)]) == expected
    ones = 2**34 - 1
    assert one(spark, *[bits.stored("DHGR", f"{ones}L", b, "0L") for b in range(4)]) == [ones - e for e in expected]


def test_double_pixels(spark):
    assert one(spark, bits.double("85L")) == [0b111001100110011]


def test_hgr_dots(spark):
    even = {0b11: 0b111, 0b111: 0b111, 0b00010000000111: 0b1111, 0b00011010101111: 0b10011001100111111, 0b00111010101111: 0b110011001100111111, 0b10111010101111: 0b100110011001100111111, 0b10100000000000: 1 << 20, 0b10000000000000: 3 << 19}
    odd = {0b11: 0b111, 0b111: 0b111, 0b1111: 0b1111, 0b00010101011111: 0b10011001100111111, 0b00110101011111: 0b110011001100111111, 0b10110101011111: 0b100110011001100111111, 0b10100000000000: 1 << 20, 0b10000000000000: 3 << 19}
    for byte, cases in enumerate((even, odd)):
        assert one(spark, *[bits.hgr_dots(f"{m}L", byte) for m in cases]) == list(cases.values())
        assert layouts._hgr_dots(np.array(list(cases)), byte).tolist() == list(cases.values())


def test_colour_window(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(colour.pixels(F.lit(0b0000111100001111000011110000), 31, F.lit(0)).alias("p")).first()
    assert row["p"] == [0, 1, 3, 7, 15, 14, 12, 8] * 3 + [0] * 7


def test_palette_edges(spark):
    """Colours at the border of bytes whose palette bits differ."""
    from rasterloom.sources import screens

    cases = {("even", 0b01000000, 0b10000000): [1, 3, 7, 7, 6, 4], ("even", 0b11000000, 0): [2, 2, 2, 2, 0], ("even", 0b11000000, 1): [2, 6, 14, 14, 12], ("even", 0b11100000, 0): [8, 9, 11, 11, 3, 2, 0], ("odd", 0b01000000, 0b10000000): [4, 12, 13, 13, 9, 1], ("odd", 0b11000000, 1): [8, 9, 11, 11, 3], ("odd", 0b11100000, 0): [2, 6, 14, 14, 12, 8, 0]}
    shown = layouts.Layout("HGR").shown()
    for (side, a, b), tail in cases.items():
        byte = int(side == "odd")
        cells = [0] * 256
        cells[byte], cells[byte + 1] = a, b
        packed = screens.packed_hgr(spark.createDataFrame([(cells,)], "cells array<bigint>")).first()["packed"][0]
        pixels = shown[byte, packed >> 8 * byte & 16383].tolist()
        assert pixels[-len(tail) :] == tail and not any(pixels[: -len(tail)])


def test_rotations(spark):
    assert one(spark, bits.rol("9L", "1"), bits.ror("9L", "1"), bits.rol("6L", "3")) == [3, 12, 3]


def test_layouts_equal_the_expressions(spark):
    """Masked values and stores in numpy are those of the SQL expressions, bank by bank."""
    rng = np.random.default_rng(4)
    for mode in ("HGR", "DHGR"):
        layout = layouts.Layout(mode)
        cells = rng.integers(0, layout.value + 1, (1, layout.banks, 256))
        packed, content = layout.pack(cells), int(rng.integers(0, layout.value + 1))
        masked, stored = layout.mask(packed), layout.store(packed, np.full((1, layout.banks), content))
        for bank in range(layout.banks):
            for off in (0, 1, 100, 255):
                column, byte = f"{packed[0, off // 2]}L", int(layout.byte[bank, off])
                got = one(spark, bits.masked(mode, column, byte), bits.masked(mode, bits.stored(mode, column, byte, f"{content}L"), byte))
                assert got == [masked[0, bank, off], stored[0, bank, off]]


def test_page_batches():
    """Pages come with the frame before; a frame without text follows a full one as blank."""
    for mode in ("HGR", "DHGR"):
        layout = layouts.Layout(mode)
        size = 240 * layout.banks
        texts = ["a" * (size * 70 + 1), None, "", "b" * 5, "c" * (size * 33)]
        for batch in (64, 2048):
            got = list(layouts.page_batches(layout, [1, 2, 3, 4, 5], texts, batch))
            movie, place, now, before = (np.concatenate(x) for x in zip(*got))
            assert {int(m): place[movie == m].tolist() for m in np.unique(movie)} == {0: list(range(96)), 3: [0], 4: list(range(64))}
            assert now[(movie == 0) & (place < 70)][:, :, layouts.VISIBLE].min() == 97 and now[(movie == 0) & (place > 70)].max() == 0
            assert before[(movie == 0) & (place < 32)].max() == 0 and (before[(movie == 0) & (place >= 32)] == now[(movie == 0) & (place < 64)]).all()
            assert (before[(movie == 4) & (place >= 32)] == now[(movie == 4) & (place < 32)]).all()
