"""Frames from text: a document is a movie whose frames hold 7680 characters each, one per visible byte.

A page is one row with its 256 bytes as an array, so packing and neighbours need no shuffle. Pages are cut in numpy, a
text at a time; packed_hgr and packed_dhgr are the same packing in SQL, for pages from elsewhere. Address a of a frame is
visible unless (a & 127) >= 120, so a page holds 240 characters. Pages beyond the text are blank and are not listed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import bits
from rasterloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(docs: DataFrame, mode: str, schema: str, found) -> DataFrame:
    """(movie, frame, page) and the arrays that found(layout, pages) gives, of every page with text."""
    ship(docs.sparkSession)
    movies = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("movie"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from rasterloom.functions.layouts import Layout

        layout, names = Layout(mode), [c.split()[0] for c in schema.split(", ")]
        size = 240 * layout.banks * 1024
        for b in batches:
            for movie, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                for at in range(0, len(text), size):
                    pages = layout.pages(text[at : at + size])
                    place = np.arange(len(pages)) + at // (240 * layout.banks)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(pages) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in found(layout, pages)]
                    yield pa.record_batch([pa.array([movie] * len(pages), pa.int64()), pa.array((place // 32).astype(np.int32)), pa.array((place % 32).astype(np.int32)), *lists], names)

    return movies.mapInArrow(run, schema)


def hgr_pages(docs: DataFrame) -> DataFrame:
    """(movie, frame, page, cells)."""
    return _pages(docs, "HGR", "movie long, frame int, page int, cells array<long>", lambda layout, pages: [pages[:, 0]])


def dhgr_pages(docs: DataFrame) -> DataFrame:
    """(movie, frame, page, main, aux): 240 characters for the main bank, then 240 for the auxiliary one; 7 bits each."""
    return _pages(docs, "DHGR", "movie long, frame int, page int, main array<long>, aux array<long>", lambda layout, pages: [pages[:, 0], pages[:, 1]])


def packed_pages(docs: DataFrame, mode: str = "HGR") -> DataFrame:
    """(movie, frame, page, packed): the 128 packed columns of every page with text."""
    return _pages(docs, mode, "movie long, frame int, page int, packed array<long>", lambda layout, pages: [layout.pack(pages)])


def pack_hgr(cells: str) -> Column:
    """128 packed columns of a page's cells; blank beyond both ends."""
    body = f"transform(sequence(0, 127), c -> {bits.hgr_body(f'{cells}[2 * c]', f'{cells}[2 * c + 1]')})"
    return F.expr(body)


def framed(bodies: str, mode: str) -> Column:
    """Packed columns of bodies, with header and footer from the neighbours in the page."""
    header, footer = (bits.hgr_header, bits.hgr_footer) if mode == "HGR" else (bits.dhgr_header, bits.dhgr_footer)
    left, right = f"coalesce(get({bodies}, c - 1), 0L)", f"coalesce(get({bodies}, c + 1), 0L)"
    return F.expr(f"transform(sequence(0, 127), c -> {bodies}[c] + ({header(left)}) + ({footer(right)}))")


def packed_hgr(pages: DataFrame, cells: str = "cells", out: str = "packed") -> DataFrame:
    """Adds the packed columns. explode keeps an array from being computed again for each use."""
    keep = [c for c in pages.columns]
    bodies = pages.select(*keep, F.explode(F.array(pack_hgr(cells))).alias("_bodies"))
    return bodies.select(*keep, F.explode(F.array(framed("_bodies", "HGR"))).alias(out))


def packed_dhgr(pages: DataFrame) -> DataFrame:
    body = bits.dhgr_body("aux[2 * c]", "main[2 * c]", "aux[2 * c + 1]", "main[2 * c + 1]")
    bodies = pages.select("movie", "frame", "page", F.explode(F.array(F.expr(f"transform(sequence(0, 127), c -> {body})"))).alias("_bodies"))
    return bodies.select("movie", "frame", "page", F.explode(F.array(framed("_bodies", "DHGR"))).alias("packed"))


#: DuckDB: every non-blank cell (movie, frame, page, off, value) of the frames.
SQL_CELLS = """chars AS (SELECT doc_id AS movie, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM documents WHERE text <> ''),
cells AS (SELECT movie, i // 7680 AS frame, i % 7680 // 240 AS page, i % 240 + CASE WHEN i % 240 >= 120 THEN 8 ELSE 0 END AS off, (unicode(ch) & 255)::BIGINT AS value FROM chars)"""
#: DuckDB: (movie, frame, page, col, packed) of every column of the pages that have text.
SQL_PACKED = f"""{SQL_CELLS},
bodies AS (SELECT movie, frame, page, off // 2 AS col, sum(CASE WHEN off % 2 = 0 THEN value << 3 ELSE ((value & 127) << 12) + ((value & 128) << 4) END)::BIGINT AS body FROM cells GROUP BY ALL),
grid AS (SELECT p.*, c.range AS col, coalesce(b.body, 0) AS body FROM (SELECT DISTINCT movie, frame, page FROM cells) p CROSS JOIN range(128) c LEFT JOIN bodies b ON b.movie = p.movie AND b.frame = p.frame AND b.page = p.page AND b.col = c.range),
packed AS (SELECT movie, frame, page, col, body + {bits.hgr_header("coalesce(lag(body) OVER w, 0)")} + ({bits.hgr_footer("coalesce(lead(body) OVER w, 0)")}) AS packed FROM grid WINDOW w AS (PARTITION BY movie, frame, page ORDER BY col))"""
#: DuckDB: the same for DHGR; bank 0 is the main one. A column's bytes are, by address: aux even, main even, aux odd, main odd.
SQL_CELLS_DHGR = """chars AS (SELECT doc_id AS movie, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM documents WHERE text <> ''),
cells AS (SELECT movie, i // 15360 AS frame, i % 15360 // 480 AS page, i % 480 // 240 AS bank, i % 240 + CASE WHEN i % 240 >= 120 THEN 8 ELSE 0 END AS off, (unicode(ch) & 127)::BIGINT AS value FROM chars)"""
SQL_PACKED_DHGR = f"""{SQL_CELLS_DHGR},
bodies AS (SELECT movie, frame, page, off // 2 AS col, sum(value << (3 + 7 * (2 * (off % 2) + 1 - bank)))::BIGINT AS body FROM cells GROUP BY ALL),
grid AS (SELECT p.*, c.range AS col, coalesce(b.body, 0) AS body FROM (SELECT DISTINCT movie, frame, page FROM cells) p CROSS JOIN range(128) c LEFT JOIN bodies b ON b.movie = p.movie AND b.frame = p.frame AND b.page = p.page AND b.col = c.range),
packed AS (SELECT movie, frame, page, col, body + ({bits.dhgr_header("coalesce(lag(body) OVER w, 0)")}) + ({bits.dhgr_footer("coalesce(lead(body) OVER w, 0)")}) AS packed FROM grid WINDOW w AS (PARTITION BY movie, frame, page ORDER BY col))"""
