"""Every query of the library with its SQL: name -> callable(spark, sf_dir), name -> DuckDB text."""

from __future__ import annotations

from rasterloom.plans import book, machine, screen, stream  # noqa: F401  (their import registers the queries)

FLAGSHIP = "diff_weights"
QUERIES = book.QUERIES
SQL = book.SQL
