"""Rasterloom: byte-grid frames, fixed-rate opcode streams and their distances as Spark DataFrames."""
