"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is the hash of an item's tokens at a mask's positions; the others are ignored, so a substitution there does not
hide the hit. Documents' seeds meet the benchmark's in one join. While the benchmark's seeds are few they are broadcast,
and each hit is verified in place; beyond that, places and seeds alone are shuffled, and a document's tokens come back
once for each of its diagonals. On a hit's diagonal, some window of `window` tokens must agree in all but `misses`. The two masks hit every window of 13 tokens with up to 2 substitutions, and every shorter
item from 9 tokens up with one.

Nulls and edges: null and empty texts have no tokens and no overlap; items of fewer than `least` tokens are ignored,
items shorter than the window are compared whole, with one miss allowed; null ids give null ids; repeated rows are
found each, as one row of the result for equal ids; empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise

#: Positions that count; the gaps are ignored. Any two of 13 tokens, or one of 9, can differ and one mask still fits.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 2, 4, 5))
#: Benchmark seeds that are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: str) -> Column:
    """Runs of letters, digits and characters outside ASCII; A-Z are lower-cased, nothing else."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), SEPARATORS), "")


def _hashed(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(name, words): the hash of each token. explode keeps the words from being computed again per use."""
    plain = df.select(F.col(f"`{id_col}`").cast("long").alias(name), F.col(f"`{text_col}`").cast("string").alias("t"))
    return plain.select(name, F.explode(F.array(F.transform(tokens("t"), lambda w: F.xxhash64(w)))).alias("words"))


def _seeds(hashed: DataFrame, *keep: str) -> DataFrame:
    """One row per position and mask: its seed and the position."""
    n = len(MASKS)
    spans = F.size("words") - (min(m[-1] for m in MASKS))
    slot = hashed.where(spans > 0).select(*keep, "words", F.explode(F.sequence(F.lit(0), n * spans - 1)).alias("slot"))
    at = (F.col("slot") / n).cast("int")
    seed = F.lit(None)
    for i, mask in enumerate(MASKS):
        seed = F.when(F.col("slot") % n == i, F.xxhash64(F.lit(i), *[F.get("words", at + o) for o in mask])).otherwise(seed)
    return slot.select(*keep, "words", at.alias("at"), seed.alias("seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, misses: int = 2, least: int = 9, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, window): the best agreeing window of each document with each item it overlaps."""
    items = _hashed(benchmark, item_col, item_text_col, "item_id").where(F.size("words") >= least)
    items = items.select("item_id", F.col("words").alias("item"), F.monotonically_increasing_id().alias("row"))
    known = _seeds(items.select("row", F.col("item").alias("words")), "row").select("seed", "row", F.col("at").alias("item_at"))
    hashed, length = _hashed(docs, id_col, text_col, "doc_id"), F.least(F.size("item"), F.lit(window))
    if known.count() <= BROADCAST_SEEDS:
        hits = _seeds(hashed, "doc_id").join(F.broadcast(known), "seed").select("doc_id", "words", "row", (F.col("at") - F.col("item_at")).alias("shift"), "item_at")
        both = hits.join(F.broadcast(items), "row")
        # The item's tokens that a window through the hit can hold.
        least_at, most_at = F.col("item_at") - window + 1, F.col("item_at") + window + max(m[-1] for m in MASKS)
    else:
        hashed, _ = materialise(hashed.withColumn("doc", F.monotonically_increasing_id()), "tokens")
        hits = _seeds(hashed, "doc").select("doc", "at", "seed").join(known, "seed").select("doc", "row", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
        both = hits.join(hashed, "doc").join(items, "row")
        least_at, most_at = F.lit(0), F.size("item")
    first = F.greatest(F.lit(0), least_at, -F.col("shift"))
    last = F.least(F.size("item"), F.size("words") - F.col("shift"), most_at) - 1
    cut = both.select("doc_id", "item_id", length.alias("window"), F.slice("item", first + 1, last - first + 1).alias("x"), F.slice("words", first + F.col("shift") + 1, last - first + 1).alias("y"))
    same = F.zip_with("x", "y", lambda a, b: (a == b).cast("int"))
    cut = cut.where(F.size("x") >= F.col("window")).select("doc_id", "item_id", "window", F.explode(F.array(same)).alias("same"))
    starts = F.sequence(F.lit(1), F.size("same") - F.col("window") + 1)
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice("same", s, F.col("window")), F.lit(0), lambda a, b: a + b)))
    found = cut.select("doc_id", "item_id", "window", best.alias("matched"))
    allowed = F.when(F.col("window") < window, F.lit(min(1, misses))).otherwise(F.lit(misses))
    return found.where(F.col("matched") >= F.col("window") - allowed).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The documents that overlap no item, with all their columns; rows with a null id are judged together."""
    bad = overlaps(docs, benchmark, id_col=id_col, **settings).select(F.col("doc_id").alias("_rl_id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_rl_id"]), "left_anti")
