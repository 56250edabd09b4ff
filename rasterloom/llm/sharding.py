"""Resharding by minimum-cost flow: new shard sizes with the fewest bytes moved.

The sizes of the old shards and the capacities of the new ones make a small flow problem, solved on the driver: its
size depends on the numbers of shards only. The flow says how many bytes each old shard sends to each new one; blocks
of rows in hash order are cut to these amounts. As no row can be cut, there are three flows: rows larger than a shard's
even share (fewer than there are shards) go whole to one shard each, at the fewest bytes moved; then each old shard's
rows over the mean size and its others are supplies of their own of one flow, which places the former; then the flow
is solved again for the others: they fill the shards to one level above what the large ones left. All prefix sums go by
block, of which there are as many as the session has shuffle partitions, so no task holds a shard; rows are dealt to
blocks by their place in the input too, so equal ids and equal rows do not gather.

Nulls and edges: a null text has no bytes (size 1); a null id is a value like any other; repeated rows are placed once
each; an empty table gives an empty result; further columns are kept by rewrite() only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import columns, discard, materialise, shuffle_width


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """The cheapest flow from supplies to capacities (of equal sums, or larger), by successive shortest paths."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    left, price = {}, {}

    def arc(u: int, v: int, room: int, c: int) -> None:
        left[u, v], price[u, v] = room, c
        left.setdefault((v, u), 0)
        price[v, u] = -c

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    while True:
        far, by = {source: 0}, {}
        for _ in range(n + m + 2):  # Bellman-Ford: arcs back have negative prices
            changed = False
            for (u, v), room in left.items():
                if room > 0 and u in far and far[u] + price[u, v] < far.get(v, 1 << 62):
                    far[v], by[v], changed = far[u] + price[u, v], u, True
            if not changed:
                break
        if sink not in far:
            return [[left[n + j, i] for j in range(m)] for i in range(n)]
        path, v = [], sink
        while v != source:
            path.append((by[v], v))
            v = by[v]
        push = min(left[a] for a in path)
        for u, v in path:
            left[u, v] -= push
            left[v, u] += push


def level(total: int, have: list[int]) -> list[int]:
    """What brings all shards that have less to one level, `total` in all."""
    order, room = sorted(range(len(have)), key=lambda j: (have[j], j)), [0] * len(have)
    for n in range(len(order), 0, -1):  # the n emptiest shards share it
        each, more = divmod(total + sum(have[j] for j in order[:n]), n)
        if each >= have[order[n - 1]]:
            for k, j in enumerate(order[:n]):
                room[j] = each + (k < more) - have[j]
            break
    return room


def _cut(rows: DataFrame, amounts: dict[tuple[int, int], int]) -> DataFrame:
    """rows (old, block, doc_id, size, text_crc32) with a new shard each, in each old shard's hash order by these amounts."""
    spark = rows.sparkSession
    blocks = rows.groupBy("old", "block").agg(F.sum("size").alias("bytes"))
    before = blocks.select("old", "block", (F.sum("bytes").over(Window.partitionBy("old").orderBy("block")) - F.col("bytes")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("old", "block").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("inside", inside).join(before, ["old", "block"])
    middle = F.col("before") + F.col("inside") - F.col("size") / 2
    cuts, at = [], {}
    for (old, new), x in sorted(amounts.items(), key=lambda a: (a[0][0], a[0][0] != a[0][1], a[0][1])):  # what stays comes first
        if x > 0:
            cuts.append((old, new, at.get(old, 0)))
            at[old] = at.get(old, 0) + x
    # At most old x new rows; a row belongs to the last cut that starts at or before its middle.
    cut = spark.createDataFrame(cuts or [(-1, 0, 0)], "old int, new int, start long").groupBy("old").agg(F.sort_array(F.collect_list(F.struct("start", "new"))).alias("cuts"))
    chosen = F.element_at(F.filter("cuts", lambda c: c["start"] <= middle), -1)["new"]
    return placed.join(F.broadcast(cut), "old").select("old", "block", "doc_id", "size", "text_crc32", chosen.alias("shard"))


def reshard(docs: DataFrame, old: Column, old_shards: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, old, shard, slot): near-equal bytes in each of `shards` shards, the fewest moved.

    old: each row's present shard, 0 to old_shards - 1, of the input's columns. Shards keep their numbers.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), old.cast("int").alias("old"))
    width = shuffle_width(docs.sparkSession)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(width)).cast("int"))
    rows, at = materialise(rows, "sizes")
    n_rows, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    huge = rows.where(F.col("size") * shards > total).select("row", "old", "size").orderBy("row").collect()  # fewer than there are shards, or one
    flow = min_cost_flow([1] * len(huge), [1] * shards, [[0 if r["old"] == j else r["size"] for j in range(shards)] for r in huge])
    home = [(r["row"], f.index(1)) for r, f in zip(huge, flow)]
    have = [sum(r["size"] for r, (_, at_) in zip(huge, home) if at_ == j) for j in range(shards)]
    homes = F.broadcast(docs.sparkSession.createDataFrame(home or [(-1, 0)], "row long, shard int"))
    whole = rows.join(homes, "row").select("old", "block", "doc_id", "size", "text_crc32", "shard")
    rest, mean = rows.join(homes, "row", "left_anti").drop("row"), total // max(1, n_rows)
    large, small = rest.where(F.col("size") > mean), rest.where(F.col("size") <= mean)
    sums = rest.groupBy("old").agg(F.sum(F.when(F.col("size") > mean, F.col("size")).otherwise(0)).alias("large"), F.sum("size").alias("all")).collect()
    of = {r["old"]: (r["large"], r["all"] - r["large"]) for r in sums}
    of_large, of_small = ([of.get(i, (0, 0))[k] for i in range(old_shards)] for k in (0, 1))
    cost = [[int(i != j) for j in range(shards)] for i in range(old_shards)]
    amounts = lambda flow: {(i, j): x for i, line in enumerate(flow) for j, x in enumerate(line)}
    # Large and small rows are supplies of one flow; then the small ones' is solved for the room that whole large rows left.
    flow = min_cost_flow(of_large + of_small, level(sum(of_large + of_small), have), cost + cost)
    large, path = materialise(whole.unionByName(_cut(large, amounts(flow[:old_shards]))), "large")
    got = {r["shard"]: r["bytes"] for r in large.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    flow = min_cost_flow(of_small, level(sum(of_small), [got.get(j, 0) for j in range(shards)]), cost)
    placed, _ = materialise(large.unionByName(_cut(small, amounts(flow))), "placed")
    discard(docs.sparkSession, path)
    discard(docs.sparkSession, at)
    return _slots(placed)


def _slots(placed: DataFrame) -> DataFrame:
    """A gapless slot in each shard: the rows before this block's, and the place in the block."""
    group = ["shard", "old", "block"]
    counts = placed.groupBy(*group).agg(F.count("*").alias("n"))
    base = counts.select(*group, (F.sum("n").over(Window.partitionBy("shard").orderBy("old", "block")) - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "size", "text_crc32"))
    return placed.withColumn("place", place).join(base, group).select("doc_id", "size", "text_crc32", "old", "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"))


def rewrite(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> list[int]:
    """Rewrites, below path, the files of the shards that rows left or entered; the others stay as they are.

    placed: reshard()'s result, with unique ids. Gives the numbers of the shards written.
    """
    moved = placed.where("old <> shard").select(F.explode(F.array("old", "shard")).alias("s")).distinct()
    touched = sorted(r["s"] for r in moved.collect())  # no more than there are shards
    at = placed.where(F.col("shard").isin(touched)).select(F.col("doc_id").alias("_rl_id"), F.col("shard").alias("_rl_shard"), F.col("slot").alias("_rl_slot"))
    out = docs.join(at, docs[id_col].eqNullSafe(at["_rl_id"])).drop("_rl_id")
    out.repartition("_rl_shard", F.col("_rl_slot") % shuffle_width(docs.sparkSession)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_rl_shard").parquet(path)
    return touched
