"""A uniform shuffle of rows into shards of exact size, planned by a hypergeometric communication matrix.

How many rows go from each input partition to each shard is drawn first, by the law that a uniform permutation of all
rows implies (each partition's counts are multivariate hypergeometric in the places that are left). Then partitions
permute their rows on their own and cut them by those counts, rows are exchanged once, and shards permute again.
Shard sizes are exact before a row moves. The driver holds partitions x shards counts, not rows.
"""

from __future__ import annotations

from math import exp, lgamma

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitide.llm.tables import durable

SHARDS = 40
CELL_ROWS = 20_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among the draws; numpy's own below its limit of 10**9, else inversion outwards from the mode."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, up, down, pu, pd = rng.random() - p, mode, mode, p, p
    while u >= 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if (u := u - pu) < 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if (u := u - pd) < 0:
                return down
    return mode


def communication_matrix(partitions: list[int], shards: list[int], seed: int = 0) -> np.ndarray:
    """Counts by partition and shard with these row and column sums, as a uniform permutation would give them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = list(shards)
    matrix = np.zeros((len(partitions), len(shards)), np.int64)
    for p, draws in enumerate(partitions):
        rest = sum(left)
        for s, places in enumerate(left):
            rest -= places
            matrix[p, s] = n = _hypergeometric(rng, places, rest, draws)
            draws -= n
            left[s] = places - n
    return matrix


def shard_rows(rows: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """All rows and columns of ``rows`` plus ``shard`` (0 to shards-1) and ``slot`` (0 to the shard's size - 1, no gaps).

    Shard sizes are at most one apart, larger ones first. Every arrangement is equally likely up to the quality of
    the 64-bit row hashes that order rows; rows equal in all columns are interchangeable. Nulls are hashed like
    values, maps by their text as JSON. With fewer rows than shards the last shards are empty; an empty table gives an empty
    result. Columns named ``shard`` or ``slot`` are replaced; others may have any name and type.
    """
    kept = rows.drop("shard", "slot")
    own = [F.col(f"`{c}`") for c in kept.columns]
    plain = [F.to_json(F.struct(c)) if "map<" in t or t == "variant" else c for c, (_, t) in zip(own, kept.dtypes)]  # a map has no hash
    hashes = [F.xxhash64(F.lit(f"{use} {seed}"), *plain) for use in ("local", "shard", "tie")]
    # A row travels as one column, so no name of its own can clash. Partitions must hold the same rows when counted and cut.
    rows = durable(kept.select(F.struct(*own).alias("row"), F.array(*hashes).alias("keys")))
    spark = rows.sparkSession
    counts = dict(rows.groupBy(F.spark_partition_id().alias("p")).count().collect())
    total = sum(counts.values())
    if not total:
        return rows.select("row.*", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    order = sorted(counts)
    ends = communication_matrix([counts[p] for p in order], sizes, seed).cumsum(1)
    plan = spark.createDataFrame([(p, e.tolist()) for p, e in zip(order, ends)], "p int, ends array<long>")  # a row for each partition
    mixed = rows.sortWithinPartitions(F.col("keys")[0], F.col("keys")[2])
    placed = mixed.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    placed = placed.join(F.broadcast(plan), "p").withColumn("shard", F.expr("cast(size(filter(ends, e -> e <= at)) as int)"))

    cells = max(1, -(-total // (shards * CELL_ROWS)))  # a shard is ordered in parts, ranges of a second random key
    placed = placed.withColumn("cell", F.expr(f"cast(shiftrightunsigned(keys[1], 33) * {cells} >> 31 as int)"))
    by_cell = Window.partitionBy("shard", "cell").orderBy(F.col("keys")[1], F.col("keys")[2])  # equal rows only are equal in both
    ranked = placed.withColumn("within", F.row_number().over(by_cell))
    if cells == 1:
        slotted = ranked.withColumn("slot", F.col("within").cast("long") - 1)
    else:
        in_cells = placed.groupBy("shard", "cell").count()
        before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        starts = in_cells.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
        slotted = ranked.join(starts, ["shard", "cell"]).withColumn("slot", F.col("before") + F.col("within") - 1)
    return slotted.select("row.*", "shard", "slot")
