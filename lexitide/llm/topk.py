"""Exact top-k inner products with a vector-approximation file.

Two tables are kept: the exact integer vectors, a row each, and the approximation file, blocks of quantised cells of one
byte a component. For a query the cells of a block bound every score from below and above. The scan reads cells only: of
each query it passes on the vectors whose upper bound reaches the kth largest lower bound met so far. Exact vectors are
then fetched by key, those of the best bounds first; once k exact scores are known only vectors whose upper bound reaches
the kth of them are fetched too, so the result is certain.

Query blocks meet cell blocks by salt; a task takes one query block after another, so it holds one block's bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitide.llm.tables import durable

BLOCK, QUERY_BLOCK, CELLS = 1024, 512, 256
#: Exact vectors are fetched in two turns: this many times k of the best bounds, then all that may still count.
FIRST = 4
_BLOCKS = "dim int, n int, ids binary, keys binary, data binary, low binary, width binary"
_SCHEMA = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "keys", "data", "low", "width"))])


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as integers; vectors with a null or non-finite one go."""
    for batch in batches:
        vectors = batch.column(1)
        values, n = np.floor(1024 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), vectors.value_lengths().to_numpy(zero_copy_only=False)
        whose = np.repeat(np.arange(len(n)), n)
        good = np.bincount(whose[~np.isfinite(values)], minlength=len(n)) == 0  # a null component is NaN here
        kept = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n[good]))).astype(np.int32), pa.array(values[good[whose]].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), kept], names=["id", "v"])


def _pack(size: int, quantised: bool):
    """Blocks of ``size`` equally long vectors, as cells or as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, keys, rows = zip(*held.pop(dim))
            data = np.stack(rows).astype(np.float64)
            low = data.min(0, initial=np.inf, where=True) if dim else np.zeros(0)
            width = np.maximum(1, np.ceil((data.max(0) - low + 1) / CELLS)) if dim else np.zeros(0)
            kept = ((data - low) // width).astype(np.uint8) if quantised else data
            parts = [np.array(ids, np.int64), np.array(keys, np.int64), kept, low, width]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], schema=_SCHEMA)

        for batch in batches:
            values, n = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
            for i, key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.split(values, np.cumsum(n)[:-1])):
                held.setdefault(len(own), []).append((i, key, own))
                if len(held[len(own)]) == size:
                    yield block(len(own))
        for dim in list(held):
            yield block(dim)

    return run


def _bounds(k: int):
    """Of each query the vectors whose upper bound reaches the kth largest lower bound of the cells read so far."""
    schema = pa.schema([("q_id", pa.int64()), ("q_key", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best = None, np.zeros((0, 0))
        for batch in batches:
            for row in batch.to_pylist():  # a row is a block of cells and a block of queries
                dim, n, m = row["dim"], row["n"], row["q_n"]
                ids, keys, q_ids, q_keys = (np.frombuffer(row[c], np.int64) for c in ("ids", "keys", "q_ids", "q_keys"))
                low, width = np.frombuffer(row["low"]), np.frombuffer(row["width"])
                cells, queries = np.frombuffer(row["cells"], np.uint8).reshape(n, dim), np.frombuffer(row["q_vectors"]).reshape(m, dim)
                if row["q_block"] != current:
                    current, best = row["q_block"], np.full((m, k), -np.inf)
                scaled = (queries * width).astype(np.float32)
                middle = (queries @ low)[:, None] + (scaled @ cells.astype(np.float32).T).astype(np.float64)
                slack = np.abs(queries) @ (width * CELLS) * (dim + 4) * 2.0**-23 + 1  # of the products in single precision
                spread = queries * (width - 1)
                lower = middle + (np.minimum(spread, 0).sum(1) - slack)[:, None]
                upper = middle + (np.maximum(spread, 0).sum(1) + slack)[:, None]
                own = q_ids[:, None] == ids[None, :]
                lower[own], upper[own] = -np.inf, -np.inf
                top = np.concatenate((best, lower), 1)
                best = np.partition(top, top.shape[1] - k, 1)[:, -k:]
                a, b = np.nonzero((upper >= best.min(1)[:, None]) & ~own)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[a], q_keys[a], ids[b], keys[b], lower[a, b], upper[a, b])], schema=schema)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k largest inner products of floor(1024 * x).

    Ties go to the smaller id. A query is compared with all rows but those of its own id, of equally long vectors. Rows
    with a null id, a null vector, or a null or non-finite component take no part. Repeated rows count once. With
    fewer than k candidates all are returned; empty tables give an empty result. Scores must fit a long.
    """
    spark = rows.sparkSession
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def exact(df: DataFrame) -> DataFrame:
        known = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return known.mapInArrow(_integers, "id long, v array<long>").dropDuplicates().select("id", F.xxhash64("id", "v").alias("key"), "v")

    vectors, asking = durable(exact(rows)), durable(exact(queries))
    cells = vectors.mapInArrow(_pack(BLOCK, True), _BLOCKS).withColumnRenamed("data", "cells").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    blocks = asking.coalesce(8).mapInArrow(_pack(QUERY_BLOCK, False), _BLOCKS).select("dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("data").alias("q_vectors"), F.xxhash64("keys").alias("q_block"))
    asked = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = cells.join(asked.hint("shuffle_hash"), ["salt", "dim"]).select("dim", "n", "ids", "keys", "cells", "low", "width", "q_block", "q_n", "q_ids", "q_keys", "q_vectors")
    bounds = durable(met.sortWithinPartitions("q_block").mapInArrow(_bounds(k), "q_id long, q_key long, id long, key long, lower double, upper double"))
    kth = lambda df, value: df.withColumn("__n", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc(value)))).where(F.col("__n") == k).select("q_id", F.col(value).alias("least"))
    left = bounds.join(kth(bounds, "lower"), "q_id", "left").where("least is null or upper >= least").drop("least")
    left = durable(left.withColumn("turn", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("upper"), "id", "key"))))

    def scored(part: DataFrame) -> DataFrame:
        both = part.select("q_id", "q_key", "id", "key").join(vectors, ["id", "key"]).join(asking.select(F.col("id").alias("q_id"), F.col("key").alias("q_key"), F.col("v").alias("q_v")), ["q_id", "q_key"])
        return both.select("q_id", "id", F.aggregate(F.zip_with("v", "q_v", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x).alias("score"))

    near = durable(scored(left.where(F.col("turn") <= FIRST * k)))
    more = left.where(F.col("turn") > FIRST * k).join(kth(near.distinct(), "score"), "q_id").where("upper >= least")
    found = near.unionByName(scored(more)).distinct()
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q_id").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
