"""What the vector searches share: clean vectors, cells of a block of queries and a block of rows, and the final ranks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import grouped, runs, stored

ROWS_IN_BLOCK, QUERIES_IN_BLOCK = 8192, 16_384
MOST_PARTITIONS = 10_000  # of the cells; a task works through several where there are more


def clean(embeddings: DataFrame, nonzero: bool, values: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(vec_id, embedding as doubles, d) as a table.

    Vectors that are null or hold null or non-finite components take no part, nor zero ones if nonzero, nor those
    without vec_id. Every other row takes part, also where a vec_id repeats. values is applied to each component.
    """
    cast = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = cast.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    if nonzero:
        good = good.where(F.exists("embedding", lambda x: x != 0))
    return stored(good.select("vec_id", F.transform("embedding", values).alias("embedding"), F.size("embedding").alias("d")), "vectors")


def by_dimension(vectors: DataFrame, is_query: Column, search: Callable[[DataFrame, int, int, int], DataFrame], kind: str) -> DataFrame:
    """search(vectors, d, rows, queries) for each dimension: only vectors of one dimension have a product."""
    found = vectors.sparkSession.createDataFrame([], f"query_id long, vec_id long, score {kind}")
    for r in vectors.groupBy("d").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).orderBy("d").collect():
        if r["q"]:
            found = found.unionByName(search(vectors.where(F.col("d") == r["d"]), r["d"], r["n"], r["q"]))
    return found


def matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, d)


def blocks(number: int, size: int) -> int:
    return max(1, math.ceil(number / size))


def spread(vec_id: np.ndarray, number: int) -> np.ndarray:
    """A block below number for each id."""
    mixed = vec_id.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(max(number, 1))).astype("i8")


def sent(batch: pa.RecordBatch, part: int, row: np.ndarray, query_block: np.ndarray, row_block: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch, each to its cell."""
    taken = batch.select(["vec_id", "embedding"]).take(pa.array(row))
    columns = {"qb": query_block.astype("i8"), "rb": row_block.astype("i8"), "part": np.full(len(row), part, "i4")}
    columns = {k: pa.array(v) for k, v in columns.items()} | {n: taken.column(n) for n in ("vec_id", "embedding")} | {k: pa.array(v[row]) for k, v in more.items()}
    return pa.RecordBatch.from_pydict(columns)


def cells(rows: DataFrame, asked: DataFrame, number: int, d: int, search: Callable, score_type: str) -> DataFrame:
    """search(asked table, rows table) -> (query_ids, ids, scores) for each cell (qb, rb) of queries (part 0) and rows (part 1)."""
    keys = ["qb", "rb"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            for begin, end in zip(*runs(table, keys), strict=True):
                cell = table.slice(begin, end - begin)
                asks = cell.column("part").to_numpy() == 0
                if not asks.any() or asks.all():
                    continue
                found = search(cell.filter(pa.array(asks)), cell.filter(pa.array(~asks)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    dealt = rows.unionByName(asked).repartition(max(1, min(number, MOST_PARTITIONS)), *keys).sortWithinPartitions(*keys, "part", "vec_id")
    return dealt.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= least)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))[:k]]
