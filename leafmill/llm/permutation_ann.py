"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, found once for each. A block of the index posts its vectors in
one inverted file per pivot, with the pivot's place in the vector's order. A query reads the files of its own pivots
only and adds up what they give; the sum orders the vectors as the footrule distance between the orders of pivots
does. The nearest share of each block is reranked by the inner product itself.

Lengths count for inner products, so rows are lifted to the unit sphere: one more component makes the nearest row
the one of the largest inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import stored
from leafmill.llm.vectors import QUERIES_IN_BLOCK, ROWS_IN_BLOCK, best, blocks, by_dimension, cells, clean, matrix, ranked, sent, spread


def lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    inside = rows / longest
    rest = np.sqrt(np.maximum(0.0, 1 - (inside**2).sum(1)))
    return np.hstack([inside, rest[:, None]])


def far_apart(sample: np.ndarray, number: int) -> np.ndarray:
    """Pivots from a sample, each the one least similar to those before it."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(number, len(sample)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def nearest_pivots(points: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    return np.argsort(-(points @ pivots.T), axis=1, kind="stable")[:, :length]


class InvertedFiles:
    """For each pivot the rows that have it among their nearest, and its weight: length minus place."""

    def __init__(self, orders: np.ndarray, pivots: int, length: int):
        self.rows, self.length = len(orders), length
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.row = by_pivot // orders.shape[1]
        self.weight = (length - by_pivot % orders.shape[1]).astype("i4")
        self.bounds = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """A constant minus half of the footrule distance, where a pivot that is not among the nearest has the
        place after them."""
        total = np.zeros(self.rows, "i4")
        for place, pivot in enumerate(order):
            low, high = self.bounds[pivot], self.bounds[pivot + 1]
            total[self.row[low:high]] += np.minimum(self.length - place, self.weight[low:high])
        return total


def permuted(vectors: DataFrame, d: int, pivots: np.ndarray, length: int, longest: float, lift: bool) -> DataFrame:
    """Adds places: the nearest pivots of each vector in order, as 16-bit integers."""

    def run(batches):
        for batch in batches:
            values = matrix(batch.column("embedding"), d)
            points = lifted(values, longest) if lift else np.hstack([values / np.linalg.norm(values, axis=1, keepdims=True), np.zeros((len(values), 1))])
            order = nearest_pivots(points, pivots, length).astype("<u2")
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "embedding": batch.column("embedding"), "places": pa.array([row.tobytes() for row in order], pa.binary())})

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, places binary")


def near(vectors: DataFrame, d: int, n: int, q: int, every: int, k: int, pivots: int, length: int, share: float, least: int, sample: int) -> DataFrame:
    """(query_id, vec_id, score) of vectors of one dimension: the k best of each block."""
    longest = vectors.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    some = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "embedding").limit(sample).select("embedding").toArrow()
    chosen = far_apart(lifted(matrix(some.column("embedding"), d), longest), pivots)
    places = min(length, len(chosen))
    row_blocks, query_blocks = blocks(n, ROWS_IN_BLOCK), blocks(q, QUERIES_IN_BLOCK)
    kind = "qb long, rb long, part int, vec_id long, embedding array<double>, places binary"

    def to_cells(part: int):
        """A row goes to its block for each block of queries, a query to each block of rows."""

        def run(batches):
            for batch in batches:
                ids, own = batch.column("vec_id").to_numpy(), np.array(batch.column("places").to_pylist(), dtype=object)
                mine, others = spread(ids, (row_blocks, query_blocks)[1 - part]), (query_blocks, row_blocks)[1 - part]
                for at in range(others):
                    other = np.full(len(ids), at)
                    yield sent(batch, part, np.arange(len(ids)), *((other, mine) if part else (mine, other)), places=own)

        return run

    def search(asked, rows):
        ids, values = rows.column("vec_id").to_numpy(), matrix(rows.column("embedding"), d)
        files = InvertedFiles(np.frombuffer(b"".join(rows.column("places").to_pylist()), "<u2").reshape(-1, places).astype("i8"), len(chosen), places)
        orders = np.frombuffer(b"".join(asked.column("places").to_pylist()), "<u2").reshape(-1, places)
        number = min(len(ids), max(int(np.ceil(share * len(ids))), least, k + 1))
        out_q, out_v, out_s = [], [], []
        for query_id, query, order in zip(asked.column("vec_id").to_numpy(), matrix(asked.column("embedding"), d), orders, strict=True):
            close = files.closeness(order)
            found = np.argpartition(-close, number - 1)[:number] if number < len(ids) else np.arange(len(ids))
            found = found[ids[found] != query_id]
            scores = values[found] @ query
            top = best(scores, ids[found], k)
            out_q.append(np.full(len(top), query_id))
            out_v.append(ids[found][top])
            out_s.append(scores[top])
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)

    index = stored(permuted(vectors, d, chosen, places, longest, lift=True), "permutations")
    asked = permuted(vectors.where(F.col("vec_id") % every == 0), d, chosen, places, longest, lift=False)
    return cells(index.mapInArrow(to_cells(1), kind), asked.mapInArrow(to_cells(0), kind), row_blocks * query_blocks, d, search, "double")


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, pivots: int = 512, length: int = 64, share: float = 0.1, least: int = 128, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest to each row whose vec_id is divisible by every.

    Pivots come from a sample of `sample` rows, those with the least hash of vec_id; every row is indexed. `share` of
    each block, by footrule distance, but `least` rows at least, is reranked in double precision. Vectors that are
    null, zero or hold null or non-finite components take no part; a vector meets those of its own dimension. Every row
    is a candidate, also where a vec_id repeats, but for the query's own id; ties go to smaller ids; fewer candidates
    give fewer rows; an empty table gives none. Other columns are ignored.
    """
    vectors = clean(embeddings, nonzero=True)
    found = by_dimension(vectors, F.col("vec_id") % every == 0, lambda v, d, n, q: near(v, d, n, q, every, k, pivots, length, share, least, sample), "double")
    return ranked(found, k)
