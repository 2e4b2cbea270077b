"""Exact top-k search for inner products: rows by descending length, pruned by Cauchy-Schwarz bounds.

Vectors become whole numbers, so scores are exact. The eigenvectors of the second moments (the right singular
vectors of the table) rotate all vectors, so that the first coordinates hold most of a product. Rows are met in
descending length: the table is cut into ranges of length, and each query first meets a block of the longest rows,
whose k-th best score bounds its result from below. It then goes only to the ranges whose longest row could reach
that. Within them a row is left out for a query as soon as the product of the first coordinates plus the product of
the lengths of the rest, an upper bound, is below the query's k-th best score so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import stored
from leafmill.llm.vectors import QUERIES_IN_BLOCK, ROWS_IN_BLOCK, best, blocks, by_dimension, cells, clean, matrix, ranked, sent, spread

PORTION, QUERIES_AT_ONCE = 1024, 512
MOST_RANGES = 1000  # of length; a range of more rows than a block has several blocks
STAGES = 4


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the sum of x xT, largest first; each partition sums its own, d x d numbers at a time."""

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            values = matrix(batch.column("embedding"), d)
            total += values.T @ values
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype="i4")), pa.array(total.ravel())], names=["place", "value"])

    parts = vectors.select("embedding").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    moments = np.zeros(d * d)
    for row in parts.collect():  # d x d rows, whatever the table
        moments[row["place"]] = row["value"]
    return np.linalg.eigh(moments.reshape(d, d))[1][:, ::-1]


def search_block(query_ids, queries, ids, rows, turn: np.ndarray, k: int, least: np.ndarray | None = None):
    """Exact top-k of each query in a block, but for scores below least, where given."""
    out = []
    for begin in range(0, len(query_ids), QUERIES_AT_ONCE):
        part = slice(begin, begin + QUERIES_AT_ONCE)
        out.append(search_some(query_ids[part], queries[part], ids, rows, turn, k, np.full(len(query_ids[part]), -np.inf) if least is None else least[part].copy()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search_some(query_ids, queries, ids, rows, turn: np.ndarray, k: int, least: np.ndarray):
    d = rows.shape[1]
    length = np.sqrt((rows**2).sum(1))
    order = np.lexsort((ids, -length))
    ids, rows, length = ids[order], rows[order], length[order]
    whole_rows, whole_queries = rows.astype("i8"), queries.astype("i8")
    turned, asked = rows @ turn, queries @ turn
    query_length = np.sqrt((queries**2).sum(1))
    stops = sorted({max(1, round(d * s / STAGES)) for s in range(1, STAGES + 1)})
    # The lengths of what lies beyond each stop.
    rest_rows = [np.sqrt(np.maximum(0, (turned[:, s:] ** 2).sum(1))) for s in stops]
    rest_queries = [np.sqrt(np.maximum(0, (asked[:, s:] ** 2).sum(1))) for s in stops]
    top = [(np.zeros(0, "i8"), np.zeros(0, "i8")) for _ in query_ids]
    for begin in range(0, len(ids), PORTION):
        part = slice(begin, begin + PORTION)
        # Rounding is far below this much of a product of lengths.
        slack = 1e-9 * query_length * length[begin] + 1e-6
        open_queries = np.flatnonzero(query_length * length[begin] + slack >= least)
        if not len(open_queries):
            break
        place_q = np.repeat(open_queries, len(ids[part]))
        place_r = np.tile(np.arange(begin, min(begin + PORTION, len(ids))), len(open_queries))
        partial = np.zeros(len(place_q))
        done = 0
        for at, stop in enumerate(stops):
            if at == 0:
                partial = (asked[open_queries, :stop] @ turned[part, :stop].T).ravel()
            else:
                partial = partial + np.einsum("ij,ij->i", asked[place_q, done:stop], turned[place_r, done:stop])
            keep = partial + rest_queries[at][place_q] * rest_rows[at][place_r] + slack[place_q] >= least[place_q]
            place_q, place_r, partial, done = place_q[keep], place_r[keep], partial[keep], stop
        if len(partial) and np.abs(partial).max() > 2.0**62:
            raise OverflowError("a score beyond 64 bits")
        other = query_ids[place_q] != ids[place_r]
        place_q, place_r = place_q[other], place_r[other]
        scores = np.concatenate([np.einsum("ij,ij->i", whole_queries[place_q[i : i + 65536]], whole_rows[place_r[i : i + 65536]]) for i in range(0, len(place_q), 65536)] or [np.zeros(0, "i8")])
        bounds = np.searchsorted(place_q, np.arange(len(query_ids) + 1))
        for q in np.unique(place_q):
            low, high = bounds[q], bounds[q + 1]
            both = np.concatenate([top[q][0], scores[low:high]]), np.concatenate([top[q][1], ids[place_r[low:high]]])
            chosen = best(*both, k)
            top[q] = both[0][chosen], both[1][chosen]
            if len(chosen) == k:
                least[q] = max(least[q], top[q][0][-1])
    return (
        np.repeat(query_ids, [len(t[0]) for t in top]),
        np.concatenate([t[1] for t in top]),
        np.concatenate([t[0] for t in top]),
    )


def longest_first(vectors: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the ranges of length, longest first: their lower bounds, their longest row's length, their numbers of rows."""
    number = min(MOST_RANGES, blocks(n, ROWS_IN_BLOCK))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    at = [i / number for i in range(number - 1, 0, -1)]
    cuts = vectors.select(F.percentile_approx(length, at, 10_000).alias("cuts")).first()["cuts"] if at else []
    bounds = np.array([*cuts, -1.0])
    ranges = F.lit(0)
    if at:
        ranges = F.aggregate(F.lit(cuts).cast("array<double>"), F.lit(0), lambda a, c: a + (length < c).cast("int"))
    rows = vectors.select(ranges.alias("r"), length.alias("l")).groupBy("r").agg(F.max("l").alias("longest"), F.count("*").alias("n")).collect()
    longest, counts = np.zeros(number), np.zeros(number, "i8")
    for r in rows:
        longest[r["r"]], counts[r["r"]] = r["longest"], r["n"]
    return bounds, longest, counts


def products(vectors: DataFrame, d: int, n: int, q: int, every: int, k: int) -> DataFrame:
    """(query_id, vec_id, score), the k largest at least, of vectors of one dimension."""
    turn = rotation(vectors, d)
    bounds, longest, counts = longest_first(vectors, n)
    query_blocks = blocks(q, QUERIES_IN_BLOCK)
    of_range = np.maximum(1, -(-counts // ROWS_IN_BLOCK))  # how many blocks
    first_block = np.concatenate([[0], np.cumsum(of_range)])
    seed = int(np.argmax(counts > 0))  # the longest range with rows; its first block is the seeds
    kind = "qb long, rb long, part int, vec_id long, embedding array<double>, least double"
    is_query = F.col("vec_id") % every == 0

    def block_of(batch):
        length = np.sqrt((matrix(batch.column("embedding"), d) ** 2).sum(1))
        place = np.searchsorted(-bounds, -length, "left").clip(0, len(bounds) - 1)
        ids = batch.column("vec_id").to_numpy()
        return place, first_block[place] + spread(ids, 1 << 40) % of_range[place]

    def seed_rows(batches):
        for batch in batches:
            at = np.flatnonzero(block_of(batch)[1] == first_block[seed])
            yield sent(batch, 1, np.tile(at, query_blocks), np.repeat(np.arange(query_blocks), len(at)), np.full(len(at) * query_blocks, first_block[seed]), least=np.zeros(batch.num_rows))

    def seed_queries(batches):
        for batch in batches:
            row = np.arange(batch.num_rows)
            yield sent(batch, 0, row, spread(batch.column("vec_id").to_numpy(), query_blocks), np.full(len(row), first_block[seed]), least=np.full(len(row), -np.inf))

    def search(asked, rows):
        return search_block(asked.column("vec_id").to_numpy(), matrix(asked.column("embedding"), d), rows.column("vec_id").to_numpy(), matrix(rows.column("embedding"), d), turn, k, asked.column("least").to_numpy())

    asked = vectors.where(is_query)
    seeded = stored(cells(vectors.mapInArrow(seed_rows, kind), asked.mapInArrow(seed_queries, kind), query_blocks, d, search, "long"), "seeded")
    known = ranked(seeded, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    asked = asked.join(known, "vec_id", "left").select("vec_id", "embedding", F.coalesce("least", F.lit(float("-inf"))).alias("least"))

    def reach(batch):
        """How many ranges each query goes to: those before its first one that can't reach what it has."""
        length = np.sqrt((matrix(batch.column("embedding"), d) ** 2).sum(1))
        ceiling = length[:, None] * longest[None, :] * (1 + 1e-9) + 1e-6
        return len(longest) - np.argmax((ceiling >= batch.column("least").to_numpy()[:, None])[:, ::-1], axis=1), ceiling

    def farthest(batches):
        most = np.zeros(query_blocks, "i8")
        for batch in batches:
            np.maximum.at(most, spread(batch.column("vec_id").to_numpy(), query_blocks), reach(batch)[0])
        yield pa.RecordBatch.from_pydict({"qb": pa.array(np.arange(query_blocks)), "ranges": pa.array(most)})

    goes_to = np.zeros(query_blocks, "i8")  # one number for each block of queries
    for r in asked.mapInArrow(farthest, "qb long, ranges long").groupBy("qb").agg(F.max("ranges").alias("ranges")).collect():
        goes_to[r["qb"]] = r["ranges"]

    def to_rows(batches):
        for batch in batches:
            place, block = block_of(batch)
            wanted = (goes_to[None, :] > place[:, None]) & (block != first_block[seed])[:, None]
            row, to = np.nonzero(wanted)
            yield sent(batch, 1, row, to, block[row], least=np.zeros(batch.num_rows))

    def to_queries(batches):
        for batch in batches:
            ids, least = batch.column("vec_id").to_numpy(), batch.column("least").to_numpy()
            number = first_block[reach(batch)[0]]  # blocks of the ranges it goes to
            row = np.repeat(np.arange(batch.num_rows), number)
            block = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            there = block != first_block[seed]
            row, block = row[there], block[there]
            for at in range(0, len(row), 16_384):  # a query may go to many blocks
                some = row[at : at + 16_384]
                yield sent(batch, 0, some, spread(ids[some], query_blocks), block[at : at + 16_384], least=least)

    rest = cells(vectors.mapInArrow(to_rows, kind), asked.mapInArrow(to_queries, kind), query_blocks * int(first_block[-1]), d, search, "long")
    return seeded.unionByName(rest)


def top_products(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of floor(scale * x) for each vec_id divisible by every.

    Exact, ties to smaller ids; fewer candidates give fewer rows. Vectors that are null or hold null or non-finite
    components take no part, zero vectors do; a vector meets those of its own dimension. Every row is a candidate, also
    where a vec_id repeats, but for the query's own id; rows of one query id are asked together. A score beyond
    64 bits is an error; an empty table gives no rows. Other columns are ignored.
    """
    vectors = clean(embeddings, nonzero=False, values=lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    return ranked(by_dimension(vectors, F.col("vec_id") % every == 0, lambda v, d, n, q: products(v, d, n, q, every, k), "long"), k)
