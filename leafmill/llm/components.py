"""Connected components of a graph of ids by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import ensure_checkpoint_dir


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def dealt_anew(frame: DataFrame, *columns: str) -> DataFrame:
    """The same rows, but not taken to be dealt by the columns (whole numbers): a join with them then has plain
    exchanges on both sides, and Spark can split the other side's partition of a hot key."""
    return frame.withColumns({c: F.col(c).bitwiseXOR(F.lit(0)) for c in columns})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): each node that is not the least of its component, with the least one.

    edges has columns u and v in any order; loops and repeats are ignored, an edge with a null end too. Rounds
    grow with the logarithm of the component size; every round is cut off by a checkpoint in the shared folder. The
    least node of a large component has many edges: its minimum is pre-aggregated and its side of the joins split.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = fingerprint(edges)
    for _ in range(most_rounds):
        if not state[0]:
            return edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt_anew(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt_anew(least, "u"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(least.withColumnRenamed("m", "v")).where("u != v").distinct().checkpoint()
        before, state = state, fingerprint(edges)
        if state == before:
            return edges
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
