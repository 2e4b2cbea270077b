"""Merging revisions, resolving references, carrying state along a sequence, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], order: list[Column], dead: Column) -> DataFrame:
    """The newest row of each key, and none where that row is a tombstone."""
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_at") == 1).drop("_at").where(~dead)


def carried(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the last known value up to each row."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(window))


def depth(rows: DataFrame, keys: list[str], order: list[Column], change: Column, name: str = "depth") -> DataFrame:
    """Adds the running sum of pushes and pops."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(change).over(window))


def skipped(rows: DataFrame, keys: list[str], order: list[Column], level: Column) -> DataFrame:
    """Rows whose level is more than one below that of the row before; the first counts from 0."""
    before = F.lag(level, 1, 0).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("previous", before).where(level > F.col("previous") + 1)


def unresolved(references: DataFrame, targets: DataFrame, on: Column) -> DataFrame:
    return references.join(targets, on, "left_anti")


def used(rows: DataFrame, uses: DataFrame, on: Column) -> DataFrame:
    return rows.join(uses, on, "left_semi")


def inside(points: DataFrame, spans: DataFrame, key: Column, point: Column, begin: Column, end: Column) -> DataFrame:
    """Points that lie in a span of their key: equality on the key keeps this an ordinary join."""
    return points.join(spans, key & (point >= begin) & (point < end), "left_semi")


def inconsistent(rows: DataFrame, key: str, definition: Column) -> DataFrame:
    """Keys whose occurrences have more than one definition, once each."""
    return rows.groupBy(key).agg(F.countDistinct(definition).alias("definitions")).where("definitions > 1")


def reach_counts(edges: DataFrame, nodes: DataFrame, node: str, source: str) -> DataFrame:
    """Each node's kind by how many sources reach it: orphan, private or shared."""
    counts = edges.groupBy(node).agg(F.countDistinct(source).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return nodes.join(counts, node, "left").select(node, F.when(n == 0, "orphan").when(n == 1, "private").otherwise("shared").alias("kind"))


def slices_of(rows: DataFrame, order: Column, value: str, partition: list[str]) -> DataFrame:
    """Adds start and stop: the running share of the total that each positive row covers."""
    rows = rows.where(F.col(value) > 0)
    total = F.sum(value).over(Window.partitionBy(*partition)) if partition else None
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", total).withColumn("upto", F.sum(value).over(window))
