"""Mixing sources to target weights by a low-discrepancy schedule.

The points of the golden-ratio sequence, mapped through the cumulative target shares, give each slot of the mix
a source, and every stretch of slots is close to the shares. A source's slots are ranked, its documents are
shuffled and laid end to end, and the slot of rank j takes the source's block j of equally many words. A source
whose target exceeds its size is laid end to end twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
GOLDEN = 0x9E3779B97F4A7C15  # 2**64 over the golden ratio
BLOCK_WORDS = 1024
SLOTS_IN_RUN = 1 << 16
SHUFFLE_BUCKET = 4  # hexadecimal digits: 65,536 buckets a source
MOST_SOURCES = 200_000


@dataclass(frozen=True)
class SourceTarget:
    source: str | None
    size: int
    target: float

    @property
    def quota(self) -> int:
        return math.floor(self.target)


def targets(sizes: list[tuple[str | None, int]], share: Fraction = Fraction(3, 2), most: int = 2, weights=WEIGHTS) -> list[SourceTarget]:
    """Targets in proportion to weights that repeat over the sources by code point, null last; at most `most` times
    a source's size, what is above going to the others by weight."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[at % len(weights)] for at, (s, _) in enumerate(ordered)}
    left, open_weight = share * sum(n for _, n in ordered), sum(weight.values())
    found: dict[str | None, float] = {}
    waiting = sorted(ordered, key=lambda s: (Fraction(s[1], weight[s[0]]), s[0] is None, s[0] or ""))
    for at, (source, size) in enumerate(waiting):
        if most * size * open_weight > left * weight[source]:
            doubled = left * share.denominator
            for other, _ in waiting[at:]:
                found[other] = float(int(doubled) * weight[other]) / float(share.denominator * open_weight)
            break
        found[source] = float(most * size)
        left -= most * size
        open_weight -= weight[source]
    return [SourceTarget(s, n, found[s]) for s, n in ordered]


def measured(documents: DataFrame, seed: int, keyed: bool = False) -> DataFrame:
    """doc_id, source, size in words and the shuffle key of every document; keyed also its row's key."""
    return documents.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        # The text counts too, so that rows without an id don't share one key.
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))).alias("draw"),
        *([row_key().alias("key")] if keyed else []),
    )


def source_sizes(sized: DataFrame) -> list[tuple[str | None, int]]:
    """One row per source comes to the driver; more than MOST_SOURCES is an error, as sources are categories."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return [(r["source"], r["size"]) for r in rows]


def schedule(spark: SparkSession, wanted: list[SourceTarget], block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, place, rank): slot of the mix, index of its source in wanted, and which of its blocks it takes.

    Each source gets as many slots as it has blocks within its quota. Points that fall to a source with all its
    slots are passed over; slots that the points leave open come at the end.
    """
    blocks = np.array([-(-t.quota // block_words) for t in wanted], "i8")
    shares = np.array([t.quota for t in wanted], "f8")
    cumulative = np.cumsum(shares) / max(shares.sum(), 1.0)
    points = int(blocks.sum() + 4 * len(wanted) + 64) if blocks.sum() else 0

    def run(batches):
        for batch in batches:
            slot = batch.column("id").to_numpy()
            point = ((slot.astype("u8") + np.uint64(1)) * np.uint64(GOLDEN)).astype("f8") / 2.0**64
            place = np.searchsorted(cumulative, point, "right").clip(0, len(shares) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(place.astype("i4"))], names=["slot", "place"])

    dealt = spark.range(points).mapInArrow(run, "slot long, place int").withColumn("run", (F.col("slot") / SLOTS_IN_RUN).cast("long"))
    counts = dealt.groupBy("place", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1
    limit = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "place int, blocks long")
    first = dealt.withColumn("own", own).join(counts, ["place", "run"]).select("slot", "place", (F.col("before") + F.col("own")).alias("rank"))
    first = first.join(limit, "place").where("rank < blocks").select("slot", "place", "rank")
    had = first.groupBy("place").agg(F.count("*").alias("had"))
    late = limit.join(had, "place", "left").select("place", "blocks", F.coalesce("had", F.lit(0)).alias("had")).where("had < blocks")
    late = late.select("place", F.explode(F.sequence("had", F.col("blocks") - 1)).alias("rank"))
    return first.unionByName(late.select((F.lit(points) + F.col("rank") * len(wanted) + F.col("place")).alias("slot"), "place", "rank"))


def laid_out(sized: DataFrame) -> DataFrame:
    """Adds begin: the words of the source before each document in shuffled order.

    A source is cut by its shuffle keys, so its running sum is two short ones and no task holds a source.
    """
    sized = sized.withColumn("bucket", F.substring("draw", 1, SHUFFLE_BUCKET))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(order), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = sized.join(sums, sized.source.eqNullSafe(sums.s) & (sized.bucket == sums.b))
    return joined.withColumn("begin", F.col("before") + F.col("inside")).drop("s", "b", "bucket", "before", "inside")


def row_key() -> Column:
    """The same for rows of the same id, source and text, null apart from empty."""
    return F.md5(F.to_json(F.struct("doc_id", "source", F.md5("text").alias("text"))))


def mixed(documents: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 17, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents laid out in their sources, the schedule).

    The first has doc_id, source, size, place, source_size, target, begin and quota, keyed also key. A null or blank
    text has size 0. A null source is a source. Repeated rows are documents of their own; an empty table gives no rows.
    """
    spark = documents.sparkSession
    sized = stored(measured(documents, seed, keyed), "sizes")  # narrow; the texts are read once
    wanted = targets(source_sizes(sized))
    known = spark.createDataFrame([(i, t.source, t.size, t.target, t.quota) for i, t in enumerate(wanted)], "place int, name string, source_size long, target double, quota long")
    placed = laid_out(sized)
    return placed.join(known, placed.source.eqNullSafe(known.name)).drop("name", "draw"), schedule(spark, wanted, block_words)


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """What each block holds of each document: rank, first_word and last_word, with the columns of placed.

    A source is laid end to end as often as its quota asks for; the last block ends at the quota.
    """
    passes = F.explode(F.array(F.lit(0), F.lit(1))).alias("pass")
    rows = placed.where("size > 0").select("*", passes).withColumn("at", F.col("begin") + F.col("pass") * F.col("source_size"))
    rows = rows.where("at < quota").withColumn("stop", F.least(F.col("at") + F.col("size"), F.col("quota")))
    rows = rows.withColumn("rank", F.explode(F.sequence((F.col("at") / block_words).cast("long"), ((F.col("stop") - 1) / block_words).cast("long"))))
    first, last = F.greatest("at", F.col("rank") * block_words) - F.col("at"), F.least("stop", (F.col("rank") + 1) * block_words) - F.col("at")
    return rows.withColumn("first_word", first).withColumn("last_word", last).drop("at", "stop", "pass")


def mixed_blocks(documents: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """(slot, place, rank, doc_id, first_word, last_word): the pieces of documents that each slot takes, in words."""
    placed, slots = mixed(documents, block_words, seed)
    return slots.join(pieces(placed, block_words), ["place", "rank"]).select("slot", "place", "rank", "doc_id", "first_word", "last_word")


def mix_query(documents: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot of every document.

    taken is how many of its words the scheduled slots take, repeats counted, and first_slot the slot of the mix
    that it first comes in, null where nothing is taken. Cases as in `mixed`.
    """
    placed, slots = mixed(documents, block_words, seed)
    placed = stored(placed.select("doc_id", "size", "place", "source_size", "target", "begin", "quota"), "placed")
    # Documents with words have places of their own, so (place, begin) names a row.
    scheduled = pieces(placed, block_words).select("place", "begin", "rank", (F.col("last_word") - F.col("first_word")).alias("words")).join(slots, ["place", "rank"])
    got = scheduled.groupBy("place", "begin").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    nothing = F.lit(None).cast("long")
    rows = placed.where("size > 0").join(got, ["place", "begin"], "left").unionByName(placed.where("size = 0").withColumn("taken", nothing).withColumn("first_slot", nothing))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def resampled(documents: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """The documents as often as the mix takes them, in the order of the slots; columns stay as they are.

    A document comes at the slot that takes the block it begins in. The one that crosses its source's quota is cut
    after its last word within, so every source gives exactly its quota of words. Rows without words don't come.
    """
    placed, slots = mixed(documents, block_words, seed, keyed=True)
    same = Window.partitionBy("key").orderBy("begin")
    rows = placed.where("size > 0").withColumn("nth", F.row_number().over(same)).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass"))
    rows = rows.withColumn("at", F.col("begin") + F.col("pass") * F.col("source_size")).where("at < quota")
    rows = rows.select("key", "nth", "place", "at", F.least("size", F.col("quota") - F.col("at")).alias("words"), (F.col("at") < F.col("quota") - F.col("size") + 1).alias("whole"), (F.col("at") / block_words).cast("long").alias("rank"))
    taken = F.struct("nth", "slot", "at", "words", "whole")
    copies = rows.join(slots, ["place", "rank"]).groupBy("key").agg(F.collect_list(taken).alias("copies"))
    names = documents.columns
    numbered = documents.select(F.struct(*names).alias("row"), row_key().alias("key")).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    out = numbered.join(copies, "key").select("row", F.explode(F.filter("copies", lambda c: c["nth"] == F.col("nth"))).alias("c"))
    # The words wanted, each with the white space before it.
    parts = F.regexp_extract_all("row.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(F.col("c.whole"), F.col("row.text")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.col("c.words").cast("int")), ""))
    return out.orderBy("c.slot", "c.at").select(*[text.alias(n) if n == "text" else F.col("row")[n].alias(n) for n in names])
