"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HELD_OUT_REMAINDER = 2
ENTRY_BYTES = 100  # what a place in a dictionary takes besides its key and value
WORKER_BYTES, TOLD_BYTES = 128_000_000, 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """True for the fold that no model may learn from; a null id is not held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def slices(texts: list[str | None], most_chars: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold about most_chars characters; one long text is a run by itself."""
    begin = chars = 0
    for at, text in enumerate(texts):
        length = len(text) if text else 0
        if at > begin and chars + length > most_chars:
            yield begin, at
            begin, chars = at, 0
        chars += length
    if begin < len(texts):
        yield begin, len(texts)


def portions(batches, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about most_bytes, so what is made of them at once stays small; one long text
    is a slice by itself."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype="i8")
        begin = 0
        while begin < batch.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Shared:
    """Keeps all memories of a worker process together below a limit, WORKER_BYTES unless a task names its own: as one
    grows, those that have grown least lately, such as another operator's, are forgotten first."""

    def __init__(self):
        self.limit = WORKER_BYTES
        self.members: weakref.WeakSet = weakref.WeakSet()
        self.clock = 0
        self.user = None

    def __reduce__(self):  # a task's function brings no copy along but finds the one of its worker, which memories use
        return "shared"

    def forget(self) -> None:
        for memory in list(self.members):
            memory.forget()

    def used_by(self, user) -> None:
        """What another operator has left in the worker is forgotten."""
        if user != self.user:
            self.user = user
            self.forget()

    def grown(self, memory) -> None:
        self.clock += 1
        memory.last = self.clock
        self.members.add(memory)
        total = sum(m.used for m in self.members)
        for other in sorted(self.members, key=lambda m: m.last):
            if total <= self.limit or other is memory:
                break
            total -= other.used
            other.forget()


shared = Shared()


class Memo(dict):
    """A memory of a pure function, bounded in bytes, in two generations: what is asked for again outlives a
    turn-over. Keys longer than longest are computed anew each time, so long texts without blanks are never kept."""

    def __init__(self, compute, most_bytes: int, longest: int = 64):
        super().__init__()
        self.compute, self.half, self.longest = compute, most_bytes // 2, longest
        self.forget()

    def __hash__(self):
        return id(self)

    def __eq__(self, other):  # sets compare members, and as dictionaries all entries would be
        return self is other

    def forget(self) -> None:
        self.clear()
        self.old, self.young_bytes, self.used, self.told = {}, 0, 0, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        size = getsizeof(key) + getsizeof(value) + ENTRY_BYTES
        if self.young_bytes + size > self.half:
            self.old, self.used, self.young_bytes = dict(self), self.young_bytes, 0
            self.clear()
        self[key] = value
        self.young_bytes += size
        self.used += size
        self.told += size
        if self.told > TOLD_BYTES:
            self.told = 0
            shared.grown(self)
        return value


def tidy(run: Callable, worker_bytes: int = WORKER_BYTES, keep: bool = True, collect: bool = True) -> Callable:
    """Runs over the batches of a task with memories of worker_bytes in all; when they are done, pages that are free
    go back to the system, and without keep so do the memories. Those of another operator go at the start. Without
    collect, for memories of many small objects that form no cycles but those that forgetting breaks, no task searches
    for cycles."""
    user = run.__module__, run.__qualname__

    def tidied(batches):
        shared.limit = worker_bytes
        shared.used_by(user)
        if not collect:
            gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
        if not keep:
            shared.forget()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a folder of this machine serves a session that
    runs in one process; on a cluster, where other executors couldn't read it, that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


written: list[str] = []


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it: later stages survive lost executors.

    The table goes when the application ends, or earlier with `release`.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place, files = folder(spark, path)
    files.deleteOnExit(place)
    frame.write.parquet(path)
    written.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that `stored` wrote after the first `since` ones, but for the last `keep`; for callers that
    have their result."""
    gone = written[since : len(written) - keep]
    for path in gone:
        place, files = folder(spark, path)
        files.delete(place, True)
    del written[since : since + len(gone)]


def bounded_sample(frame: DataFrame, keys: list[str], bounds: dict, group: str, seed: int = 7) -> DataFrame:
    """At most bounds[g][1] rows of each group g, those with the least hash of the keys, so reruns agree.

    bounds maps a group's value to a pair (rows there are, rows wanted). A first cut by the hash is narrow; only
    about twice the wanted rows are ranked, and every task passes on no more than are wanted.
    """
    draw = F.xxhash64(*keys, F.lit(seed))
    share, most = F.lit(0.0), F.lit(0)
    for value, (there, wanted) in bounds.items():
        share = F.when(F.col(group) == F.lit(value), F.lit(min(1.0, (2 * wanted + 50) / max(there, 1)))).otherwise(share)
        most = F.when(F.col(group) == F.lit(value), F.lit(wanted)).otherwise(most)
    largest = max((wanted for _, wanted in bounds.values()), default=0)
    few = frame.where(F.pmod(draw, F.lit(1 << 30)) / float(1 << 30) < share)
    order = Window.partitionBy(group).orderBy(draw, *keys)
    nth = few.withColumn("nth_drawn", F.row_number().over(order)).where(F.col("nth_drawn") <= largest)
    return nth.where(F.col("nth_drawn") <= most).drop("nth_drawn")


def grouped(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the key columns, across batches; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is not None and tuple(c[0] for c in columns) != last
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        last = tuple(c[-1] for c in columns)
        if not len(cuts):
            held.append(batch)
            continue
        # Whole runs go out together, so that many small ones cost little.
        whole = cuts[-1]
        held.append(batch.slice(0, whole))
        yield pa.Table.from_batches(held)
        held = [batch.slice(whole)]
    if held:
        yield pa.Table.from_batches(held)


def runs(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    columns = [table.column(k).to_numpy() for k in keys]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    begins = np.flatnonzero(new)
    return begins, np.append(begins[1:], table.num_rows)
