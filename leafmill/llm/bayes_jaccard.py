"""Near-duplicate join on n-gram Jaccard similarity with Bayesian pruning of candidates.

Equal shingle sets are folded first, so copies cost one row. MinHash bands propose candidates among the
representatives. The values of two signatures are compared a few at a time, and a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold is below a tolerance. What remains ties
documents to groups; within a group all pairs are pruned in the same way and the rest verified on whole sets.
Buckets and groups are split into pairs of chunks, so no task holds an unbounded one, and links are counted where
they are verified: pairs are never rows.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Memo, grouped, portions, runs, slices, stored, tidy
from leafmill.llm.components import components, dealt_anew

WORDS = 5
THRESHOLD = 0.8
HASHES, BAND = 128, 4  # a pair at the threshold misses all bands with probability 5e-8
CHECKS = (16, 32, 64, 128)
TOLERANCE = 1e-7
BUCKET_CHUNK, GROUP_CHUNK, SHINGLES_CHUNK = 1024, 512, 2_000_000
FEW = 8
SLICE_CHARS = 3_000_000
WORD_BYTES = 32_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
word_hashes = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), WORD_BYTES)


def shingle_hashes(texts: list[str | None], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the word n-grams of all texts in a row, how many each text has).

    Words are what white space separates, in lower case. A text of fewer words has one shingle of all of them; a
    null or blank text has none.
    """
    words = [t.lower().split() if t else [] for t in texts]
    counts = np.array([*map(len, words)], "i8")
    known = word_hashes.__getitem__
    hashed = np.fromiter((h for w in words for h in map(known, w)), "u8", int(counts.sum()))
    ends = np.cumsum(counts)
    begins = ends - counts
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    place = np.repeat(begins - (np.cumsum(number) - number), number) + np.arange(number.sum())
    last = np.repeat(ends, number)
    out = np.zeros(len(place), "u8")
    for k in range(width):
        at = place + k
        inside = at < last
        value = hashed[np.minimum(at, max(len(hashed) - 1, 0))] if len(hashed) else hashed
        out = np.where(inside, (out ^ (out >> np.uint64(31))) * MIX + value, out)
    return (out ^ (out >> np.uint64(29))) * MIX, number


def permutations(seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, HASHES, dtype="u4"), rng.integers(0, 1 << 31, HASHES, dtype="u4") * np.uint32(2) + np.uint32(1)


def signatures(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """MinHash values of each text that has shingles, in rows."""
    full = number > 0
    begins = (np.cumsum(number) - number)[full]
    short = (hashes >> np.uint64(32)).astype("u4")
    out = np.empty((int(full.sum()), HASHES), "u4")
    if len(out):
        for k, (flip, factor) in enumerate(zip(*permutations(), strict=True)):
            value = (short ^ flip) * factor
            out[:, k] = np.minimum.reduceat(value ^ (value >> np.uint32(15)), begins)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), HASHES // BAND), "u8")
    for k in range(BAND):
        keys = (keys ^ (keys >> np.uint64(31))) * MIX + signature[:, k::BAND]
    return keys.view("i8")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values, the fewest matches with which a pair goes on; the prior is uniform."""
    grid = (np.arange(40_000) + 0.5) / 40_000
    low, high = np.log(grid), np.log1p(-grid)
    found = []
    for n in CHECKS:
        for matches in range(n + 1):
            weight = matches * low + (n - matches) * high
            weight = np.exp(weight - weight.max())
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                found.append(matches)
                break
    return found


def surviving(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the pairs (rows of left and right) are still candidates after all comparisons."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), "i4")
    done = 0
    for stop, need in zip(CHECKS, least, strict=True):
        matches[alive] += (left[alive, done:stop] == right[alive, done:stop]).sum(1)
        alive, done = alive[matches[alive] >= need], stop
    keep = np.zeros(len(left), bool)
    keep[alive] = True
    return keep


def pair_indices(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one side, or those of a row of either side where there are two."""
    if (sides == sides[0]).all():
        return np.triu_indices(len(sides), 1)
    first, second = np.flatnonzero(sides == sides.min()), np.flatnonzero(sides == sides.max())
    return np.repeat(first, len(second)), np.tile(second, len(first))


def candidate_pairs(sides: np.ndarray, matrix: np.ndarray, least: list[int], most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The surviving pairs of a block, looked at in portions of bounded size."""
    left, right = pair_indices(sides)
    keep = [surviving(matrix[left[i : i + most]], matrix[right[i : i + most]], least) for i in range(0, len(left), most)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return left[keep], right[keep]


def roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index tied to each, by pointer jumping."""
    root = np.arange(size)
    while True:
        before = root.copy()
        lower = np.minimum(root[left], root[right])
        np.minimum.at(root, left, lower)
        np.minimum.at(root, right, lower)
        np.minimum.at(root, before[left], lower)
        np.minimum.at(root, before[right], lower)
        root = root[root]
        if (root == before).all():
            return root


def signature_table(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits of the shingle set), bands and signature (16 bits a value)."""

    @tidy
    def run(batches):
        for batch in portions(batches):
            texts = batch.column("text").to_pylist()
            for begin, end in slices(texts, SLICE_CHARS):
                hashes, number = shingle_hashes(texts[begin:end])
                matrix = signatures(hashes, number)
                keys = iter(band_keys(matrix))
                values = iter(matrix.astype("u2"))
                stops = np.cumsum(number)
                rows = {"n_shingles": [], "set_a": [], "set_b": [], "bands": [], "signature": []}
                for n, stop in zip(number.tolist(), stops.tolist(), strict=True):
                    own = np.unique(hashes[stop - n : stop])
                    digest = xxhash.xxh3_128_intdigest(own.tobytes())
                    rows["n_shingles"].append(len(own))
                    rows["set_a"].append((digest >> 64) - (1 << 63))
                    rows["set_b"].append((digest & ((1 << 64) - 1)) - (1 << 63))
                    rows["bands"].append(next(keys) if n else np.zeros(0, "i8"))
                    rows["signature"].append(next(values).tobytes() if n else b"")
                bands = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(b) for b in rows["bands"]])]).astype("i4")), pa.array(np.concatenate(rows["bands"]) if rows["bands"] else np.zeros(0, "i8"))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin).cast(pa.int64()), pa.array(rows["n_shingles"], pa.int32()), pa.array(rows["set_a"], pa.int64()), pa.array(rows["set_b"], pa.int64()), bands, pa.array(rows["signature"], pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"],
                )

    return documents.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles int, set_a long, set_b long, bands array<long>, signature binary")


def chunk_pairs(rows: DataFrame, node: Column, number: Column) -> DataFrame:
    """Adds side, a and b: a row goes to each pair of its group's chunks, of which there are number, that holds its own."""
    rows = rows.withColumn("chunks", number.cast("int")).withColumn("side", F.pmod(F.xxhash64(node), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    return rows.select("*", other).select("*", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b")).drop("other", "chunks")


def tied(bucketed: DataFrame) -> DataFrame:
    """(u, v) that tie documents which share a band and survive the pruning."""
    keys = ["band", "key", "a", "b"]

    @tidy
    def run(batches):
        least = least_matches()
        for table in grouped(batches, keys):
            begins, ends = runs(table, keys)
            docs = table.column("rep").to_numpy()
            sides = table.column("side").to_numpy()
            matrix = np.frombuffer(b"".join(table.column("signature").to_pylist()), "u2").reshape(-1, HASHES)
            out_u, out_v = [], []
            size = ends - begins
            for n in range(2, FEW + 1):  # all small buckets of one size at once
                at = begins[size == n]
                if len(at):
                    i, j = np.triu_indices(n, 1)
                    left, right = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                    for part in range(0, len(left), 200_000):
                        x, y = left[part : part + 200_000], right[part : part + 200_000]
                        keep = surviving(matrix[x], matrix[y], least)
                        out_u.append(docs[x[keep]])
                        out_v.append(docs[y[keep]])
            for begin, end in zip(begins[size > FEW], ends[size > FEW], strict=True):
                x, y = candidate_pairs(sides[begin:end], matrix[begin:end], least)
                root = roots(end - begin, x, y)
                moved = np.flatnonzero(root != np.arange(end - begin))
                out_u.append(docs[begin:end][moved])
                out_v.append(docs[begin:end][root[moved]])
            if out_u:
                pairs = np.unique(np.stack([np.concatenate(out_u), np.concatenate(out_v)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    dealt = bucketed.select(*keys, "side", "rep", "signature").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u long, v long")


def with_shingles(rows: DataFrame) -> DataFrame:
    """Replaces text by its sorted shingle set and its signature."""
    others = [c for c in rows.columns if c != "text"]

    @tidy
    def run(batches):
        for batch in portions(batches):
            texts = batch.column("text").to_pylist()
            for begin, end in slices(texts, SLICE_CHARS):
                hashes, number = shingle_hashes(texts[begin:end])
                matrix = iter(signatures(hashes, number).astype("u2"))
                stops = np.cumsum(number)
                sets = [np.unique(hashes[s - n : s]).tobytes() for n, s in zip(number.tolist(), stops.tolist(), strict=True)]
                marks = [next(matrix).tobytes() if n else b"" for n in number.tolist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, end - begin) for c in others), pa.array(sets, pa.binary()), pa.array(marks, pa.binary())], names=[*others, "shingles", "signature"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, "text").mapInArrow(run, f"{schema}, shingles binary, signature binary")


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each pair shares: by merging for few pairs, else by products over the shared shingles."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], "i8")
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [*map(len, sets)])
    shared = np.cumsum(times > 1) - 1
    keep = times[inverse] > 1
    owner, column = owner[keep], shared[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), "f4")
    for begin in range(0, int((times > 1).sum()), 4096):
        low, high = np.searchsorted(column, [begin, begin + 4096])
        block = np.zeros((len(sets), 4096), "f4")
        block[owner[low:high], column[low:high] - begin] = 1
        total += block @ block.T
    return total[left, right].astype("i8")


def verified(members: DataFrame) -> DataFrame:
    """(doc, root, n_links): of each block the links of a document in it and the least one it is tied to."""
    keys = ["grp", "a", "b"]

    @tidy
    def run(batches):
        least = least_matches()
        for table in grouped(batches, keys):
            docs_out, root_out, links_out = [], [], []
            for begin, end in zip(*runs(table, keys), strict=True):
                part = table.slice(begin, end - begin)
                docs, first = np.unique(part.column("doc").to_numpy(), return_index=True)  # repeated rows count once
                part = part.take(pa.array(first))
                sets = [np.frombuffer(s, "u8") for s in part.column("shingles").to_pylist()]
                matrix = np.frombuffer(b"".join(part.column("signature").to_pylist()), "u2").reshape(-1, HASHES)
                if len(docs) < 2:
                    continue
                length = np.array([*map(len, sets)])
                x, y = candidate_pairs(part.column("side").to_numpy(), matrix, least)
                able = np.minimum(length[x], length[y]) >= THRESHOLD * np.maximum(length[x], length[y]) - 1e-9
                x, y = x[able], y[able]
                common = common_counts(sets, x, y)
                # In whole numbers: common / union >= 4/5.
                linked = common * 5 >= (length[x] + length[y] - common) * 4
                x, y = x[linked], y[linked]
                links = np.bincount(x, minlength=len(docs)) + np.bincount(y, minlength=len(docs))
                root = roots(len(docs), x, y)
                has = np.flatnonzero(links)
                docs_out.append(docs[has])
                root_out.append(docs[root[has]])
                links_out.append(links[has])
            if docs_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (docs_out, root_out, links_out)], names=["doc", "root", "n_links"])

    dealt = members.select(*keys, "side", "doc", "shingles", "signature").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "doc long, root long, n_links long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, rep_id, n_links, n_copies of every document.

    Documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more are linked; class_id is the least
    doc_id that links lead to. rep_id is the least doc_id with the same set (copies differ in case and white space
    at most, or in repeats), n_copies the number of documents with it, n_links how many other sets the
    document's is linked to. A null, empty or blank text is a class of its own without links. doc_id is taken to name
    a text: repeated rows give one row, rows without doc_id give none. Further columns are ignored.
    """
    all_rows = stored(signature_table(documents), "signatures")
    worded = all_rows.where("n_shingles > 0")
    reps = worded.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("n_copies"))
    member = all_rows.select("doc_id", "set_a", "set_b", "n_shingles").join(dealt_anew(reps, "set_a", "set_b"), ["set_a", "set_b"], "left")
    blank = F.col("n_shingles") == 0
    member = member.select("doc_id", F.when(blank, F.col("doc_id")).otherwise(F.col("rep")).alias("rep"), F.when(blank, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"))
    member = stored(member.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("n_copies").alias("n_copies")), "members")
    chosen = member.where("doc_id = rep").select("rep")
    posted = worded.join(chosen, worded.doc_id == chosen.rep, "left_semi").select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("band", "key"))
    several = posted.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    bucketed = posted.join(dealt_anew(several, "key"), ["band", "key"]).join(worded.select(F.col("doc_id").alias("rep"), "signature"), "rep")
    bucketed = chunk_pairs(bucketed, F.col("rep"), F.ceil(F.col("n") / BUCKET_CHUNK))
    group = components(tied(bucketed))
    group = group.select(F.col("u").alias("doc"), F.col("v").alias("grp")).unionByName(group.select(F.col("v").alias("doc"), F.col("v").alias("grp")).distinct())
    lengths = worded.groupBy(F.col("doc_id").alias("doc")).agg(F.max("n_shingles").alias("length"))
    group = stored(group.join(lengths, "doc"), "groups")
    # As many chunks as keep both rows and shingles of each bounded.
    size = group.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / GROUP_CHUNK), F.ceil(F.sum("length") / SHINGLES_CHUNK)).alias("n"))
    group = group.join(dealt_anew(size, "grp"), "grp").select("doc", "grp", "n")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), "text").join(group, "doc")
    members = chunk_pairs(with_shingles(texts), F.col("doc"), F.col("n"))
    found = stored(verified(members), "links")
    links = found.groupBy("doc").agg(F.sum("n_links").alias("n_links"))
    classes = components(found.select(F.col("doc").alias("u"), F.col("root").alias("v")))
    linked = links.join(classes.select(F.col("u").alias("doc"), F.col("v").alias("least")), "doc", "left")
    out = member.join(linked, member.rep == linked.doc, "left")
    return out.select(
        "doc_id", F.coalesce("least", "rep").alias("class_id"), F.col("rep").alias("rep_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents with the least doc_id of each class; of repeated rows one stays, rows without doc_id stay."""
    classes = near_duplicates(documents)
    kept = classes.where("class_id = doc_id").select(F.col("doc_id").alias("kept_id"))
    again = documents.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("again_id")).agg(F.count("*").alias("n")).where("n > 1").select("again_id")
    chosen = documents.join(kept, documents.doc_id == kept.kept_id, "left_semi")
    once = chosen.join(again, chosen.doc_id == again.again_id, "left_anti")
    more = chosen.join(again, chosen.doc_id == again.again_id, "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(more).unionByName(documents.where("doc_id IS NULL"))


def misses(similarity: float) -> float:
    """The probability that a pair of this similarity shares no band."""
    return math.exp(HASHES // BAND * math.log1p(-(similarity**BAND)))
