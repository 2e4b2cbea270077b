"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents; words get labels by evidence: a word of a toxic document is toxic if it, or a beginning of
it, occurs in significantly more toxic documents than chance. A two-state chain is fitted to these words.
Forward-backward marginals of every word of a text aggregate to its score, and words above one half give the
offending offsets. The recursions run over blocks of many texts at once, in steps of BLOCK words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Memo, bounded_sample, held_out, slices, stored, tidy

BUCKETS = 1 << 18
BLOCK = 64
WORD_BYTES = 64_000_000
SLICE_CHARS = 3_000_000
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
WORD = re.compile(r"\S+")


def core(chunk: str) -> str:
    return EDGES.sub("", chunk.lower())


def traits(word: str) -> list[str]:
    """A word and its beginnings; a chunk without letters has none."""
    return [f"={word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) > n)] if word else []


def bucket(trait: str) -> int:
    return zlib.crc32(trait.encode("utf-8", "surrogatepass")) % BUCKETS


class Blocks:
    """The words of several texts laid out in rows of BLOCK, each text on rows of its own."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.rows_of = -(-counts // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(self.rows_of)])
        begin = np.repeat(self.first[:-1] * BLOCK, counts)
        inside = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        self.place = begin + inside
        self.rows = int(self.first[-1])

    def marginals(self, score: np.ndarray, start: np.ndarray, step: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) of each word; pairs, if given, is increased by the expected number of each transition."""
        weight = np.ones(self.rows * BLOCK)
        used = np.zeros(self.rows * BLOCK, bool)
        weight[self.place], used[self.place] = np.exp(np.clip(score, -40, 40)), True
        weight, used = weight.reshape(-1, BLOCK).T, used.reshape(-1, BLOCK).T
        product = np.broadcast_to(np.eye(2), (self.rows, 2, 2)).copy()
        for t in range(BLOCK):
            new = product @ step
            new[:, :, 1] *= weight[t][:, None]
            new /= new.sum((1, 2), keepdims=True)
            product = np.where(used[t][:, None, None], new, product)
        ahead, behind = np.empty((self.rows, 2)), np.empty((self.rows, 2))
        order = np.argsort(-self.rows_of, kind="stable")
        state = np.broadcast_to(start, (len(order), 2)).copy()
        for j in range(int(self.rows_of.max(initial=0))):
            texts = order[: np.searchsorted(-self.rows_of[order], -j, "left")]
            at = self.first[texts] + j
            ahead[at] = state[: len(texts)]
            new = np.einsum("ni,nij->nj", state[: len(texts)], product[at])
            state[: len(texts)] = new / new.sum(1, keepdims=True)
        state = np.ones((len(order), 2))
        for j in range(int(self.rows_of.max(initial=0))):
            texts = order[: np.searchsorted(-self.rows_of[order], -j, "left")]
            at = self.first[texts] + self.rows_of[texts] - 1 - j
            behind[at] = state[: len(texts)]
            new = np.einsum("nij,nj->ni", product[at], state[: len(texts)])
            state[: len(texts)] = new / new.sum(1, keepdims=True)
        forward = np.empty((BLOCK + 1, self.rows, 2))
        forward[0] = ahead
        for t in range(BLOCK):
            new = forward[t] @ step
            new[:, 1] *= weight[t]
            new /= new.sum(1, keepdims=True)
            forward[t + 1] = np.where(used[t][:, None], new, forward[t])
        toxic = np.empty((BLOCK, self.rows))
        back = behind
        for t in range(BLOCK - 1, -1, -1):
            both = forward[t + 1] * back
            toxic[t] = both[:, 1] / both.sum(1)
            into = back.copy()
            into[:, 1] *= weight[t]
            if pairs is not None:
                joint = forward[t][:, :, None] * step * into[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                pairs += joint[used[t]].sum(0)
            new = into @ step.T
            back = np.where(used[t][:, None], new / new.sum(1, keepdims=True), back)
        return toxic.T.reshape(-1)[self.place]


@dataclass
class ToxicModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, "f4"))
    bias: float = -6.0
    start: np.ndarray = field(default_factory=lambda: np.array([0.99, 0.01]))
    step: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    judge: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0]))

    def __post_init__(self):
        self.scores = Memo(lambda chunk: self.bias + sum(float(self.weights[bucket(t)]) for t in traits(core(chunk))), WORD_BYTES)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("weights", "bias", "start", "step", "judge")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def summaries(self, counts: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text a constant, the logarithm of its expected toxic words and of the odds of the most toxic one."""
        toxic = Blocks(counts).marginals(score, self.start, self.step)
        found = np.zeros((len(counts), 3))
        found[:, 0], found[:, 1:] = 1, (np.log(1e-3), np.log(1e-4))
        full = np.flatnonzero(counts)
        if len(full):
            begins = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
            # What is below a hundredth is noise that would add up in very long texts.
            found[full, 1] = np.log(np.add.reduceat(np.where(toxic >= 0.01, toxic, 0), begins) + 1e-3)
            top = np.clip(np.maximum.reduceat(toxic, begins), 1e-4, 1 - 1e-4)
            found[full, 2] = np.log(top / (1 - top))
        return toxic, found

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        known = self.scores.__getitem__
        words = [[*map(known, t.split())] if t else [] for t in texts]
        counts = np.array([*map(len, words)], "i8")
        score = np.fromiter((s for w in words for s in w), "f8", int(counts.sum()))
        toxic, found = self.summaries(counts, score)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        ends = np.cumsum(counts)
        for doc in np.unique(np.searchsorted(ends, np.flatnonzero(toxic >= 0.5), "right")):
            marks = toxic[ends[doc] - counts[doc] : ends[doc]] >= 0.5
            for at, word in enumerate(WORD.finditer(texts[doc])):
                if marks[at]:
                    if at and marks[at - 1]:
                        spans[doc][-1] = (spans[doc][-1][0], word.end())
                    else:
                        spans[doc].append((word.start(), word.end()))
        return 1 / (1 + np.exp(-np.clip(found @ self.judge, -30, 30))), spans


def without_copies(rows: list, most_shared: float) -> list:
    """Leaves out texts that share more than most_shared of a small sketch of their words with earlier texts."""
    seen: set[int] = set()
    kept = []
    for row in rows:
        sketch = sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in row["text"].split()})[:6]
        if sketch and sum(s in seen for s in sketch) <= most_shared * len(sketch):
            kept.append(row)
        seen.update(sketch)
    return kept


def evidence(texts: list[set[str]], toxic: np.ndarray) -> set[str]:
    """Traits that toxic texts have significantly more often, with a threshold for as many tests as there are."""
    share = toxic.mean()
    inside, outside = Counter(), Counter()
    for words, label in zip(texts, toxic, strict=True):
        (inside if label else outside).update({t for w in words for t in traits(w)})
    several = {t: n for t, n in inside.items() if n > 1}
    need = np.log(len(several) + 10.0)

    def gain(a, b):
        n = a + b
        return a * np.log(a / (n * share)) + (b * np.log(b / (n * (1 - share))) if b else 0.0)

    return {t for t, n in several.items() if n > 4 * share * (n + outside[t]) / (1 + 3 * share) and gain(n, outside[t]) > need}


def train(documents: DataFrame, marks: DataFrame, per_label: int = 3000, rounds: int = 60, longest: int = 60_000, most_chars: int = 40_000_000, most_shared: float = 0.34, seed: int = 5) -> ToxicModel:
    """Fits on a bounded sample of the labelled rows: at most per_label toxic documents and twice as many others, drawn
    by a hash of doc_id from marks (doc_id, toxic), less those of more than longest characters. Of texts that
    share more than most_shared of a six-word sketch with an earlier one, near copies mostly, the first stays, so that
    a text of many copies is evidence once; at most about most_chars characters come to the driver. Without rows of
    both labels the model gives every text the same low score."""
    marks = marks.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(there) < 2:
        return ToxicModel()
    wanted = {1: per_label, 0: 2 * per_label}
    # At most 3 * per_label ids, so they can go to every executor; texts are read in parallel, and of repeated ids no more come.
    drawn = F.broadcast(bounded_sample(marks, ["doc_id"], {v: (n, wanted[v]) for v, n in there.items()}, "toxic", seed))
    texts = documents.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text").join(drawn, "doc_id")
    texts = stored(bounded_sample(texts, ["doc_id", "text"], {v: (1, wanted[v]) for v in there}, "toxic", seed).select("text", "toxic"), "toxicity-sample")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > most_chars:
        texts = texts.where(F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.lit(1 << 30)) < int(most_chars / size * (1 << 30)))
    rows = ({"text": r["text"], "toxic": r["toxic"]} for r in texts.toLocalIterator())
    rows = without_copies(sorted(rows, key=lambda r: (zlib.crc32(r["text"].encode("utf-8", "surrogatepass")), r["text"])), most_shared)
    label = np.array([r["toxic"] for r in rows], bool)
    if label.all() or not label.any():
        return ToxicModel()
    cores = Memo(core, WORD_BYTES)
    texts = [[cores[w] for w in r["text"].split()] for r in rows]
    marks = evidence([set(t) for t in texts], label)
    index: dict[str, int] = {}
    word = np.fromiter((index.setdefault(w, len(index)) for t in texts for w in t), "i8")
    counts = np.array([*map(len, texts)])
    seed_word = np.array([any(t in marks for t in traits(w)) for w in index], bool)
    truth = seed_word[word] & np.repeat(label, counts)
    # The traits of each distinct word, in rows of equal width; the last bucket stands for none.
    table = np.full((len(index), 4), BUCKETS)
    for at, w in enumerate(index):
        found = [bucket(t) for t in traits(w)]
        table[at, : len(found)] = found
    model, blocks, n = ToxicModel(), Blocks(counts), len(word)
    ends = np.cumsum(counts)
    inner = np.ones(n, bool)
    inner[(ends - counts)[counts > 0]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (np.concatenate([[0], truth[:-1].astype(int)])[inner], truth[inner].astype(int)), 1)
    theta, bias, link = np.zeros(BUCKETS + 1), -4.0, np.zeros((2, 2))
    size = [np.zeros_like(theta), 0.0, np.zeros((2, 2))]
    rate = max(truth.mean(), 1e-6)
    model.start = np.array([1 - rate, rate])
    per_word_truth = np.bincount(word, truth, len(index))
    for _ in range(rounds):
        theta[BUCKETS] = 0
        score = (bias + theta[table].sum(1))[word]
        expected = np.zeros((2, 2))
        toxic = blocks.marginals(score, model.start, np.exp(link), expected)
        slope = per_word_truth - np.bincount(word, toxic, len(index))
        # The strongest pull is shared by all traits of a word; a mild pull to nought keeps rare traits small.
        pull = np.bincount(table.ravel(), np.repeat(slope, 4), BUCKETS + 1) - 0.05 * theta
        expected_first = np.outer(model.start, [1 - toxic[(ends - counts)[counts > 0]].mean(), toxic[(ends - counts)[counts > 0]].mean()]) * (counts > 0).sum()
        steps = [pull, float(slope.sum()), seen - (expected - expected_first) - 0.5 * link]
        size = [s + g * g for s, g in zip(size, steps, strict=True)]
        theta += 0.5 * steps[0] / np.sqrt(size[0] + 1e-6)
        bias += 0.5 * steps[1] / np.sqrt(size[1] + 1e-6)
        link += 0.2 * steps[2] / np.sqrt(size[2] + 1e-6)
        link[0, :] -= link[0, 0]
        link[1, 0], link[1, 1] = np.clip(link[1], -6, 6)
    theta[BUCKETS] = 0
    model = ToxicModel(theta[:BUCKETS].astype("f4"), float(bias), model.start, np.exp(link))
    _, found = model.summaries(counts, (bias + theta[table].sum(1))[word])
    model.judge = fit_judge(found, label, {v: n / max(int((label == bool(v)).sum()), 1) for v, n in there.items()})
    return model


def fit_judge(found: np.ndarray, label: np.ndarray, weight: dict[int, float]) -> np.ndarray:
    """Logistic regression by Newton's method; weights undo the sample's share of labels."""
    w = np.where(label, weight[1], weight[0])
    w = w / w.mean()
    judge = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(found @ judge, -30, 30)))
        slope = found.T @ (w * (label - p)) - 0.5 * judge * [0, 1, 1]
        curve = (found * (w * p * (1 - p))[:, None]).T @ found + np.diag([1e-6, 0.5, 0.5])
        judge = judge + np.linalg.solve(curve, slope)
    return judge


def scored(documents: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted and spans (begin and end offsets of offending words, in code points).

    Null, empty and wordless texts get the score of a text without any toxic word and no spans. Repeated rows give
    repeated results, a null doc_id stays null, an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS

    @tidy
    def run(batches):
        known = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores, spans = [], []
            for begin, end in slices(texts, SLICE_CHARS):
                some, where = known.predict(texts[begin:end])
                scores.append(some)
                spans += where
            score = np.concatenate(scores) if scores else np.zeros(0)
            spans = pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype("i4")), "spans": spans})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<begin:int,end:int>>")


def toxicity_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labelled documents that are not held out and scores all."""
    model = train(documents.select("doc_id", "text"), labels.where(~held_out("doc_id")).select("doc_id", "toxic"))
    return scored(documents, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "spans")
