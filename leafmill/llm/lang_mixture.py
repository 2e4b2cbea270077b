"""Language identification by multilingual mixture inference.

Every word of a document is drawn from one of several languages; its likelihood under a language comes from
character n-grams. Expectation-maximisation estimates the document's language proportions, and a penalised
likelihood chooses which languages it has. Most documents need no iteration: where even the best language of
each word together gains less than the penalty over the best single language, no mixture can win.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import ENTRY_BYTES, bounded_sample, held_out, portions, shared, slices, stored, tidy

UNDETERMINED = "und"
# A run of letters longer than this counts as several words, so that a word's arrays stay small.
LETTERS = re.compile(r"[^\W\d_]{1,4096}")
# \w also takes number signs such as ² or Ⅷ, which are no letters.
NUMBER_SIGN = re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and unicodedata.category(c)[0] != "L") + "]")
BUCKETS = 1 << 17
CHUNK_BYTES, LONGEST_KEPT = 40_000_000, 64
SLICE_CHARS, BATCH_CHARS = 2_000_000, 130_000
# Odd factors of a multiply-shift hash of code points.
FACTORS = np.random.default_rng(5).integers(1 << 63, size=6, dtype="u8") * np.uint64(2) + np.uint64(1)
SHIFT = np.uint64(64 - 17)
POWERS = np.cumprod(np.full(4098, FACTORS[5]))


def words_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    text = text.lower()
    words = LETTERS.findall(text)
    if words and not "".join(words).isalpha():
        words = LETTERS.findall(NUMBER_SIGN.sub(" ", text))
    return words


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 2-grams and 3-grams at each position of the words with their ends marked, BUCKETS where
    none begins, the bucket of each whole word, and where each word begins."""
    sizes = np.fromiter(map(len, words), "i8", len(words)) + 2
    begins = np.cumsum(sizes) - sizes
    codes = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    place = np.arange(len(codes)) - np.repeat(begins, sizes)
    left = np.repeat(sizes, sizes) - place
    second, third = np.append(codes[1:], codes[:1]), np.append(codes[2:], codes[:2])
    two = np.where(left > 1, ((codes * FACTORS[0] + second * FACTORS[1]) >> SHIFT).astype("i8"), BUCKETS)
    three = np.where(left > 2, ((codes * FACTORS[2] + second * FACTORS[3] + third * FACTORS[4]) >> SHIFT).astype("i8"), BUCKETS)
    return two, three, (np.add.reduceat(codes * POWERS[place], begins) >> SHIFT).astype("i8"), begins


@dataclass(eq=False)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # log-likelihood of each bucket under each language
    prior: np.ndarray

    def __post_init__(self):
        self.padded = np.vstack([self.table, np.zeros((1, self.table.shape[1]))]).astype("f4")
        self.forget()

    def __getstate__(self):
        return {"languages": self.languages, "table": self.table, "prior": self.prior}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def forget(self) -> None:
        self.chunks: dict[str, bytes] = {}
        self.used, self.passing = 0, []

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of words. Grams overlap, each letter counts in two, so their sum is halved."""
        found = np.empty((len(words), len(self.languages)), "f4")
        for begin, end in slices(words, BATCH_CHARS):
            two, three, whole, begins = buckets(words[begin:end])
            found[begin:end] = (np.add.reduceat(self.padded[two] + self.padded[three], begins, axis=0) + self.padded[whole]) / 2
        return found

    def learn_chunks(self, wanted: set[str]) -> None:
        """Puts the packed scores of the words of each chunk (what stands between two blanks) into the memory, which is
        bounded in bytes between two calls; long chunks stay for one call."""
        for chunk in self.passing:
            del self.chunks[chunk]
        if self.used > CHUNK_BYTES:  # those that are wanted again stay
            self.chunks = {c: self.chunks[c] for c in wanted if c in self.chunks}
            self.used = sum(sys.getsizeof(c) + sys.getsizeof(p) + ENTRY_BYTES for c, p in self.chunks.items())
        new = [c for c in wanted if c not in self.chunks]
        self.passing = [c for c in new if len(c) > LONGEST_KEPT]
        words = [words_of(c) for c in new]
        packed = self.word_scores([w for ws in words for w in ws]).tobytes()
        at, width = 0, 4 * len(self.languages)
        for chunk, ws in zip(new, words, strict=True):
            end = at + width * len(ws)
            self.chunks[chunk] = packed[at:end]
            at = end
            if len(chunk) <= LONGEST_KEPT:
                self.used += sys.getsizeof(chunk) + sys.getsizeof(self.chunks[chunk]) + ENTRY_BYTES
        shared.grown(self)

    def predict(self, texts: list[str | None], penalty: float, rounds: int) -> tuple[list[str], list[float], list[list[tuple[str, float]]]]:
        k = len(self.languages)
        split = [t.split() if t else [] for t in texts]
        self.learn_chunks(set().union(*split))
        packed = [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in split]
        del split
        counts = np.array([len(p) // (4 * k) for p in packed])
        rows = np.frombuffer(b"".join(packed), "f4").reshape(-1, k).astype("f8")
        full = np.flatnonzero(counts)
        labels, scores, sets = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if not len(full):
            return labels, scores, sets
        starts = np.concatenate([[0], np.cumsum(counts)])
        single = np.add.reduceat(rows, starts[full], axis=0)
        ceiling = np.add.reduceat(rows.max(1), starts[full])
        total = single + self.prior
        posterior = np.exp(total - total.max(1, keepdims=True))
        posterior /= posterior.sum(1, keepdims=True)
        best = total.argmax(1)
        cost = penalty * np.log(counts[full] + 1.0) + penalty
        for at, doc in enumerate(full):
            chosen, share = [int(best[at])], [1.0]
            if ceiling[at] - single[at, best[at]] > cost[at]:
                chosen, share = self.mixture(rows[starts[doc] : starts[doc + 1]], int(best[at]), cost[at], rounds)
            top = int(np.argmax(share))
            labels[doc] = self.languages[chosen[top]]
            scores[doc] = float(posterior[at, chosen[top]] if len(chosen) == 1 else share[top])
            sets[doc] = [(self.languages[c], float(s)) for c, s in zip(chosen, share, strict=True)]
        return labels, scores, sets

    @staticmethod
    def proportions(rows: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """EM over the given languages: their shares and the log-likelihood."""
        peak = rows.max(1)
        weight = np.exp(rows - peak[:, None])
        share = np.full(rows.shape[1], 1 / rows.shape[1])
        for _ in range(rounds):
            joint = weight * share
            share = (joint / joint.sum(1, keepdims=True)).mean(0)
        return share, float(peak.sum() + np.log(np.maximum(weight @ share, 1e-300)).sum())

    def mixture(self, rows: np.ndarray, first: int, cost: float, rounds: int) -> tuple[list[int], list[float]]:
        """Adds the language that gains most while the gain is above the cost of one more language."""
        chosen, share, value = [first], np.ones(1), float(rows[:, first].sum())
        while len(chosen) < rows.shape[1]:
            peak = rows[:, chosen].max(1)
            others = [c for c in range(rows.shape[1]) if c not in chosen]
            if np.maximum(rows.max(1) - peak, 0).sum() + (peak.sum() - value) <= cost:
                break
            tried = [(*self.proportions(rows[:, [*chosen, c]], rounds), c) for c in others]
            new_share, new_value, added = max(tried, key=lambda x: x[1])
            if new_value - value <= cost:
                break
            chosen, share, value = [*chosen, added], new_share, new_value
        return chosen, share.tolist()


def train(labelled: DataFrame, per_language: int = 1500, longest: int = 200_000, seed: int = 11) -> LanguageModel:
    """Fits on a bounded sample: at most per_language texts of each non-null language, those with the least hash of
    doc_id and text, of at most longest characters.

    Without any labelled text the model has no language and every prediction is `und`.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text", "lang")
    there = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not there:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    drawn = bounded_sample(labelled, ["doc_id", "text"], {v: (n, per_language) for v, n in there.items()}, "lang", seed)
    rows = stored(drawn.select("text", "lang"), "language-sample").toLocalIterator()  # drawn in parallel, read one part at a time
    languages = sorted(there)
    counts = {v: Counter() for v in languages}
    for row in rows:
        counts[row["lang"]].update(words_of(row["text"]))
    table = np.zeros((BUCKETS, len(languages)))
    for at, value in enumerate(languages):
        words, often = list(counts[value]), np.sqrt(np.fromiter(counts[value].values(), "f8"))  # a word that repeats says less each time
        for begin, end in slices(words, BATCH_CHARS):
            two, three, whole, begins = buckets(words[begin:end])
            weight = often[begin:end]
            each = np.repeat(weight, np.diff(begins, append=len(two)))
            for marks, by in ((two, each), (three, each), (whole, weight)):
                table[:, at] += np.bincount(marks, by, BUCKETS + 1)[:BUCKETS]
    mass = table.sum(0, keepdims=True)
    table = np.log((table + 0.3) / (mass + 0.3 * BUCKETS))
    total = sum(there.values())
    return LanguageModel(languages, table.astype("f4"), np.log(np.array([(there[v] + 1) / (total + len(languages)) for v in languages])))


def identify(documents: DataFrame, model: LanguageModel, penalty: float = 3.0, rounds: int = 12, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, languages (those chosen with their shares) of every whole text.

    A text that is null or has no letter is `und` with score 0 and no languages. Repeated rows give repeated
    results and a null doc_id stays null; an empty table gives no rows. keep names columns of documents to
    carry along.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the languages
    wanted = ["doc_id", *[c for c in keep if c != "doc_id"]]

    @tidy
    def run(batches):
        known = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            labels, scores, sets = [], [], []
            for begin, end in slices(texts, SLICE_CHARS):
                for into, values in zip((labels, scores, sets), known.predict(texts[begin:end], penalty, rounds) if known.languages else ([UNDETERMINED] * (end - begin), [0.0] * (end - begin), [[]] * (end - begin)), strict=True):
                    into += values
            sets = pa.array([[{"lang": v, "share": s} for v, s in x] for x in sets], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            columns = {c: batch.column(c) for c in wanted}
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64()), "languages": sets})

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in wanted)
    return documents.select(*dict.fromkeys([*wanted, "text"])).mapInArrow(run, f"{schema}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def with_language(documents: DataFrame, model: LanguageModel, penalty: float = 3.0, rounds: int = 12) -> DataFrame:
    """The documents that have a language, with lang set to it; those found `und` go, other columns stay."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns

    @partial(tidy, keep=False)
    def run(batches):
        known = sent.value
        for batch in portions(batches):
            texts = batch.column("text").to_pylist()
            labels = []
            for begin, end in slices(texts, SLICE_CHARS):
                labels += known.predict(texts[begin:end], penalty, rounds)[0] if known.languages else [UNDETERMINED] * (end - begin)
            new = pa.RecordBatch.from_arrays([pa.array(labels, pa.string()) if n == "lang" else batch.column(n) for n in names], names=names)
            yield new.filter(pa.array([v != UNDETERMINED for v in labels], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def language_query(documents: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all."""
    model = train(documents.where(~held_out("doc_id")))
    found = identify(documents, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages")
