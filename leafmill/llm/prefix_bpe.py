"""Exact token counts of byte-level BPE by prefix dynamic programming.

For every prefix of a word there is one token that can end its encoding: the one whose pairing with the
token before it survives merging unchanged. So the count of a prefix follows from those of the few prefixes that a token
could still start from. Such sets of prefixes are the states of a table that is compiled as it is met. Each text gets
the counts of all of its prefixes; its own count, whether it is over a limit and where to cut it for a budget are
read off them, and nothing is encoded again.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leafmill.llm.common import TOLD_BYTES, Memo, shared, tidy

# The split pattern of byte-level BPE vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blanks with what follows them: the words before blanks don't depend on them. The blanks are those of the split pattern,
# which str and re take a few more for.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
CHUNK_PATTERN = f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+"
CHUNK_BYTES, PAIR_BYTES, STATE_BYTES, ALL_BYTES = 260_000_000, 24_000_000, 160_000_000, 450_000_000
TOKEN, HEAD = 1, 2


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PrefixCounter:
    """Token counts of every prefix, for a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.vocabulary = {token: token for token in model["vocab"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: at for at, pair in enumerate(pairs)}
        self.split = {a + b: (at, a, b) for (a, b), at in self.rank.items()}  # the last merge of each token
        # No token comes from two merges, and none is merged before its parts.
        self.one_way = len(self.split) == len(self.rank) and all(self.split[x][0] < at for pair, at in self.rank.items() for x in pair if x in self.split)
        letters = dict(enumerate(byte_alphabet()))
        self.symbols = Memo(lambda letter: letter.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters), PAIR_BYTES // 4)
        special = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_strings = special
        self.words = regex.compile(WORD_PATTERN)
        self.follows = Memo(lambda pair: self.apart(*pair), PAIR_BYTES)
        self.stands = Memo(lambda token: self.merged(token) == [token], PAIR_BYTES // 4)
        self.steps_of = Memo(self.chunk_steps, CHUNK_BYTES)
        self.chunks = re.compile(CHUNK_PATTERN)
        self.pieces = dict.fromkeys((t[:n] for t in self.vocabulary for n in range(1, len(t))), HEAD)  # may still grow into a token
        for token in self.vocabulary:
            self.pieces[token] = self.pieces.get(token, 0) | TOKEN
        self.touching = {t[i : i + 2] for t in self.vocabulary for i in range(len(t) - 1)}
        self.states: dict[tuple, Prefixes] = {}
        self.entries: dict[tuple, tuple] = {}  # one object for each entry of the states
        self.start = Prefixes(self, "", ((0, "", 0),))
        self.used = self.steps = self.passing = self.told = 0

    def forget(self) -> None:
        for state in (self.start, *self.states.values()):
            state.clear()
        self.states, self.entries, self.used, self.steps, self.passing, self.told = {}, {}, 0, 0, 0, 0

    def state(self, text: str, held: tuple) -> Prefixes:
        found = self.states.get((text, held))
        if found is None:
            entries = self.entries
            new = len(held) - sum(map(entries.__contains__, held))
            if self.room(400 + 8 * len(held) + 180 * new):
                held = tuple(map(entries.setdefault, held, held))
                self.states[text, held] = found = Prefixes(self, text, held)
            else:
                found = Prefixes(self, text, held)
        return found

    def room(self, size: int) -> bool:
        """Whether the states still fit. What is met when they don't is used once and let go; after many such steps,
        when the texts seem to be others, the states are begun anew."""
        if self.used + size <= STATE_BYTES:
            self.used += size
            self.steps += 1
            if self.used - self.told > TOLD_BYTES:
                self.told = self.used
                shared.grown(self)
            return True
        self.passing += 1
        if self.passing > 8 * self.steps:
            self.forget()
        return False

    def merged(self, symbols: str) -> list[str]:
        """Merging by rank; only tokens and pairs of tokens come here."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether merging leaves two tokens as they are, each of which it makes: merges are undone, latest first, and
        none across the boundary may come before the one that is undone."""
        if not self.one_way:
            return self.merged(left + right) == [left, right]
        if not self.stands[right]:
            return False
        rank, split, a, b = self.rank.get, self.split.get, left, right
        of_a, of_b = split(a), split(b)
        limit = 1 << 60
        while True:
            if rank((a, b), limit) < limit:
                return False
            if of_a and (not of_b or of_a[0] > of_b[0]):
                limit, a = of_a[0], of_a[2]
                of_a = split(a)
            elif of_b:
                limit, b = of_b[0] + 1, of_b[1]  # of equal merges the left one is first
                of_b = split(b)
            else:
                return True

    def word_steps(self, word: str) -> list[int]:
        """The change of a word's count with each letter."""
        state, steps = self.start, []
        for letter in word:
            state, step = state[letter]
            steps.append(step)
        return steps

    def chunk_steps(self, chunk: str) -> bytes:
        if "'" in chunk or chunk[1:2].isspace():  # prefixes of these can have other words
            return np.diff(np.array(self.plain_prefixes(chunk), "i4")).tobytes()
        if not chunk[chunk[0] == " " :].isalpha():  # a blank and letters are one word, what most chunks are
            words = self.words.findall(chunk)
            if len(words) > 1:  # the word is kept for all marks that follow it
                return b"".join(map(self.steps_of.__getitem__, words))
        return array("i", self.word_steps(chunk)).tobytes()

    def plain_table(self, text: str) -> np.ndarray:
        """The counts of all prefixes but the empty one, of a text without special strings."""
        steps = b"".join(map(self.steps_of.__getitem__, self.chunks.findall(text)))
        return np.cumsum(np.frombuffer(steps, "i4"), dtype="i8")

    def table(self, text: str | None) -> np.ndarray:
        """counts[k] is the number of tokens that text[:k] has when it stands alone, k in code points."""
        text = text or ""
        special = self.special is not None and any(s in text for s in self.special_strings)
        counts, base, done, before = [np.zeros(1, "i8")], 0, 0, ""
        for at, piece in enumerate(self.special.split(text) if special else [text]):
            if at % 2:  # a special string; a prefix that ends inside has a beginning of it as plain text
                counts += [base + self.plain_table(before + piece)[len(before) : -1], np.array([done + 1])]
                done += 1
                continue
            base, before = done, piece
            if piece:
                counts.append(base + self.plain_table(piece))
                done = int(counts[-1][-1])
        return np.concatenate(counts)

    def count(self, text: str | None) -> int:
        return int(self.table(text)[-1])

    def plain_prefixes(self, text: str) -> list[int]:
        """The counts of all prefixes, also where a prefix alone has other words than the text: in runs of blanks, which
        keep the last one for the word that follows, and in contractions."""
        counts, blank, base = [0], None, 0
        for match in self.words.finditer(text):
            begin, word = match.start(), match.group()
            ends = [base + n for n in accumulate(self.word_steps(word))]
            total = ends[-1]
            after_blank = blank is not None and blank[1] == begin and word[0].isspace()
            if after_blank:
                ends[0] = blank[2] + sum(self.word_steps(text[blank[0] : begin + 1]))
            if len(word) == 3 and word in ("'re", "'ve", "'ll"):
                ends[1] = base + sum(sum(self.word_steps(w)) for w in self.words.findall(word[:2]))
            run = blank if after_blank else (begin, begin, base)
            blank = (run[0], match.end(), run[2]) if word.isspace() else None
            counts += ends
            base = total
        return counts

    def truncate(self, text: str | None, budget: int) -> tuple[str, int]:
        """The longest prefix whose own encoding has at most budget tokens, and its count."""
        counts = self.table(text)
        end = int(np.flatnonzero(counts <= max(budget, 0))[-1])
        return (text or "")[:end], int(counts[end])


class Prefixes(dict):
    """What the count of longer prefixes of a word depends on: letter -> (next state, change of the count).

    held has, for each position that a token could still start from, how many symbols lie behind it, the token that
    ends there (empty if no merge crosses the position) and its count less that of the whole; text is what lies behind
    the first of them.
    """

    __slots__ = ("counter", "text", "held")

    def __init__(self, counter: PrefixCounter, text: str, held: tuple):
        self.counter, self.text, self.held = counter, text, held

    def __missing__(self, letter: str):
        counter, text, held, change = self.counter, self.text, self.held, 0
        kind_of, follows, stands = counter.pieces.get, counter.follows, counter.stands
        for symbol in counter.symbols[letter]:
            text += symbol
            size, token, step, alive = len(text) - 1, "", 0, []
            for behind, last, count in held:
                piece = text[size - behind :]
                kind = kind_of(piece)
                if kind is None:
                    continue
                if last and not behind and last[-1] + symbol not in counter.touching:
                    last = ""
                if not token and kind & TOKEN and (follows[last, piece] if last else stands[piece]):
                    token, step = counter.vocabulary[piece], count + 1
                if kind & HEAD:
                    alive.append((behind + 1, last, count))
            held = (*[(n, last, count - step) for n, last, count in alive], (0, token, 0))
            text = text[len(text) - held[0][0] :]
            change += step
        found = counter.state(text, held), change
        if counter.room(60):
            self[letter] = found
        return found


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(documents: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text.

    A null or empty text has no bytes and no tokens. Repeated rows give repeated results, a null doc_id stays
    null, further columns are ignored, an empty table gives no rows. Memory is bounded by the batch and by
    memories of words that start anew when full.
    """
    path = path or default_path()

    def run(batches):
        tokens = counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counted = pa.array([tokens.count(t) for t in texts], pa.int64())  # the last place of each text's table
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, counted, pa.array([c > limit for c in counted.to_pylist()], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(tidy(run, ALL_BYTES, collect=False), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def truncated(documents: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, the longest prefix of each text within budget tokens, and that prefix's count, both read off its table.

    A null or empty text, and any with a budget of 0, gives an empty one. Repeated rows give repeated results, a null
    doc_id stays null, further columns are ignored, an empty table gives no rows.
    """
    path = path or default_path()

    def run(batches):
        tokens = counter(path)
        for batch in batches:
            kept = [tokens.truncate(t, budget) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
                names=["doc_id", "text", "n_tokens"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(tidy(run, ALL_BYTES), f"doc_id {kind}, text string, n_tokens long")
