"""SentencePiece encoding and decoding by streaming Viterbi.

A lattice of pieces is searched left to right, letter by letter. Only the positions that a piece could still start
from survive, a window bounded by the longest piece. Whenever the backpointer paths of all surviving positions meet
in one boundary, the ids before it are final and are committed. Unigram models choose the path of the largest score.
BPE models have one valid path to every position: a piece may follow another only if merging their symbols by score
leaves the two apart; so their paths meet as well, and the ids equal those of the merge procedure.

What a letter does depends only on the window and the piece before it. Such states are compiled into tables when
they are first met, so a letter of a long corpus costs one look-up: the next state and the ids committed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.common import TOLD_BYTES, Memo, portions, shared, tidy

SPACE = "▁"
PAIR_BYTES, PAIRS_BYTES, TABLE_BYTES = 16_000_000, 32_000_000, 64_000_000
ALONE_BYTES = 200_000_000  # of tables, where no other operator's memories are in the worker
# Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def wire_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a serialized message; lengths, fixed and variable integers."""

    def variable(at):
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = variable(at)
        if key & 7 == 0:
            value, at = variable(at)
        else:
            size, at = variable(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Pieces, scores and options of a model. pieces: (text, score, kind) in the order of ids."""

    def __init__(self, pieces, kind: int, dummy_prefix: bool = True, normalize=None):
        self.kind, self.dummy_prefix, self.normalize = kind, dummy_prefix, normalize
        self.texts = [text for text, _, _ in pieces]
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_id = {int(p[0][1:-1], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        self.id_of = {p[0]: i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER_DEFINED)}
        if any(p[2] in (USER_DEFINED, UNUSED) for p in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.score = {p[0]: p[1] for p in pieces if p[2] == NORMAL}
        self.longest = max(map(len, self.id_of), default=1)
        self.least = min(self.score.values(), default=0.0)
        self.heads = {t[:n] for t in self.score for n in range(1, len(t))}  # what may still grow into a piece
        self.touching = {t[i : i + 2] for t in self.score for i in range(len(t) - 1)}
        self.follows = Memo(lambda pair: self.merged(pair[0] + pair[1]) == [*pair], PAIR_BYTES)
        self.stands = Memo(lambda piece: self.merged(piece) == [piece], PAIR_BYTES // 4, self.longest)
        self.tables = Tables(self)
        self.out = [self.bytes_of(text, kind) for text, _, kind in pieces]

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import struct

        import sentencepiece

        with open(path, "rb") as file:
            data = file.read()
        pieces, kind, options = [], UNIGRAM, {}
        for number, value in wire_fields(data):
            if number == 1:
                parts = dict(wire_fields(value))
                pieces.append((parts[1].decode(), struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0, parts.get(3, NORMAL)))
            elif number == 2:
                kind = dict(wire_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                options = dict(wire_fields(value))
        plain = options.get(1) == b"identity" and not options.get(2) and not options.get(4, 1) and options.get(5, 1)
        processor = None if plain else sentencepiece.SentencePieceProcessor(model_file=path)
        return cls(pieces, kind, bool(options.get(3, 1)), processor and processor.normalize)

    @staticmethod
    def bytes_of(text: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(text[1:-1], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode()

    def merged(self, symbols: str) -> list[str]:
        """Merging by score, leftmost first; only pieces and pairs of pieces come here."""
        parts = list(symbols)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(range(len(scores)), key=scores.__getitem__)
            if scores[best] == -np.inf:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def prepared(self, text: str) -> str:
        """The normalized text with spaces as marks."""
        if not text:
            return ""
        if self.normalize:
            return self.normalize(text)
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def ids_of(self, piece: str) -> list[int]:
        found = self.id_of.get(piece)
        if found is not None:
            return [found]
        return [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        state, out = self.tables.start, []
        put = out.append
        for letter in self.prepared(text or ""):
            state, ids = state[letter]
            if ids:
                put(ids)
        put(state.rest)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode(self, ids) -> str:
        """The text of ids: marks become spaces, bytes are put together, the space that encoding put first goes."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class StreamingViterbi:
    """Takes a text letter by letter and hands out ids as soon as they are final."""

    __slots__ = ("model", "previous", "window", "back", "best", "alive")

    def __init__(self, model: PieceModel, previous: str = "", window: str = "", back=(0,), best=(0.0,), alive=(0,)):
        self.model = model
        self.previous = previous  # the piece that ends at the committed boundary, while it could tell on the next ones
        self.window = window  # letters after the last committed boundary
        self.back = back  # for each position of the window, the position that its best or valid path comes from
        self.best = best  # for unigram models, the score of that path
        self.alive = alive  # the positions that a piece could still start from, the end last

    def again(self) -> StreamingViterbi:
        return StreamingViterbi(self.model, self.previous, self.window, self.back, self.best, self.alive)

    def step(self, letter: str) -> None:
        """The path to the position after one more letter; only pieces from surviving positions can end there."""
        model, window, back = self.model, self.window + letter, self.back
        end, best, origin, alive = len(window), -np.inf, -1, []
        previous = self.previous
        if end == 1 and previous and previous[-1] + letter not in model.touching:
            previous = ""  # no merge crosses the boundary
        for begin in self.alive:
            piece = window[begin:]
            if piece in model.heads:
                alive.append(begin)
            score = model.score.get(piece)
            if score is None:
                if begin < end - 1:
                    continue
                score = model.least - UNKNOWN_PENALTY
            if model.kind == BPE:
                before = window[back[begin] : begin] if begin else previous
                if origin < 0 and (model.follows[before, piece] if before else model.stands[piece]):
                    origin = begin
            elif self.best[begin] + score > best:
                best, origin = self.best[begin] + score, begin
        if origin < 0:
            raise ValueError("no piece can end here")
        self.window, self.back, self.alive = window, (*back, origin), (*alive, end)
        if model.kind != BPE:
            self.best = (*self.best, best)
        self.previous = previous if alive and not alive[0] else ""  # unless a further piece starts at the boundary

    def commit(self, final: bool = False) -> list[int]:
        """Ids up to the boundary in which the paths of all surviving positions meet."""
        window, back, end = self.window, self.back, len(self.window)
        alive = [end] if final else [*self.alive]
        while len(alive) > 1:  # the last one steps back until all are one
            origin = back[alive.pop()]
            at = len(alive)
            while at and alive[at - 1] > origin:
                at -= 1
            if not at or alive[at - 1] != origin:
                alive.insert(at, origin)
        boundary = alive[0]
        if not boundary:
            return []
        ids, stop = [], boundary
        while stop:
            begin = back[stop]
            ids[:0] = self.model.ids_of(window[begin:stop])
            stop = begin
        if self.model.kind == BPE:
            piece, follows = window[back[boundary] : boundary], window[boundary : boundary + 1]
            possible = boundary == end or self.alive[0] == boundary and piece[-1] + follows in self.model.touching
            self.previous = piece if possible else ""
        else:
            self.best = tuple(b - self.best[boundary] for b in self.best[boundary:])
        self.window = window[boundary:]
        self.back = (0, *(b - boundary for b in back[boundary + 1 :]))
        self.alive = tuple(p - boundary for p in self.alive)
        return ids

    def push(self, letter: str) -> list[int]:
        self.step(letter)
        return self.commit()

    def whole(self, text: str) -> Iterator[int]:
        for letter in text:
            yield from self.push(letter)
        yield from self.commit(final=True)


class State(dict):
    """A window of the search: letter -> (next state, packed ids that the letter commits)."""

    __slots__ = ("tables", "stream")

    def __init__(self, tables: Tables, stream: StreamingViterbi):
        self.tables, self.stream = tables, stream

    def __missing__(self, letter: str):
        stream = self.stream.again()
        ids = np.array(stream.push(letter), "<i4").tobytes()
        found = self.tables.state(stream), ids
        if self.tables.room(60 + (getsizeof(ids) if ids else 0)):
            self[letter] = found
        return found

    @property
    def rest(self) -> bytes:
        """What the end of the text commits."""
        return np.array(self.stream.again().commit(final=True), "<i4").tobytes()


class Tables:
    """The states met so far, bounded in bytes.

    What is met when they are full is used once and let go; after many such steps, when the texts seem to be others,
    the tables are begun anew.
    """

    def __init__(self, model: PieceModel):
        self.known: dict[tuple[str, str], State] = {}
        self.start = State(self, StreamingViterbi(model))
        self.most = TABLE_BYTES
        self.used = self.steps = self.passing = self.told = 0

    def forget(self) -> None:
        for state in (self.start, *self.known.values()):
            state.clear()
        self.known, self.used, self.steps, self.passing, self.told = {}, 0, 0, 0, 0

    def state(self, stream: StreamingViterbi) -> State:
        key = stream.previous, stream.window
        found = self.known.get(key)
        if found is None:
            found = State(self, stream)
            if self.room(650 + 8 * len(stream.window)):  # the table, the texts and the places of the state
                self.known[key] = found
        return found

    def bound(self, most: int) -> None:
        self.most = most
        if self.used > most:
            self.forget()

    def room(self, size: int) -> bool:
        if self.used + size <= self.most:
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


@lru_cache(maxsize=2)
def loaded(path: str) -> PieceModel:
    return PieceModel.load(path)


def model(path: str, table_bytes: int = TABLE_BYTES) -> PieceModel:
    """The model of a worker process, its tables bounded by table_bytes from here on."""
    found = loaded(path)
    found.tables.bound(table_bytes)
    return found


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(documents: DataFrame, path: str | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, ids and n_ids of every whole text, without begin, end or other control ids.

    A null or empty text has no ids. Repeated rows give repeated results, a null doc_id stays null, further
    columns are ignored, an empty table gives no rows. keep_text also returns the text.
    """
    path = path or default_path()

    @partial(tidy, worker_bytes=PAIRS_BYTES + TABLE_BYTES)
    def run(batches):
        pieces = model(path)
        for batch in portions(batches):
            packed = [pieces.encode_packed(t) for t in batch.column("text").to_pylist()]
            sizes = np.fromiter((len(p) // 4 for p in packed), "i8", len(packed))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), "<i4")))
            columns = {"doc_id": batch.column("doc_id"), "ids": ids, "n_ids": pa.array(sizes)}
            yield pa.RecordBatch.from_pydict(columns | ({"text": batch.column("text")} if keep_text else {}))

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids long" + ", text string" * keep_text)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Replaces ids by the text they stand for, as decoded; null ids give an empty text."""
    path = path or default_path()
    others = [c for c in rows.columns if c not in ("ids", "decoded")]

    @tidy
    def run(batches):
        pieces = model(path)
        for batch in batches:
            texts = pa.array([pieces.decode(ids or ()) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in others} | {"decoded": texts})

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, "ids").mapInArrow(run, f"{schema}, decoded string")


def round_trip(documents: DataFrame, path: str | None = None, table_bytes: int = ALONE_BYTES) -> DataFrame:
    """doc_id, ids, n_ids and exact: whether decoding the ids gives the text again.

    It is false only where the text holds a mark that stands for a space, or where the model normalizes. Null
    texts count as empty. The tables of the search take at most table_bytes in a worker.
    """
    path = path or default_path()

    def run(batches):
        pieces = model(path, table_bytes)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            packed = [pieces.encode_packed(t) for t in texts]
            unpacked = [np.frombuffer(p, "<i4") for p in packed]
            exact = [pieces.decode(ids.tolist()) == (t or "") for ids, t in zip(unpacked, texts, strict=True)]
            sizes = np.fromiter(map(len, unpacked), "i8", len(unpacked))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": ids, "n_ids": pa.array(sizes), "exact": pa.array(exact, pa.bool_())})

    kind = documents.schema["doc_id"].dataType.simpleString()
    bounded = tidy(run, PAIRS_BYTES + table_bytes)
    return documents.select("doc_id", "text").mapInArrow(bounded, f"doc_id {kind}, ids array<int>, n_ids long, exact boolean")
