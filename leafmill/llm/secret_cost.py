"""Secret scan: fixed patterns, and values in a credential's place by the cost of guessing them.

A value's guess cost is that of its cheapest segmentation into common words, dates, repeats, keyboard walks and
brute-force spans; a dynamic programme over its positions finds it. Words are ranked: first the usual parts of
passwords, then the words of a public vocabulary, whose order is that of their frequency. A value that would take many guesses is a
secret; a template such as ${name} or {{name}}, a date or a common word is not. The cost alone decides, so a
rare word of seven letters or more is a secret too.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from leafmill.llm.common import portions, tidy


# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
# Words that name a credential; the value after them is judged by its guess cost.
# Any name may be part of a longer one (dbPassword), but "pass" only where a word begins, as it ends many others.
CONTEXT = re.compile(
    r"""(?:(?:authorization["']?\x20*[:=]\x20*["']?(?:bearer|basic|token)|(?<![A-Za-z])bearer)\x20+["']?"""
    r"""|(?:password|passwd|passphrase|passcode|pwd|(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=P)))pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|authorization)"""
    r"""["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*["']?)([^\s"'<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
# A value that only names where the secret comes from, and words that name how a credential is sent.
TEMPLATE = re.compile(r"\$\{[A-Za-z_][\w.:-]*\}|\{\{[A-Za-z_][\w.:-]*\}\}|%\([A-Za-z_]\w*\)s|%[A-Za-z_]\w*%", re.ASCII)
SCHEMES = {"bearer", "digest", "negotiate"}
# What a text must hold for any of the patterns to match; evaluated without Python for whole batches.
TRIGGER = r"(?i:passw|passphrase|passcode|pwd|pass[\"']?\x20*(?:[:=]|is\x20)|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization)|AKIA|[0-9a-f]{32}"

# Common parts of guessed passwords, most common first; the rank is the cost.
COMMON = (
    "password admin root user login welcome secret qwerty letmein monkey dragon master hello test guest default "
    "changeme example sample demo none null true false your my the key token pass word value string here placeholder "
    "redacted hidden xxxx love abc iloveyou sunshine princess football baseball shadow superman batman trustno "
    "summer winter spring autumn january february march april june july august september october november december "
    "monday tuesday friday sunday company server mysql oracle postgres database prod production dev staging"
).split()
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qwertz", "azerty")
LONGEST_WORD = 20
LEET = str.maketrans("013457@$", "oieastas")
DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])(?:[-./]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:(?:19|20)\d\d|\d\d)", re.ASCII)
DATE_LENGTHS = range(len("2000"), len("31-12-2000") + 1)
WALKS = {a + b for row in KEYBOARD for line in (row, row[::-1]) for a, b in zip(line, line[1:], strict=False)}
SPAN_COST = math.log10(2.0)  # for each further segment: where it ends is unknown
WORD_CHANGED, WORD_LEET, DATE_COST, WALK_COST, RUN_COST, BLOCK_COST = 0.5, 0.7, 4.3, 2.5, 1.0, 1.0
SHORTEST_RUN, LONGEST_BLOCK = 3, 16
# No segment but a walk or a repeat is longer than this.
REACH = max(LONGEST_WORD, LONGEST_BLOCK, DATE_LENGTHS[-1])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def ranks(vocabulary: str) -> dict[str, int]:
    """The rank of each common word, from 1: COMMON, then the vocabulary's words of three letters or more by id.

    The file is one of the tokenizers library; the words are its tokens that begin with a blank.
    """
    with open(vocabulary, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    words = (t[1:] for t in sorted(tokens, key=tokens.__getitem__) if t[0] == "Ġ")
    known = (w.lower() for w in words if SHORTEST_RUN <= len(w) <= LONGEST_WORD and w.isascii() and w.isalpha())
    return {word: at for at, word in enumerate(dict.fromkeys([*COMMON, *known]), 1)}


def alphabet(text: str) -> int:
    """How many characters one would try for each place."""
    classes = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    size = sum(n for test, n in classes if any(map(test, text)))
    return max(size + 33 * any(not c.isalnum() for c in text), 10)


def letter_cost(value: str) -> float:
    return math.log10(16 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else alphabet(value))


def word_cost(span: str, rank: dict[str, int]) -> float:
    """Of a span as a common word, in lower case or with signs for letters; infinite if it is none."""
    lower = span.lower()
    forms = [(rank.get(lower), 0.0), (rank.get(lower.translate(LEET)), WORD_LEET)]
    return min((math.log10(at + 1) + extra for at, extra in forms if at), default=math.inf) + (0.0 if span.islower() else WORD_CHANGED)


def prefixes(value: str, enough: float = math.inf, vocabulary: str | None = None) -> list[tuple[float, str, int]]:
    """(log10 of the guesses, kind, begin) of the cheapest segmentation's last segment, for each prefix.

    Every span is offered as a word, a date, a repeat of the block before it or brute force, and every part of a run
    as a walk or a repeat; as these cost the same at any length, the cheapest one that ends at a position follows
    from the one that ends before it. Every segmentation has a cut in any REACH + 1 places that no walk or
    repeat spans; once all the prefixes that end there cost enough, so does the whole value, and what follows
    isn't looked at.
    """
    rank = ranks(vocabulary or default_vocabulary())
    n, lower, letter = len(value), value.lower(), letter_cost(value)
    best: list[tuple[float, str, int]] = [(0.0, "", 0)]
    brute, never = (math.inf, 0), (math.inf, 0)
    running = {"walk": never, "repeat": never}  # the cheapest that ends here: cost and begin
    length = {"walk": 1, "repeat": 1}  # of the run that ends here
    for end in range(1, n + 1):
        before = best[end - 1][0]
        brute = min((brute[0] + letter, brute[1]), (before + letter + SPAN_COST * (end > 1), end - 1))
        options = [(brute[0], "brute", brute[1])]
        for kind, first, goes_on in (("walk", WALK_COST, lower[end - 2 : end] in WALKS), ("repeat", letter + RUN_COST, end > 1 and lower[end - 2] == lower[end - 1])):
            length[kind] = length[kind] + 1 if goes_on else 1
            running[kind] = running[kind] if goes_on else never
            if length[kind] >= SHORTEST_RUN:
                begin = end - SHORTEST_RUN
                running[kind] = min(running[kind], (best[begin][0] + first + SPAN_COST * (begin > 0), begin))
                options.append((running[kind][0], kind, running[kind][1]))
        for begin in range(max(0, end - LONGEST_WORD), end - SHORTEST_RUN + 1):
            cost = word_cost(value[begin:end], rank)
            if cost < math.inf:
                options.append((best[begin][0] + cost + SPAN_COST * (begin > 0), "word", begin))
        if lower[end - 1].isdigit():
            for size in DATE_LENGTHS:
                if size <= end and DATE.fullmatch(value, end - size, end):
                    options.append((best[end - size][0] + DATE_COST + SPAN_COST * (end > size), "date", end - size))
        for width in range(2, min(LONGEST_BLOCK, end // 2) + 1):  # a block that repeats
            if lower[end - width : end] == lower[end - 2 * width : end - width]:
                options.append((best[end - width][0] + BLOCK_COST + SPAN_COST, "repeat", end - width))
        best.append(min(options))
        if REACH <= end < n and best[end][0] >= enough and max(length.values()) <= REACH and min(best[end - REACH :])[0] >= enough:
            break
    return best


def segments_cost(value: str, vocabulary: str | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """(log10 of the guesses, [(kind, begin, end)]) of the cheapest segmentation."""
    best, end, cuts = prefixes(value, vocabulary=vocabulary), len(value), []
    while end:
        _, kind, begin = best[end]
        cuts.append((kind, begin, end))
        end = begin
    return best[len(value)][0], cuts[::-1]


def takes(value: str, least: float, vocabulary: str | None = None) -> bool:
    """Whether the whole value takes 10**least guesses or more, however long it is."""
    return prefixes(value, least, vocabulary)[-1][0] >= least


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, least: float, vocabulary: str | None = None) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of values in a credential's place that take 10**least guesses or more."""
    found, at = [], 0
    while m := CONTEXT.search(text, at):
        at = m.end()
        value = m.group(1).rstrip(".,:!?)]}")
        if value.lower() in SCHEMES:  # the value comes after it
            at = m.start(1)
            continue
        if len(value) < 6 or TEMPLATE.fullmatch(m.group(1).rstrip(".,:!?")):
            continue
        if takes(value, least, vocabulary):
            found.append((m.start(1), 3, m.start(1) + len(value)))
    return found


def spans_of(text: str | None, least: float = 9.0, vocabulary: str | None = None) -> list[tuple[int, int, int]]:
    """All spans; the method adds those that no base span covers."""
    if not text:
        return []
    base = base_spans(text)
    more = [s for s in guess_spans(text, least, vocabulary) if not any(b <= s[0] and s[2] <= e for b, _, e in base)]
    return sorted({*base, *more})


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{begin}:{end}" for begin, kind, end in spans)


def redacted_text(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by the mark."""
    if not spans:
        return text
    parts, done = [], 0
    for begin, _, end in spans:
        if begin >= done:
            parts += [text[done:begin], mark]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def candidates(column: pa.Array) -> list[bool]:
    """Which texts can hold a span at all."""
    return pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), TRIGGER), False).to_pylist()


def scanned(documents: DataFrame, least: float = 9.0, vocabulary: str | None = None) -> DataFrame:
    """doc_id, the numbers of base spans by kind, the digest of the base spans and all spans as text.

    A null or empty text has no spans: the digest is that of the empty string. Repeated rows give repeated
    results, a null doc_id stays null, an empty table gives no rows. Offsets are code points, ends exclusive.
    """
    nothing = hashlib.sha256(b"").hexdigest()

    @tidy
    def run(batches):
        for batch in batches:
            column = batch.column("text")
            counts, digests, texts = ([], [], []), [], []
            for may, value in zip(candidates(column), column, strict=True):
                spans = spans_of(value.as_py(), least, vocabulary) if may else []
                base = [s for s in spans if s[1] < 3]
                for kind in range(3):
                    counts[kind].append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest() if base else nothing)
                texts.append(written(spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(documents: DataFrame, least: float = 9.0, mark: str = "[SECRET]", vocabulary: str | None = None) -> DataFrame:
    """The documents with every span replaced by a mark; all rows and columns stay. A null text stays null."""
    names = documents.columns

    @tidy
    def run(batches):
        for batch in portions(batches):
            column = batch.column("text")
            may = candidates(column)
            if not any(may):
                yield batch
                continue
            texts = [redacted_text(t, spans_of(t, least, vocabulary), mark) if m else t for m, t in zip(may, column.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return documents.mapInArrow(run, documents.schema)


def secret_query(documents: DataFrame) -> DataFrame:
    return scanned(documents)
