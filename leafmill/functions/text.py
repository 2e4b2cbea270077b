"""Text kernels of page layout: white space, word wrap, list markers, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numerals, largest first.
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def spaces(text: Column) -> Column:
    """Unicode white space becomes a space, but for line feeds and the no-break space."""
    return F.regexp_replace(line_feeds(text), "[\\t\\x0B\\f\\r \\x85\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]", " ")


def words(text: Column) -> Column:
    return F.filter(F.split(spaces(text), "[ \n]+"), lambda w: w != "")


def wrap(text: Column, width: int) -> Column:
    """Greedy lines of the words alone: line feeds are spaces and a longer word has a line of its own; see wrap_text."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"))

    def add(state, word):
        fits = state["line"].isNotNull() & (F.length(state["line"]) + 1 + F.length(word) <= width)
        lines = F.when(fits | state["line"].isNull(), state["lines"]).otherwise(F.concat(state["lines"], F.array(state["line"])))
        return F.struct(lines.alias("lines"), F.when(fits, F.concat(state["line"], F.lit(" "), word)).otherwise(word).alias("line"))

    return F.aggregate(words(text), start, add, lambda s: F.when(s["line"].isNull(), s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"]))))


def wrap_text(text: Column, width: int) -> Column:
    """Greedy lines of at most width characters; a line feed ends a line, also an empty one.

    A longer word is broken into lines of its own, the last of which takes no further word; a line feed after it leaves
    an empty line, as after any line that is already ended. What follows a last line feed is no line if it is blank; a
    text without words and line feeds is one empty line.
    """
    # A run of whole words that fits and ends before a space, or else the next part of a word that doesn't fit.
    whole = "(?<![^ ])[^ ]" + (f"(?:.{{0,{width - 2}}}[^ ])?" if width > 1 else "") + "(?= |$)"
    pattern = F.lit(f"(?s){whole}|[^ ]{{1,{width}}}")
    hard = F.split(spaces(text), "\n", -1)
    last = F.size(hard) - 1

    def lines(line, at):
        plain = F.trim(F.regexp_replace(line, " +", " "))
        ended = (plain == "") | (F.length(F.substring_index(plain, " ", -1)) > width)
        blank = F.when(ended & ((at < last) | (last == 0) & (plain == "")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.regexp_extract_all(plain, pattern, F.lit(0)), blank)

    return F.flatten(F.transform(hard, lines))


def roman(number: Column) -> Column:
    """Lower-case Roman numeral of 1 to 3999."""
    table = F.array(*(F.struct(F.lit(v).alias("value"), F.lit(t).alias("letters")) for v, t in ROMAN))
    start = F.struct(number.cast("int").alias("left"), F.lit("").alias("text"))

    def take(state, row):
        times = F.floor(state["left"] / row["value"]).cast("int")
        return F.struct((state["left"] % row["value"]).alias("left"), F.concat(state["text"], F.repeat(row["letters"], times)).alias("text"))

    return F.aggregate(table, start, take, lambda state: state["text"])


def alphabetic(number: Column) -> Column:
    """a to z, then aa: bijective base 26, for up to four letters."""
    letter = lambda n: F.char(F.lit(97) + (n - 1) % 26)
    left, text = number.cast("int"), F.lit("")
    for _ in range(4):
        text = F.when(left > 0, F.concat(letter(left), text)).otherwise(text)
        left = F.floor((left - 1) / 26).cast("int")
    return text


def fingerprint(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))
