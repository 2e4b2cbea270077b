"""Check digits and checksums of linear symbologies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character set of the mod-43 check and the parities of the add-on symbols.
MOD43 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-. $/+%"
FIVE_DIGIT_PARITY = ["GGLLL", "GLGLL", "GLLGL", "GLLLG", "LGGLL", "LLGGL", "LLLGG", "LGLGL", "LGLLG", "LLGLG"]
TWO_DIGIT_PARITY = ["LL", "LG", "GL", "GG"]


def digit(code: Column, at: int | Column) -> Column:
    return F.substring(code, at, 1).cast("int") if isinstance(at, int) else F.substr(code, at, F.lit(1)).cast("int")


def gtin_check(code: Column, length: int) -> Column:
    """Weights 3 and 1 in turn from the right."""
    total = sum((digit(code, i) * (3 if (length - i) % 2 == 0 else 1) for i in range(1, length + 1)), F.lit(0))
    return (10 - total % 10) % 10


def five_digit_check(code: Column) -> Column:
    return sum((digit(code, i) * (3 if i % 2 else 9) for i in range(1, 6)), F.lit(0)) % 10


def parity(table: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, table)), at + 1)


def upc_a_body(six: Column) -> Column:
    """The eleven digits without check that a six-digit zero-suppressed code stands for."""
    part = lambda a, n: F.substring(six, a, n)
    last = part(6, 1)
    return F.concat(
        F.lit("0"),
        F.when(last.isin("0", "1", "2"), F.concat(part(1, 2), last, F.lit("0000"), part(3, 3)))
        .when(last == "3", F.concat(part(1, 3), F.lit("00000"), part(4, 2)))
        .when(last == "4", F.concat(part(1, 4), F.lit("00000"), part(5, 1)))
        .otherwise(F.concat(part(1, 5), F.lit("0000"), last)),
    )


def upc_e(six: Column) -> Column:
    return F.concat(F.lit("0"), six, gtin_check(upc_a_body(six), 11).cast("string"))


def mod43(text: Column) -> Column:
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda total, c: total + F.position(c, F.lit(MOD43)) - 1) % 43


def code128_b(text: Column) -> Column:
    """The mod-103 check of a text in code set B."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    weighted = F.transform(letters, lambda c, i: (i + 1) * (F.ascii(c) - 32))
    return F.aggregate(weighted, F.lit(104), lambda total, x: total + x) % 103


def exclusive_or(text: Column) -> Column:
    """XOR of the characters' codes, the parity of structured append."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda total, c: total.bitwiseXOR(F.ascii(c)))
