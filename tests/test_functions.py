"""Known values of the symbol and text functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import checks, gs1, text


@pytest.fixture(scope="module")
def of(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("code,check", [("400638133393", 1), ("03600029145", 2), ("978020113447", 6)])
def test_gtin(of, code, check):
    assert of(checks.gtin_check(F.lit(code), len(code))) == check


@pytest.mark.parametrize("six,eight", [("123455", "01234558"), ("123433", "01234337"), ("567894", "05678949")])
def test_upc_e(of, six, eight):
    assert of(checks.upc_e(F.lit(six))) == eight


def test_add_ons(of):
    assert of(checks.five_digit_check(F.lit("52495"))) == 1
    assert of(checks.parity(checks.FIVE_DIGIT_PARITY, F.lit(1))) == "GLGLL"
    assert [of(checks.parity(checks.TWO_DIGIT_PARITY, F.lit(n % 4))) for n in (53, 0, 3)] == ["LG", "LL", "GG"]


def test_mod43(of):
    assert of(checks.mod43(F.lit("1234"))) == 10


def test_element_strings(of):
    parsed = gs1.parse(F.lit("(01)09501101020917(17)261231"))
    assert of(gs1.payload(parsed)) == "010950110102091717261231"
    assert of(gs1.payload(gs1.parse(F.lit("(10)ABC123(21)SER456")))) == "10ABC123\x1d21SER456"
    assert of(gs1.readable(parsed)) == "(01)09501101020917(17)261231"
    assert of(gs1.digital_link(gs1.parse(F.lit("(10)LOT7(01)09520123456788(21)SER9")))) == "https://id.gs1.org/01/09520123456788/10/LOT7/21/SER9"
    assert of(gs1.payload(gs1.parse(F.lit("(417)9501234567895(10)LOT1")))) == "417950123456789510LOT1"
    assert of(gs1.digital_link(gs1.parse(F.lit("(410)9501234567895(414)9501234567895")))) == "https://id.gs1.org/414/9501234567895/410/9501234567895"
    assert of(gs1.path_segment(F.lit("A B/C"))) == "A%20B%2FC" and of(gs1.path_segment(F.lit("A-b_9.z~"))) == "A-b_9.z~"


def test_markers(of):
    assert [of(text.roman(F.lit(n))) for n in (4, 9, 14, 1994)] == ["iv", "ix", "xiv", "mcmxciv"]
    assert [of(text.alphabetic(F.lit(n))) for n in (1, 26, 27, 703)] == ["a", "z", "aa", "aaa"]


def test_wrap(of):
    assert of(text.wrap(F.lit("aa bb  cc dddddddd e"), 5)) == ["aa bb", "cc", "dddddddd", "e"]
    assert of(text.wrap(F.lit(""), 5)) == []


def wrapped(value, width):
    """Line by line and word by word, as the reference does."""
    spaced = re.sub("[\\t\\v\\f \x85\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", " ", value.replace("\r\n", "\n").replace("\r", "\n"))
    words = [w for i, line in enumerate(spaced.split("\n")) for w in ([None] * (i > 0) + line.split(" ")) if w != ""]
    lines, line = [], ""
    for word in words:
        if word is None or line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = ""
        if word is not None and len(word) > width:
            lines += [word[at : at + width] for at in range(0, len(word), width)]
        elif word is not None:
            line = f"{line} {word}" if line else word
    return lines + [line] if line or not words else lines


def test_wrap_text_known(of):
    assert of(text.wrap_text(F.lit("aa bb  cc dddddddd e"), 5)) == ["aa bb", "cc", "ddddd", "ddd", "e"]
    assert of(text.wrap_text(F.lit("a\n\nb c\r\nd"), 5)) == ["a", "", "b c", "d"]
    assert of(text.wrap_text(F.lit("abcdef\ng\n"), 4)) == ["abcd", "ef", "", "g"]
    assert of(text.wrap_text(F.lit(""), 5)) == [""] and of(text.wrap_text(F.lit("\n"), 5)) == [""] and of(text.wrap_text(F.lit(None).cast("string"), 5)) is None


def test_wrap_text_brute_force(spark):
    rng = random.Random(5)
    pieces = ["a", "bc", "déf", "日本語", "x" * 9, "\U0001f600" * 3, "\u00a0", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\r", "\u2003", "\x85", "\u2028", "(", "\\"]
    values = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(600)]
    frame = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    for width in (1, 2, 3, 5, 12):
        found = [r[0] for r in frame.select(text.wrap_text(F.col("v"), width)).collect()]
        assert found == [wrapped(v, width) for v in values]


def test_word_wrap_documents(spark):
    from leafmill.plans import registry

    small = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect()
    found = registry.queries()["word_wrap_documents"](spark, small).select("doc_id", "line_no", "line").collect()
    assert sorted(map(tuple, found)) == sorted((r.doc_id, i, line) for r in texts for i, line in enumerate(wrapped(r.text, 40), 1))
