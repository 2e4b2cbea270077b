"""GS1 element strings and Digital Link addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP_SEPARATOR = "\x1d"
# Identifiers whose values have a fixed length, and that length; (prefix of the identifier, digits).
FIXED_LENGTHS = {"00": 18, "01": 14, "02": 14, "11": 6, "12": 6, "13": 6, "15": 6, "16": 6, "17": 6, "20": 2, "410": 13, "411": 13, "412": 13, "413": 13, "414": 13, "415": 13, "416": 13, "417": 13}
# Primary identification keys of Digital Link addresses, the first of which goes first.
PRIMARY_KEYS = ["01", "8006", "8013", "8010", "414", "417", "8017", "8018", "255", "00", "253", "401", "402", "8003", "8004"]


def parse(text: Column) -> Column:
    """array<struct<ai, value>> of a parenthesised element string, in order; repeats stay."""
    pattern = r"\((\d{2,4})\)([^(]*)"
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(names, values, lambda a, v: F.struct(a.alias("ai"), v.alias("value")))


def is_fixed(ai: Column) -> Column:
    """Weights and measures (31 to 36) have six digits and are fixed too."""
    return ai.isin(*FIXED_LENGTHS) | (F.substring(ai, 1, 2).isin("31", "32", "33", "34", "35", "36") & (F.length(ai) == 4))


def payload(elements: Column) -> Column:
    """The transmitted string: a variable value is ended by a separator unless it is the last."""
    last = F.size(elements) - 1
    part = F.transform(elements, lambda e, i: F.concat(e["ai"], e["value"], F.when(is_fixed(e["ai"]) | (i == last), F.lit("")).otherwise(F.lit(GROUP_SEPARATOR))))
    return F.array_join(part, "")


def readable(elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda e: F.concat(F.lit("("), e["ai"], F.lit(")"), e["value"])), "")


def path_segment(value: Column) -> Column:
    """Everything but unreserved characters is percent-encoded."""
    coded = F.url_encode(value)
    return F.replace(F.replace(F.replace(coded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digital_link(elements: Column, domain: str = "https://id.gs1.org") -> Column:
    """The primary key goes first, the rest in order."""
    keys = F.array(*map(F.lit, PRIMARY_KEYS))
    ranks = F.transform(elements, lambda e, i: F.struct(F.array_position(keys, e["ai"]).alias("r"), i.alias("i")))
    first = F.array_min(F.filter(ranks, lambda x: x["r"] > 0))["i"]
    ordered = bound(first, lambda at: F.concat(F.slice(elements, at + 1, 1), F.filter(elements, lambda e, i: i != at)))
    return F.concat(F.lit(domain), F.array_join(F.transform(ordered, lambda e: F.concat(F.lit("/"), e["ai"], F.lit("/"), path_segment(e["value"]))), ""))
