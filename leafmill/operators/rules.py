"""Conformance rules as queries over the tables of parsed files; each yields the assertions table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import relational as R

# Limits of the file format.
LARGEST_INTEGER, LONGEST_STRING, LONGEST_NAME, MOST_OBJECTS, DEEPEST_STATE = 2147483647, 32767, 127, 8388607, 28
FORBIDDEN_ACTIONS = ["Launch", "Sound", "Movie", "ResetForm", "ImportData", "Hide", "SetOCGState", "Rendition", "Trans", "GoTo3DView", "JavaScript"]
NAMED_ACTIONS = ["NextPage", "PrevPage", "FirstPage", "LastPage"]
FORBIDDEN_ANNOTATIONS = ["3D", "Sound", "Screen", "Movie"]
RENDERING_INTENTS = ["AbsoluteColorimetric", "RelativeColorimetric", "Perceptual", "Saturation"]
LANGUAGE_TAG = r"^$|^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    clause: str
    profiles: tuple[str, ...]
    severity: str
    query: Callable[[dict], DataFrame]  # doc_id, message, object_ref


ARCHIVE, TAGGED, UA = ("2b", "2u", "2a"), ("2a",), ("ua1",)
RULES: list[Rule] = []


def rule(rule_id: str, profiles: tuple[str, ...], severity: str = "Error"):
    def add(query):
        RULES.append(Rule(rule_id, rule_id.rpartition("-")[0], profiles, severity, query))
        return query

    return add


def said(rows: DataFrame, message: str, where: str = "CAST(NULL AS STRING)") -> DataFrame:
    return rows.select("doc_id", F.lit(message).alias("message"), F.expr(where).alias("object_ref"))


OBJECT = "concat(obj_num, ' 0 R')"


@rule("6.1.2-1", ARCHIVE)
def header(t):
    return said(t["status"].where("status = 'read' AND NOT detail RLIKE '^%PDF-1\\\\.[0-7]'"), "the file does not begin with a version header")


@rule("6.1.3-1", ARCHIVE)
def trailer_id(t):
    return said(t["trailers"].where("get_json_object(value, '$.ID') IS NULL"), "the trailer has no ID")


@rule("6.1.6-1", ARCHIVE)
def even_hex_strings(t):
    return said(t["objects"].where("json RLIKE '\"<([0-9A-Fa-f]{2})*[0-9A-Fa-f]\"'"), "a hexadecimal string has an odd number of digits", OBJECT)


@rule("6.1.7.1-2", ARCHIVE)
def stream_length(t):
    return said(t["streams"].where("recovered"), "the Length of a stream is wrong", OBJECT)


@rule("6.1.7.1-3", ARCHIVE)
def external_stream(t):
    return said(t["streams"].where("get_json_object(json, '$.F') IS NOT NULL OR get_json_object(json, '$.FFilter') IS NOT NULL"), "a stream refers to an external file", OBJECT)


@rule("6.1.7.2-1", ARCHIVE)
def no_lzw(t):
    return said(t["streams"].where("get_json_object(json, '$.Filter') LIKE '%/LZW%' OR get_json_object(json, '$.Filter') LIKE '%/Crypt%'"), "a stream uses a filter that is not allowed", OBJECT)


@rule("6.1.13-1", ARCHIVE)
def integers(t):
    number = F.explode(F.regexp_extract_all("json", F.lit(r"(?<![\"\w.])(-?\d{10,18})(?![\w.\"])"), F.lit(1)))
    rows = t["objects"].where("json RLIKE '[0-9]{10}'").select("doc_id", "obj_num", number.alias("n")).where(F.abs(F.col("n").cast("long")) > LARGEST_INTEGER)
    return said(rows.select("doc_id", "obj_num").distinct(), "an integer is out of range", OBJECT)


@rule("6.1.13-3", ARCHIVE)
def strings(t):
    return said(t["objects"].where(f"exists(regexp_extract_all(json, '\"[(]((?:[^\"\\\\\\\\]|\\\\\\\\.)*)\"', 1), s -> length(s) > {LONGEST_STRING})"), "a string is too long", OBJECT)


@rule("6.1.13-4", ARCHIVE)
def names(t):
    return said(t["objects"].where(f"json RLIKE '\"/[^\"]{{{LONGEST_NAME + 1},}}\"'"), "a name is too long", OBJECT)


@rule("6.1.13-7", ARCHIVE)
def object_count(t):
    rows = t["xref"].where("NOT is_free").groupBy("doc_id").agg(F.countDistinct("obj_num").alias("n")).where(F.col("n") > MOST_OBJECTS)
    return said(rows, "the file has too many objects")


@rule("6.1.13-8", ARCHIVE)
def state_depth(t):
    change = F.when(F.col("operator") == "q", 1).when(F.col("operator") == "Q", -1).otherwise(0)
    rows = R.depth(t["content_ops"].where("operator IN ('q', 'Q')"), ["doc_id", "page_no"], [F.col("seq")], change).where(F.col("depth") > DEEPEST_STATE)
    return said(rows.select("doc_id", "page_no").distinct(), "graphics states nest too deeply", "concat('page ', page_no)")


@rule("6.2.6-1", ARCHIVE)
def rendering_intents(t):
    rows = t["content_ops"].where(F.col("operator") == "ri").withColumn("intent", F.substring(F.get_json_object("operands", "$[0]"), 2, 100)).where(~F.col("intent").isin(RENDERING_INTENTS))
    return said(rows, "an unknown rendering intent", "concat('page ', page_no)")


@rule("6.2.11.4.1-1", ARCHIVE)
def embedded_fonts(t):
    rows = t["fonts"].where("used AND get_json_object(font, '$.Subtype') NOT IN ('/Type3', '/Type0')")
    references = rows.select("doc_id", "page_no", "res_name", F.get_json_object("font", "$.FontDescriptor.$ref[0]").cast("long").alias("d"))
    descriptors = t["objects"].where("json LIKE '%\"FontFile%'").select(F.col("doc_id").alias("f"), "obj_num")
    return said(R.unresolved(references, descriptors, (F.col("doc_id") == F.col("f")) & (F.col("d") == F.col("obj_num"))), "a used font has no font program", "concat('page ', page_no, ' ', res_name)")


@rule("6.3.1-1", ARCHIVE)
def annotation_types(t):
    return said(t["annotations"].where(F.substring(F.get_json_object("dict", "$.Subtype"), 2, 50).isin(FORBIDDEN_ANNOTATIONS)), "an annotation type that is not allowed", "concat('page ', page_no, ' annotation ', idx)")


@rule("6.5.1-1", ARCHIVE)
def actions(t):
    return said(t["objects"].where(F.expr("'/' || nvl(substring(get_json_object(json, '$.S'), 2), '')").isin(["/" + a for a in FORBIDDEN_ACTIONS])), "an action that is not allowed", OBJECT)


@rule("6.5.1-2", ARCHIVE)
def named_actions(t):
    rows = t["objects"].where("get_json_object(json, '$.S') = '/Named'").where(~F.coalesce(F.substring(F.get_json_object("json", "$.N"), 2, 50), F.lit("")).isin(NAMED_ACTIONS))
    return said(rows, "a named action that is not allowed", OBJECT)


@rule("6.5.2-1", ARCHIVE)
def additional_actions(t):
    return said(t["catalogs"].where("get_json_object(value, '$.AA') IS NOT NULL"), "the catalog has additional actions")


@rule("6.6.2.1-1", ARCHIVE)
def metadata(t):
    return said(t["catalogs"].where("get_json_object(value, '$.Metadata') IS NULL"), "the catalog has no metadata")


@rule("6.7.2.2-1", TAGGED)
def marked(t):
    return said(t["catalogs"].where("NOT get_json_object(value, '$.MarkInfo.Marked') <=> 'true'"), "the file is not marked as tagged")


@rule("6.7.4-1", TAGGED)
def language_tags(t):
    language = F.substring(F.get_json_object("value", "$.Lang"), 2, 200)
    return said(t["catalogs"].where(~language.rlike(LANGUAGE_TAG)), "the language is no language tag")


@rule("7.1-8", UA)
def ua_metadata(t):
    return said(t["catalogs"].where("get_json_object(value, '$.Metadata') IS NULL"), "the catalog has no metadata")


@rule("7.1-10", UA)
def title_shown(t):
    return said(t["catalogs"].where("NOT get_json_object(value, '$.ViewerPreferences.DisplayDocTitle') <=> 'true'"), "the title is not displayed")


@rule("7.1-11", UA)
def structure(t):
    return said(t["catalogs"].where("get_json_object(value, '$.StructTreeRoot') IS NULL"), "there is no structure tree")


@rule("6.2-1", UA)
def ua_marked(t):
    return said(t["catalogs"].where("NOT get_json_object(value, '$.MarkInfo.Marked') <=> 'true'"), "the file is not marked as tagged")


@rule("7.2-34", UA)
def natural_language(t):
    return said(t["catalogs"].where("get_json_object(value, '$.Lang') IS NULL"), "no natural language is given")


@rule("7.18.3-1", UA)
def tab_order(t):
    return said(t["pages"].where("get_json_object(json, '$.Annots[0]') IS NOT NULL AND NOT get_json_object(json, '$.Tabs') <=> '/S'"), "a page with annotations has another tab order than by structure", "concat('page ', page_no)")


@rule("7.21.4.1-1", UA)
def ua_fonts(t):
    return embedded_fonts(t)


def assertions(tables: dict[str, DataFrame], profiles: tuple[str, ...] = ("2b", "2u", "2a", "ua1")) -> DataFrame:
    """doc_id, profile, rule_id, clause, severity, message, object_ref of readable files.

    A rule whose query can't be built gives one error for every file and the others go on. Unsupported and damaged
    files are in `status`, never among the violations.
    """
    parts = []
    for r in RULES:
        wanted = [p for p in r.profiles if p in profiles]
        if not wanted:
            continue
        try:
            rows = r.query(tables)
        except Exception as error:  # the contract: a failing rule is a finding, not an end
            rows = tables["status"].where("status = 'read'").select("doc_id", F.lit(f"Rule evaluation failed: {error}").alias("message"), F.lit(None).cast("string").alias("object_ref"))
        named = rows.select("doc_id", F.lit(r.rule_id).alias("rule_id"), F.lit(r.clause).alias("clause"), F.lit(r.severity).alias("severity"), "message", "object_ref")
        parts.append(named.withColumn("profile", F.explode(F.array(*map(F.lit, wanted)))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def claimed_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """doc_id, profile that a file's metadata claims, in attribute or element form."""
    streams = tables["streams"].where("get_json_object(json, '$.Subtype') = '/XML'").select("doc_id", F.decode("decoded", "UTF-8").alias("xml"))
    found = lambda name: F.regexp_extract("xml", rf"pdf(?:a|ua)id:{name}(?:>|\s*=\s*[\"'])\s*([^<\"'\s]+)", 1)
    ua = F.when(F.regexp_extract("xml", r"pdfuaid:part(?:>|\s*=\s*[\"'])\s*(\d)", 1) == "1", "ua1")
    archive = F.when(F.regexp_extract("xml", r"pdfaid:part(?:>|\s*=\s*[\"'])\s*(\d)", 1) == "2", F.when(F.upper(found("conformance")).isin("A", "B", "U"), F.concat(F.lit("2"), F.lower(found("conformance")))))
    return streams.select("doc_id", F.explode(F.array_compact(F.array(archive, ua))).alias("profile")).distinct()
