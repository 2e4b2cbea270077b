import json

import pytest
from pdf_files import classic, packed, plain, stream, updated

from leafmill.functions import filters
from leafmill.operators import rules
from leafmill.sources.pdf import tables
from leafmill.sources.pdf.document import Document

FULL = b"/Lang (en) /MarkInfo << /Marked true >> /ViewerPreferences << /DisplayDocTitle true >> /StructTreeRoot 6 0 R /Metadata 7 0 R"
XMP = b'<x:xmpmeta><rdf:Description pdfaid:part="2" pdfaid:conformance="B"/><pdfuaid:part>1</pdfuaid:part></x:xmpmeta>'


@pytest.fixture(scope="module")
def found(spark):
    whole = {6: b"<< /Type /StructTreeRoot >>", 7: stream(XMP, b"/Type /Metadata /Subtype /XML")}
    files = {
        "plain": plain(),
        "full": plain(FULL, extra=whole),
        "nested": plain(content=b"q " * 30 + b"Q " * 30),
        "script": plain(extra={6: b"<< /S /JavaScript /JS (x) >>", 7: b"<5>", 8: b"4294967296"}),
        "length": plain(extra={6: stream(b"real body", length=64)}),
        "encrypted": plain(trailer=b"/Root 1 0 R /Encrypt 9 0 R"),
        "broken": b"%PDF-1.7 nothing",
        "empty": b"",
        "freed": updated(plain(), 5, None),
        "newer": updated(plain(), 5, b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"),
        "packed": packed(),
        "noid": plain(trailer=b"/Root 1 0 R"),
    }
    items = tables.parsed(tables.from_bytes(spark, files)).cache()
    return tables.views(items)


def test_status(found):
    status = {r.doc_id: r.status for r in found["status"].collect()}
    assert status["encrypted"] == "unsupported" and status["broken"] == status["empty"] == "damaged"
    assert status["plain"] == status["packed"] == "read"


def test_revisions_and_newest(found):
    assert {r.doc_id: r["count"] for r in found["revisions"].groupBy("doc_id").count().collect()}["newer"] == 2
    objects = {(r.doc_id, r.obj_num): r.json for r in found["objects"].collect()}
    assert "Courier" in objects["newer", 5] and ("freed", 5) not in objects and "Helvetica" in objects["plain", 5]


def test_packed_objects_resolve(found):
    pages = found["pages"].where("doc_id = 'packed'").collect()
    assert [p.obj_num for p in pages] == [3]
    assert {r.obj_num for r in found["objects"].where("doc_id = 'packed' AND container = 4").collect()} == {1, 2, 3}


def test_content_and_fonts(found):
    ops = [r.operator for r in found["content_ops"].where("doc_id = 'plain'").orderBy("seq").collect()]
    assert ops == ["q", "BT", "Tf", "Tj", "ET", "Q"]
    assert {r.res_name: r.used for r in found["fonts"].where("doc_id = 'plain'").collect()} == {"F1": True, "F2": False}
    page = found["pages"].where("doc_id = 'plain'").first()
    assert json.loads(page.json)["MediaBox"] == [0, 0, 612, 792]


def test_recovered_length(found):
    row = found["streams"].where("doc_id = 'length' AND obj_num = 6").first()
    assert row.recovered and bytes(row.raw) == b"real body"


def test_rules(found):
    failed = {(r.doc_id, r.profile, r.rule_id) for r in rules.assertions(found).collect()}
    assert ("plain", "ua1", "7.2-34") in failed and ("full", "ua1", "7.2-34") not in failed
    assert {r for d, p, r in failed if d == "full" and p == "2a"} == {"6.2.11.4.1-1"}
    assert ("nested", "2b", "6.1.13-8") in failed and ("plain", "2b", "6.1.13-8") not in failed
    assert {("script", "2b", r) for r in ("6.5.1-1", "6.1.6-1", "6.1.13-1")} <= failed
    assert ("length", "2b", "6.1.7.1-2") in failed and ("noid", "2b", "6.1.3-1") in failed
    assert not any(d in ("encrypted", "broken", "empty") for d, _, _ in failed)


def test_claimed_profiles(found):
    assert {(r.doc_id, r.profile) for r in rules.claimed_profiles(found).collect()} == {("full", "2b"), ("full", "ua1")}


def test_generation_must_match():
    document = Document(plain())
    assert document.resolve({"$ref": [5, 0]}) and document.resolve({"$ref": [5, 1]}) is None


def test_filters():
    assert filters.ascii_hex(b"48 65 6C6>") == b"Hel`"
    assert filters.ascii_85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert filters.run_length(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert filters.decode(b"x", ["DCTDecode"], []) == (b"x", False)


def test_no_root_is_no_crash(spark):
    rows = tables.parsed(tables.from_bytes(spark, {"a": classic({1: b"<< >>"}, trailer=b"")})).collect()
    assert any(r.item == "status" for r in rows)


def test_checks_without_a_rule_are_not_evaluated(found):
    from leafmill.plans import catalogue

    rows = catalogue.file_accounts(found).collect()
    by_rule = {r.rule_id for r in rules.RULES}
    assert len(by_rule) == 27 and by_rule <= {i for i, *_ in catalogue.entries()}
    known = {(p, i) for i, profiles, *_ in catalogue.entries() for p in profiles}
    names = {r.doc_id for r in found["status"].where("status = 'read'").collect()}
    assert sorted((r.file, r.profile, r.test_id) for r in rows) == sorted((n, p, i) for n in names for p, i in known)
    assert all(r.bucket == "notEvaluated" for r in rows if r.test_id not in by_rule)
    wrong = {(r.doc_id, r.profile, r.rule_id) for r in rules.assertions(found).where("severity = 'Error'").collect()}
    assert {(r.file, r.profile, r.test_id) for r in rows if r.bucket == "failed"} == wrong
    assert any(r.bucket == "passed" for r in rows) and {r.bucket for r in rows if r.test_id in by_rule} <= {"passed", "failed"}


def test_damage_gives_error_rows(spark):
    """Resources, fonts and annotations that are no dictionaries or lists count as empty; what can't be read is an error row."""
    page = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources [1 2] /Annots 7 >>"
    broken = {3: page, 6: b"<< /Type /ObjStm /N (x) /First 0 /Length 3 >>", 7: b"<< /Type /Page /Resources << /Font [1] >> >>"}
    items = tables.parsed(tables.from_bytes(spark, {"a": plain(extra=broken), "b": plain()})).cache()
    found = tables.views(items)
    assert found["status"].where("status = 'read'").count() == 2
    assert found["pages"].where("doc_id = 'a'").count() == 1 and found["errors"].where("doc_id = 'b'").count() == 0
    assert found["annotations"].where("doc_id = 'a'").count() == 0

    from leafmill.sources.pdf import document

    def fails():
        yield {"item": "object", "num": 1}
        raise TypeError("a list")

    assert list(document.guarded(fails(), "object", 1)) == [{"item": "object", "num": 1}, {"item": "error", "num": 1, "kind": "object", "value": "TypeError: a list"}]
