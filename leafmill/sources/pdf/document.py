"""One file: revisions, cross-references, objects, pages and content operators, as rows."""

from __future__ import annotations

import json
import re

from leafmill.functions.filters import big_endian
from leafmill.sources.pdf.syntax import HEADER, Keyword, SyntaxReader, decoded_stream, is_name, reference, references_in

MOST_REVISIONS, MOST_RESOLVED, DEEPEST_PAGES = 100, 100, 256
TAIL = 1 << 20
TABLE_ROW = re.compile(rb"(\d{10})[ ](\d{5})[ ]([fn])[ \r\n]{0,2}")
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


class Unsupported(Exception):
    """An encrypted file."""


class Document:
    """Newest entries win; a free entry hides older ones; a hybrid table's stream fills gaps of its own revision."""

    def __init__(self, data: bytes):
        self.data = data
        self.revisions: list[dict] = []
        self.entries: dict[int, tuple] = {}
        self.rows: list[dict] = []
        self.trailer: dict = {}
        self.cache: dict[int, tuple] = {}
        self.containers: dict[int, list] = {}
        self.recovered: set[int] = set()
        self.open()

    def open(self) -> None:
        begin = max(0, len(self.data) - TAIL)
        at = self.data.rfind(b"startxref", begin)
        match = re.match(rb"startxref[\x00\t\n\x0c\r ]+(\d+)", self.data[at : at + 64]) if at >= 0 else None
        if not match:
            raise ValueError("no startxref")
        following, seen, freed = int(match[1]), set(), set()
        while following is not None and following not in seen and len(seen) < MOST_REVISIONS:
            seen.add(following)
            number = len(self.revisions)
            found, trailer = self.section(following)
            if "Encrypt" in trailer:
                raise Unsupported("encrypted")
            hybrid = trailer.get("XRefStm")
            frees = {n for n, e in found.items() if e[0] == "free"}
            for source, table in ((0, found), (1, self.section(hybrid)[0] if isinstance(hybrid, int) else {})):
                for n, entry in table.items():
                    self.rows.append({"rev": number, "num": n, "source": source, "entry": entry})
                    if entry[0] != "free" and n not in freed:
                        self.entries.setdefault(n, entry)
            freed |= frees
            self.revisions.append({"rev": number, "offset": following})
            self.trailer = self.trailer or trailer
            following = trailer.get("Prev")
            following = int(following) if isinstance(following, (int, float)) else None

    def section(self, offset: int) -> tuple[dict, dict]:
        data = self.data
        reader = SyntaxReader(data, offset)
        reader.skip()
        found: dict[int, tuple] = {}
        if data[reader.at : reader.at + 4] == b"xref":
            reader.at += 4
            while True:
                first = reader.read()
                if isinstance(first, Keyword):
                    if first != "trailer":
                        raise ValueError("bad cross-reference table")
                    return found, reader.read()
                count = reader.read()
                reader.skip()
                for n in range(first, first + count):
                    match = TABLE_ROW.match(data, reader.at)
                    if not match:
                        raise ValueError("bad cross-reference entry")
                    reader.at = match.end()
                    found[n] = ("free", int(match[1]), int(match[2])) if match[3] == b"f" else ("plain", int(match[1]), int(match[2]))
        _, fields, raw, _ = self.object_at(offset)
        body, _ = decoded_stream(fields, raw, lambda v: v)
        widths = fields["W"]
        index = fields.get("Index") or [0, fields["Size"]]
        at = 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for n in range(first, first + count):
                values = []
                for width in widths:
                    values.append(big_endian(body[at : at + width]) if width else None)
                    at += width
                kind = 1 if values[0] is None else values[0]
                found[n] = ("free", values[1] or 0, values[2] or 0) if kind == 0 else ("plain", values[1], values[2] or 0) if kind == 1 else ("packed", values[1], values[2] or 0)
        return found, fields

    def object_at(self, offset: int) -> tuple[tuple[int, int], object, bytes | None, int]:
        """((number, generation), value, stream bytes or None, end)."""
        match = HEADER.search(self.data, offset, offset + 64)
        if not match:
            raise ValueError("no object here")
        reader = SyntaxReader(self.data, match.end())
        value = reader.read()
        reader.skip()
        raw = None
        if isinstance(value, dict) and self.data[reader.at : reader.at + 6] == b"stream":
            begin = reader.at + 6
            begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1
            length = self.resolve(value.get("Length"))
            end = begin + length if isinstance(length, int) and length >= 0 else -1
            if end < 0 or not re.match(rb"[\x00\t\n\x0c\r ]*endstream", self.data[end : end + 32]):
                mark = re.compile(rb"\r?\n?endstream(?=[\x00\t\n\x0c\r ]+(endobj|\d+ \d+ obj|xref|trailer))").search(self.data, begin)
                if not mark:
                    raise ValueError("unended stream")
                end = mark.start()
                self.recovered.add(int(match[1]))
            raw, reader.at = self.data[begin:end], end
        return (int(match[1]), int(match[2])), value, raw, reader.at

    def load(self, number: int) -> tuple | None:
        """(generation, value, raw, offset, container) of an object."""
        if number in self.cache:
            return self.cache[number]
        entry = self.entries.get(number)
        if not entry:
            return None
        self.cache[number] = None  # a loop finds nothing
        try:
            if entry[0] == "plain":
                (own, generation), value, raw, _ = self.object_at(entry[1])
                found = (generation, value, raw, entry[1], None) if own == number else None
            else:
                found = None
                for own, value in self.packed(entry[1]):
                    if own == number:
                        found = (0, value, None, -1, entry[1])
        except (ValueError, EOFError, KeyError, TypeError, IndexError):
            found = None
        self.cache[number] = found
        return found

    def packed(self, container: int) -> list:
        if container not in self.containers:
            self.containers[container] = []
            if self.entries.get(container, ("",))[0] == "plain" and (found := self.load(container)) and found[2] is not None:
                fields = found[1]
                body, _ = decoded_stream(fields, found[2], self.resolve)
                reader = SyntaxReader(body or b"")
                heads = [(reader.read(), reader.read()) for _ in range(self.resolve(fields["N"]))]
                first = self.resolve(fields["First"])
                self.containers[container] = [(n, SyntaxReader(body, first + at).read()) for n, at in heads]
        return self.containers[container]

    def resolve(self, value, depth: int = 0):
        """What a value stands for; a reference of another generation stands for null."""
        while (ref := reference(value)) and depth < MOST_RESOLVED:
            found = self.load(ref[0])
            value = found[1] if found and found[0] == ref[1] else None
            depth += 1
        return value

    def pages(self):
        """(number in order, object number, page with inherited attributes)."""
        root = self.resolve(self.trailer.get("Root")) or {}
        waiting, seen, number = [(root.get("Pages"), {}, 0)], set(), 0
        while waiting:
            node, above, depth = waiting.pop(0)
            ref = reference(node)
            fields = self.resolve(node)
            if not isinstance(fields, dict) or ref in seen or depth > DEEPEST_PAGES:
                continue
            seen.add(ref)
            own = {**above, **{k: fields[k] for k in INHERITED if k in fields}}
            kids = self.resolve(fields.get("Kids"))
            if isinstance(kids, list):
                waiting[:0] = [(k, own, depth + 1) for k in kids]
            else:
                yield number, ref[0] if ref else None, {**own, **fields}
                number += 1

    def content(self, page: dict) -> bytes:
        parts = page.get("Contents")
        resolved = self.resolve(parts)
        parts = resolved if isinstance(resolved, list) else [parts]
        bodies = []
        for part in parts:
            ref = reference(part)
            found = self.load(ref[0]) if ref else None
            if found and found[2] is not None:
                bodies.append(decoded_stream(found[1], found[2], self.resolve)[0] or b"")
        return b"\n".join(bodies)


def operators(content: bytes):
    """(operator, operands) in order; the data of inline images is passed over."""
    reader, operands = SyntaxReader(content, references=False), []
    while True:
        try:
            value = reader.read()
        except (EOFError, ValueError, AttributeError):
            return
        if not isinstance(value, Keyword):
            operands.append(value)
            continue
        yield str(value), operands
        operands = []
        if value == "ID":
            mark = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(content, reader.at)
            reader.at = mark.end() if mark else len(content)


DAMAGE = (ValueError, EOFError, KeyError, TypeError, IndexError, AttributeError, OverflowError, RecursionError)


def guarded(rows, part: str, number: int | None = None):
    """The rows of a part of a file; damage ends them with an error row."""
    try:
        yield from rows
    except DAMAGE as error:
        yield {"item": "error", "num": number, "kind": part, "value": f"{type(error).__name__}: {error}"}


def mapping(value) -> dict:
    return value if isinstance(value, dict) else {}


def object_rows(document: Document, number: int):
    found = document.load(number)
    if not found:
        yield {"item": "object", "num": number, "kind": "unreadable"}
        return
    generation, value, raw, offset, container = found
    kind = "stream" if raw is not None else "name" if is_name(value) else type(value).__name__ if value is not None else "null"
    decoded, complete = decoded_stream(value, raw, document.resolve) if raw is not None else (None, None)
    yield {"item": "object", "num": number, "gen": generation, "kind": kind, "value": json.dumps(value), "offset": offset, "container": container, "raw": raw, "decoded": decoded, "complete": complete, "recovered": number in document.recovered}
    for path, target, gen in references_in(value):
        yield {"item": "ref", "num": number, "gen": gen, "idx": target, "value": path}


def page_rows(document: Document, page: int, number: int | None, fields: dict):
    """What should be a dictionary or a list and is not counts as empty."""
    resources = dict(mapping(document.resolve(fields.get("Resources"))))
    for part in ("Font", "XObject", "ColorSpace", "ExtGState"):
        resources[part] = {k: document.resolve(v) for k, v in mapping(document.resolve(resources.get(part))).items()}
    annotations = document.resolve(fields.get("Annots"))
    annotations = [document.resolve(a) for a in annotations] if isinstance(annotations, list) else []
    yield {"item": "page", "num": number, "idx": page, "value": json.dumps({**fields, "Resources": resources, "Annots": annotations})}
    for at, (name, operands) in enumerate(operators(document.content(fields))):
        yield {"item": "op", "idx": page, "num": at, "kind": name, "value": json.dumps(operands)}


def all_pages(document: Document):
    for page, number, fields in document.pages():
        yield from guarded(page_rows(document, page, number, fields), "page", number)


def catalog_rows(document: Document):
    root = document.resolve(document.trailer.get("Root"))
    if isinstance(root, dict):
        shallow = {k: document.resolve(v) for k, v in root.items() if k not in ("Pages", "StructTreeRoot", "Outlines", "Names")}
        yield {"item": "catalog", "value": json.dumps(shallow | {k: True for k in ("StructTreeRoot", "Outlines", "Names") if k in root})}


def file_rows(document: Document):
    yield {"item": "trailer", "value": json.dumps(document.trailer)}
    oldest = len(document.revisions) - 1
    for r in document.revisions:
        yield {"item": "revision", "num": oldest - r["rev"], "offset": r["offset"]}
    for r in document.rows:
        kind, place, extra = r["entry"]
        yield {"item": "xref", "rev": oldest - r["rev"], "num": r["num"], "gen": extra if kind != "packed" else 0, "kind": kind, "offset": place, "idx": r["source"]}


def rows_of(doc_id: str, data: bytes):
    """The rows of a file: item, then what the item has. Damage gives a status row, or an error row for the object or
    page that has it, never an exception."""
    try:
        document = Document(data)
    except Unsupported as error:
        yield {"item": "status", "kind": "unsupported", "value": str(error)}
        return
    except DAMAGE as error:
        yield {"item": "status", "kind": "damaged", "value": f"{type(error).__name__}: {error}"}
        return
    yield {"item": "status", "kind": "read", "value": data[:16].decode("latin-1"), "offset": len(data)}
    yield from guarded(file_rows(document), "file")
    for number in sorted(document.entries):
        yield from guarded(object_rows(document, number), "object", number)
    yield from guarded(all_pages(document), "pages")
    yield from guarded(catalog_rows(document), "catalog")
