"""Writes small files: objects, a classic cross-reference table and a trailer."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame


def classic(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R", version: str = "1.7") -> bytes:
    out, places = bytearray(f"%PDF-{version}\n%".encode() + b"\xe2\xe3\xcf\xd3\n"), {}
    for number, body in sorted(objects.items()):
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start, size = len(out), max(objects, default=0) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for number in range(1, size):
        out += b"%010d 00000 n \n" % places[number] if number in places else b"0000000000 00000 f \n"
    return bytes(out) + b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, start)


def escaped(text: str) -> bytes:
    return text.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def text_file(title: str, lines: list[str], language: str | None = None) -> bytes:
    """One page with a line of text each; the content is deflated."""
    content = b"BT /F1 12 Tf 14 TL 72 720 Td\n" + b"".join(b"(%s) Tj T*\n" % escaped(line) for line in lines) + b"ET"
    packed = zlib.compress(content)
    lang = b" /Lang (%s)" % escaped(language) if language else b""
    return classic({
        1: b"<< /Type /Catalog /Pages 2 0 R%s >>" % lang,
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        4: b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        6: b"<< /Title (%s) >>" % escaped(title),
    }, b"/Root 1 0 R /Info 6 0 R /ID [<00><00>]")


def text_files(rows: DataFrame) -> DataFrame:
    """path, length and content of a file for each row of path, title, language and lines."""

    def run(batches):
        for batch in batches:
            made = [text_file(r["title"] or "", r["lines"] or [], r["language"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([*map(len, made)], pa.int64()), pa.array(made, pa.binary())], names=["path", "length", "content"])

    return rows.select("path", "title", "language", "lines").mapInArrow(run, "path string, length long, content binary")
