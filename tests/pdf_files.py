"""Small PDF files written by hand for the tests."""

import zlib


def classic(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R /ID [<00><00>]", header: bytes = b"%PDF-1.7\n") -> bytes:
    out, places = bytearray(header), {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    size = max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 00000 f \n"
    out += b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, start)
    return bytes(out)


def stream(body: bytes, fields: bytes = b"", length: int | None = None) -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body) if length is None else length, fields, body)


def plain(catalog: bytes = b"", content: bytes = b"q BT /F1 12 Tf (Hi) Tj ET Q", extra: dict | None = None, **kw) -> bytes:
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R %s >>" % catalog,
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 5 0 R >> >> >>",
        4: stream(zlib.compress(content), b"/Filter /FlateDecode"),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    }
    return classic(objects | (extra or {}), **kw)


def updated(base: bytes, number: int, body: bytes | None) -> bytes:
    """An incremental update that replaces or frees one object."""
    before = int(base.rsplit(b"startxref", 1)[1].split()[0])
    out = bytearray(base)
    at = len(out)
    if body is not None:
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start = len(out)
    entry = b"%010d 00000 n \n" % at if body is not None else b"0000000000 00001 f \n"
    out += b"xref\n%d 1\n%strailer\n<< /Size 9 /Root 1 0 R /ID [<00><00>] /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (number, entry, before, start)
    return bytes(out)


def packed() -> bytes:
    """A cross-reference stream and an object stream."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R /Lang (en) >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R >>"}
    heads, bodies = b"", b""
    for n, body in inner.items():
        heads += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
    out = bytearray(b"%PDF-1.7\n")
    first = len(out)
    out += b"4 0 obj\n" + stream(zlib.compress(heads + bodies), b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(heads)) + b"\nendobj\n"
    start = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, first, 0), (1, start, 0)]
    table = b"".join(bytes([k]) + a.to_bytes(3, "big") + bytes([b]) for k, a, b in rows)
    up = b"".join(bytes([2]) + bytes((x - y) & 255 for x, y in zip(table[i : i + 5], table[i - 5 : i] if i else bytes(5), strict=True)) for i in range(0, len(table), 5))
    out += b"5 0 obj\n" + stream(zlib.compress(up), b"/Type /XRef /Size 6 /W [1 3 1] /Root 1 0 R /ID [<00><00>] /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >>") + b"\nendobj\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start
