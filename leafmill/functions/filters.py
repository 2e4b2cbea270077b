"""Decoding of byte streams: a chain of filters, each with its parameters."""

from __future__ import annotations

import re
import zlib

MOST_BYTES = 512 << 20  # of one decoded stream
SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode"}
BLANK = b"\x00\t\n\x0c\r "


def flate(data: bytes) -> bytes:
    """With or without the zlib header; what could be read of a damaged stream counts."""
    for bits in (15, -15):
        engine = zlib.decompressobj(bits)
        out = bytearray()
        try:
            rest = data
            while rest and not engine.eof:
                out += engine.decompress(rest, 1 << 20)
                rest = engine.unconsumed_tail
                if len(out) > MOST_BYTES:
                    raise ValueError("a stream is too large")
            return bytes(out)
        except zlib.error:
            if out:
                return bytes(out)
    raise ValueError("not a deflated stream")


def lzw(data: bytes, early: int = 1) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, held, bits, last = bytearray(), 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code < len(table):
            entry = table[code]
        elif last is not None and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) + early >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    body = data.split(b">", 1)[0].translate(None, BLANK)
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode("latin-1"))


def ascii_85(data: bytes) -> bytes:
    body = data.split(b"~>", 1)[0].translate(None, BLANK)
    body = body.removeprefix(b"<~")
    out, group = bytearray(), []
    for byte in body:
        if byte == 122 and not group:
            out += bytes(4)
            continue
        if not 33 <= byte <= 117:
            raise ValueError("bad base-85 digit")
        group.append(byte - 33)
        if len(group) == 5:
            value = 0
            for digit in group:
                value = value * 85 + digit
            out += (value & 0xFFFFFFFF).to_bytes(4, "big")
            group = []
    if len(group) > 1:
        value = 0
        for digit in group + [84] * (5 - len(group)):
            value = value * 85 + digit
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def unpredicted(data: bytes, parms: dict) -> bytes:
    """Undoes the PNG row predictors, or the TIFF one for 8-bit components."""
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, depth, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, row = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    out, before = bytearray(), bytearray(row)
    if kind == 2:
        for at in range(0, len(data), row):
            line = bytearray(data[at : at + row])
            if depth == 8:
                for i in range(step, len(line)):
                    line[i] = (line[i] + line[i - step]) & 255
            out += line
        return bytes(out)
    for at in range(0, len(data), row + 1):
        mode, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(line)):
            left = line[i - step] if i >= step else 0
            above = before[i]
            corner = before[i - step] if i >= step else 0
            if mode == 1:
                guess = left
            elif mode == 2:
                guess = above
            elif mode == 3:
                guess = (left + above) // 2
            elif mode == 4:
                base = left + above - corner
                guess = min((abs(base - left), 0, left), (abs(base - above), 1, above), (abs(base - corner), 2, corner))[2]
            else:
                guess = 0
            line[i] = (line[i] + guess) & 255
        out += line
        before = line + bytearray(row - len(line))
    return bytes(out)


def decode(data: bytes, filters: list[str], parms: list[dict]) -> tuple[bytes, bool]:
    """(bytes, whether all filters were undone): an image filter ends the chain."""
    for at, name in enumerate(filters):
        name = SHORT.get(name, name)
        own = parms[at] if at < len(parms) and isinstance(parms[at], dict) else {}
        if name == "FlateDecode":
            data = unpredicted(flate(data), own)
        elif name == "LZWDecode":
            data = unpredicted(lzw(data, own.get("EarlyChange", 1)), own)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "ASCII85Decode":
            data = ascii_85(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        else:
            return data, False
    return data, True


def big_endian(data: bytes) -> int:
    return int.from_bytes(data, "big")


HEX_STRING = re.compile(rb"<[0-9A-Fa-f\s]*>")
