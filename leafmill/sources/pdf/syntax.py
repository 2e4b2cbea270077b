"""Objects of PDF syntax as plain values that JSON can hold.

A name is "/Name", a literal string "(text" and a hexadecimal one "<digits" (text as Latin-1), a reference
{"$ref": [number, generation]}; dictionaries, arrays, numbers, booleans and null are themselves.
"""

from __future__ import annotations

import re

from leafmill.functions.filters import decode

DEEPEST = 256
SPACE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
NUMBER = re.compile(rb"[+-]?(\d+\.?\d*|\.\d+)$")
REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
HEADER = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj(?![A-Za-z0-9])")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}


class Keyword(str):
    """An operator or another bare word."""


class SyntaxReader:
    def __init__(self, data: bytes, at: int = 0, references: bool = True):
        self.data, self.at, self.references = data, at, references

    def skip(self) -> None:
        data = self.data
        while self.at < len(data):
            if data[self.at] in SPACE:
                self.at += 1
            elif data[self.at] == 37:  # a comment
                ends = [e for e in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends, default=len(data))
            else:
                return

    def read(self, depth: int = 0):
        """The next object, or a Keyword; at the end, EOFError."""
        if depth > DEEPEST:
            raise ValueError("nested too deeply")
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise EOFError
        head = data[at : at + 1]
        if head == b"/":
            match = REGULAR.match(data, at + 1)
            self.at = match.end() if match else at + 1
            name = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), match[0] if match else b"")
            return "/" + name.decode("latin-1")
        if head == b"(":
            return "(" + self.literal().decode("latin-1")
        if data[at : at + 2] == b"<<":
            self.at += 2
            return self.dictionary(depth)
        if head == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise ValueError("unended hexadecimal string")
            self.at = end + 1
            return "<" + data[at + 1 : end].translate(None, SPACE).decode("latin-1")
        if head == b"[":
            self.at += 1
            items = []
            while True:
                self.skip()
                if data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.read(depth + 1))
        if head in (b"]", b")", b"{", b"}", b">"):
            self.at += 2 if data[at : at + 2] == b">>" else 1
            return Keyword(data[at : self.at].decode())
        if self.references and (match := REFERENCE.match(data, at)):
            self.at = match.end()
            return {"$ref": [int(match[1]), int(match[2])]}
        match = REGULAR.match(data, at)
        self.at = match.end()
        word = match[0]
        if NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Keyword(word.decode("latin-1")))

    def literal(self) -> bytes:
        data, at, open_, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            c = data[at : at + 1]
            if c == b"\\":
                nxt = data[at + 1 : at + 2]
                if digits := re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4]):
                    out.append(int(digits[0], 8) & 255)
                    at += 1 + len(digits[0])
                    continue
                if nxt in (b"\n", b"\r"):
                    at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                    continue
                out += ESCAPES.get(nxt, nxt)
                at += 2
                continue
            open_ += (c == b"(") - (c == b")")
            at += 1
            if not open_:
                self.at = at
                return bytes(out)
            out += c
        raise ValueError("unended string")

    def dictionary(self, depth: int) -> dict:
        found = {}
        while True:
            key = self.read(depth + 1)
            if isinstance(key, Keyword):
                if key == ">>":
                    return found
                raise ValueError(f"{key} in a dictionary")
            if not isinstance(key, str) or not key.startswith("/"):
                raise ValueError("a key that is no name")
            value = self.read(depth + 1)
            if isinstance(value, Keyword):
                if value == ">>":
                    return found
                raise ValueError(f"{value} in a dictionary")
            found[key[1:]] = value


def is_name(value, name: str | None = None) -> bool:
    return isinstance(value, str) and not isinstance(value, Keyword) and value.startswith("/") and (name is None or value == "/" + name)


def reference(value) -> tuple[int, int] | None:
    return tuple(value["$ref"]) if isinstance(value, dict) and "$ref" in value else None


def references_in(value, path: str = ""):
    """(path, number, generation) of every reference inside a value."""
    if found := reference(value):
        yield path, *found
    elif isinstance(value, dict):
        for key, inner in value.items():
            yield from references_in(inner, f"{path}/{key}")
    elif isinstance(value, list):
        for at, inner in enumerate(value):
            yield from references_in(inner, f"{path}[{at}]")


def stream_filters(fields: dict, resolve) -> tuple[list[str], list[dict]]:
    names, parms = resolve(fields.get("Filter", fields.get("F"))), resolve(fields.get("DecodeParms", fields.get("DP")))
    names = [n for n in (names if isinstance(names, list) else [names])]
    parms = parms if isinstance(parms, list) else [parms]
    return [str(resolve(n))[1:] for n in names if n is not None], [resolve(p) or {} for p in parms]


def decoded_stream(fields: dict, raw: bytes, resolve) -> tuple[bytes | None, bool]:
    try:
        return decode(raw, *stream_filters(fields, resolve))
    except (ValueError, IndexError, TypeError):
        return None, False
