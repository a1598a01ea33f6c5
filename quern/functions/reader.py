"""A lenient JSON reader: any number of values from one text, their order and number texts kept."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from .values import FilterError, number

SPACE = re.compile(r"[ \t\r\n﻿]*")
NUMBER = re.compile(r"-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?", re.A)
PLAIN_RUN = re.compile(r'[^"\\]*')
WORDS = {"null": None, "true": True, "false": False, "nan": math.nan, "NaN": math.nan, "-nan": math.nan, "-NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
WORD = re.compile(r"-?[A-Za-z]+")
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
DEEPEST = 512


class Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self, why: str):
        if self.at >= len(self.text):
            raise FilterError(f"{why} at EOF")
        line = self.text.count("\n", 0, self.at)
        raise FilterError(f"{why} at line {line + 1}, column {self.at - self.text.rfind(chr(10), 0, self.at)}")

    def skip(self) -> str:
        self.at = SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def values(self) -> Iterator:
        while self.skip():
            yield self.value(0)

    def value(self, depth: int):
        if depth > DEEPEST:
            self.fail("Exceeds depth limit for parsing")
        c = self.skip()
        if c == '"':
            return self.string()
        if c == "[":
            return self.array(depth)
        if c == "{":
            return self.object(depth)
        if m := NUMBER.match(self.text, self.at):
            self.at = m.end()
            text = m[0]
            lead = re.match(r"(-?)0+(?=\d)", text)
            return number(lead[1] + text[lead.end() :] if lead else text)
        m = WORD.match(self.text, self.at)
        if not m or m[0] not in WORDS:
            self.fail("Invalid literal" if c else "Unfinished JSON term")
        self.at = m.end()
        return WORDS[m[0]]

    def string(self) -> str:
        self.at += 1
        parts = []
        while True:
            m = PLAIN_RUN.match(self.text, self.at)
            parts.append(m[0])
            self.at = m.end()
            c = self.text[self.at : self.at + 1]
            self.at += 1
            if c == '"':
                return "".join(parts)
            if not c:
                self.fail("Unfinished string")
            e = self.text[self.at : self.at + 1]
            self.at += 1
            if e == "u":
                parts.append(self.code())
            elif e in ESCAPES and e:
                parts.append(ESCAPES[e])
            else:
                self.fail("Invalid escape")

    def code(self) -> str:
        def four():
            m = re.compile(r"[0-9a-fA-F]{4}").match(self.text, self.at)
            if not m:
                self.fail("Invalid escape")
            self.at += 4
            return int(m[0], 16)

        code = four()
        if 0xD800 <= code < 0xDC00:
            if self.text[self.at : self.at + 2] != "\\u":
                self.fail("Invalid \\uXXXX\\uXXXX surrogate pair escape")
            self.at += 2
            low = four()
            if not 0xDC00 <= low < 0xE000:
                self.fail("Invalid \\uXXXX\\uXXXX surrogate pair escape")
            code = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00
        return "�" if 0xDC00 <= code < 0xE000 else chr(code)

    def array(self, depth: int) -> list:
        self.at += 1
        out: list = []
        if self.skip() == "]":
            self.at += 1
            return out
        while True:
            out.append(self.value(depth + 1))
            c = self.skip()
            self.at += 1
            if c == "]":
                return out
            if c != ",":
                self.at -= 1
                self.fail("Expected separator between values" if c else "Unfinished JSON term")

    def key(self) -> str:
        """A key and its colon."""
        if self.skip() != '"':
            self.fail("Object keys must be strings")
        key = self.string()
        if self.skip() != ":":
            self.fail("Objects must consist of key:value pairs")
        self.at += 1
        return key

    def object(self, depth: int) -> dict:
        self.at += 1
        out: dict = {}
        if self.skip() == "}":
            self.at += 1
            return out
        while True:
            key = self.key()
            out[key] = self.value(depth + 1)
            c = self.skip()
            self.at += 1
            if c == "}":
                return out
            if c != ",":
                self.at -= 1
                self.fail("Expected separator between values" if c else "Unfinished JSON term")

    def events(self) -> Iterator[list]:
        """The [path, leaf] and closing [path] events of all values, those before an error too."""
        while self.skip():
            yield from self.walk([], 0)

    def walk(self, path: list, depth: int) -> Iterator[list]:
        opening = self.skip()
        if opening not in ("[", "{"):
            yield [path, self.value(depth)]
            return
        if depth > DEEPEST:
            self.fail("Exceeds depth limit for parsing")
        ending = "]" if opening == "[" else "}"
        self.at += 1
        if self.skip() == ending:
            self.at += 1
            yield [path, [] if ending == "]" else {}]
            return
        place = 0
        while True:
            here = [*path, float(place) if ending == "]" else self.key()]
            yield from self.walk(here, depth + 1)
            c = self.skip()
            if c == ending:
                self.at += 1
                yield [here]
                return
            if c != ",":
                self.fail("Expected separator between values" if c else "Unfinished JSON term")
            self.at += 1
            place += 1


def read_one(text: str):
    """Exactly one value."""
    reader = Reader(text)
    try:
        found = list(reader.values())
    except FilterError as e:
        raise FilterError(f"{e.value} (while parsing '{text}')") from None
    if len(found) != 1:
        raise FilterError(f"Expected one JSON value (while parsing '{text}')")
    return found[0]


def events(value) -> Iterator[list]:
    """The [path, leaf] and closing [path] events of a value."""

    def walk(path, v):
        if not isinstance(v, (list, dict)) or not v:
            yield [path, v]
            return
        last = None
        for k, x in enumerate(v) if isinstance(v, list) else v.items():
            last = [*path, float(k) if isinstance(v, list) else k]
            yield from walk(last, x)
        yield [last]

    return walk([], value)
