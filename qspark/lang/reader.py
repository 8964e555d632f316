"""Text to nested Python values: lists for calls, Vec for [..], dict for {..}, and typed atoms."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass
from typing import Any


class Name(str):
    """An identifier to look up."""


class Sym(str):
    """A symbol value, quoted with '."""


class Time(int):
    """Milliseconds since midnight."""


class Stamp(int):
    """Nanoseconds since 2000-01-01."""


class Vec(list):
    """A vector literal."""


class Call(list):
    """A parenthesised form."""


@dataclass
class Quoted:
    what: Any


_token = re.compile(
    r"""\s+|;[^\n]*
    |(?P<open>[(\[{])|(?P<close>[)\]}])
    |(?P<string>"(?:\\.|[^"\\])*")
    |(?P<stamp>-?\d{4}\.\d{2}\.\d{2}D\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?)
    |(?P<date>\d{4}\.\d{2}\.\d{2})
    |(?P<time>-?\d{2,}:\d{2}:\d{2}(?:\.\d{1,3})?)
    |(?P<null>0N[a-z0](?![\w]))
    |(?P<hex>0x[0-9a-fA-F]{2})
    |(?P<float>-?\d+\.\d*(?:[eE][-+]?\d+)?|-?\d+[eE][-+]?\d+)
    |(?P<int>-?\d+[hil]?(?![\w.]))
    |(?P<char>'(?:\\.|[^\s'])'(?=[\s()\[\]{}]|$))
    |(?P<symbol>'[^\s()\[\]{}";']*)
    |(?P<colon>:)
    |(?P<name>[^\s()\[\]{}";':]+)""",
    re.X,
)
_close = {"(": ")", "[": "]", "{": "}"}
EPOCH = datetime.datetime(2000, 1, 1)


def _millis(text: str) -> int:
    sign, text = (-1, text[1:]) if text[0] == "-" else (1, text)
    h, m, s = text.split(":")
    sec, _, frac = s.partition(".")
    return sign * (((int(h) * 60 + int(m)) * 60 + int(sec)) * 1000 + int(frac.ljust(3, "0") or 0))


def stamp(text: str) -> Stamp:
    day, _, clock = text.partition("D")
    y, m, d = map(int, day.split("."))
    whole, _, frac = clock.partition(".")
    seconds = (datetime.datetime(y, m, d) - EPOCH).days * 86400 + _millis(whole) // 1000
    return Stamp(seconds * 10**9 + int(frac.ljust(9, "0") or 0))


def _atom(kind: str, text: str) -> Any:
    if kind == "string":
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if kind == "stamp":
        return stamp(text)
    if kind == "date":
        return datetime.date(*map(int, text.split(".")))
    if kind == "time":
        return Time(_millis(text))
    if kind == "null":
        return None
    if kind == "hex":
        return int(text, 16)
    if kind == "float":
        return float(text)
    if kind == "int":
        return int(text.rstrip("hil"))
    if kind == "char":
        return text[1:-1]
    if kind == "symbol":
        return Sym(text[1:])
    return {"true": True, "false": False, "null": None}.get(text, Name(text))


def parse(text: str) -> list:
    """All forms of a script."""
    stack: list[tuple[str, list]] = [("", [])]
    at = 0
    while at < len(text):
        m = _token.match(text, at)
        if not m:
            raise SyntaxError(f"parse: at {text[at : at + 20]!r}")
        at, kind = m.end(), m.lastgroup
        if kind is None:
            continue
        if kind == "open":
            stack.append((m[0], []))
        elif kind == "close":
            opener, items = stack.pop() if len(stack) > 1 else ("", [])
            if _close.get(opener) != m[0]:
                raise SyntaxError(f"parse: unexpected {m[0]}")
            stack[-1][1].append(_closed(opener, items))
        elif kind == "colon":
            stack[-1][1].append(_COLON)
        elif kind == "symbol" and m[0] == "'" and text[at : at + 1] == "(":
            stack[-1][1].append(_QUOTE)
        else:
            stack[-1][1].append(_atom(kind, m[0]))
    if len(stack) > 1:
        raise SyntaxError("parse: missing closing bracket")
    return [x for x in _quotes(stack[0][1]) if x is not _COLON]


_COLON, _QUOTE = object(), object()


def _quotes(items: list) -> list:
    out: list = []
    for x in items:
        if out and out[-1] is _QUOTE:
            out[-1] = Quoted(x)
        else:
            out.append(x)
    return out


def _closed(opener: str, items: list) -> Any:
    items = _quotes(items)
    if opener == "(":
        return Call(items)
    if opener == "[":
        return Vec(items)
    out: dict = {}
    k = 0
    while k < len(items):
        if k + 2 >= len(items) or items[k + 1] is not _COLON:
            raise SyntaxError("parse: a dictionary needs key: value")
        out[str(items[k])] = items[k + 2]
        k += 3
    return out
