"""Numbers and identifiers in texts: exact scanners over UTF-8 bytes, in Arrow batches."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergauge import schema

#: The scale words after a number.
SCALES = {
    b"k": 1e3, b"thousand": 1e3, b"m": 1e6, b"mm": 1e6, b"mn": 1e6, b"million": 1e6, b"b": 1e9, b"bn": 1e9, b"billion": 1e9, b"t": 1e12, b"tn": 1e12, b"trillion": 1e12,
}
_IDENT = re.compile(rb"(?P<hex>0[xX][0-9a-fA-F]{6,})|(?P<cve>[cC][vV][eE]-[0-9]{4}-[0-9]{4,})|(?P<date>(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]))")
_NUMBER = re.compile(rb"(?P<whole>[0-9](?:[0-9]|[,_](?=[0-9]))*)(?:\.(?P<part>[0-9]+))?(?:[eE](?P<sign>[+-]?)(?P<power>[0-9]{1,4})(?![0-9]))?(?:(?P<percent>%)| ?(?P<scale>[a-zA-Z]+))?")

_DIGIT = re.compile(rb"[0-9]")


class Number(NamedTuple):
    value: float
    percent: bool
    currency: bool
    start: int
    end: int


class Ident(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def identifiers(text: bytes) -> list[Ident]:
    """Hex strings of six digits and more, CVE numbers, and ISO dates that touch no other digit."""
    found = []
    for m in _IDENT.finditer(text):
        kind = m.lastgroup
        body = m[0].decode("ascii")
        found.append(Ident(kind, body.lower() if kind == "hex" else body.upper(), m.start(), m.end()))
    return found


def _value(whole: bytes, part: bytes | None) -> float:
    """The digits as a number, digit by digit, the fraction divided by its power of ten and added."""
    v = 0.0
    for c in whole:
        if c not in b",_":
            v = v * 10.0 + (c - 48)
    if part:
        f, scale = 0.0, 1.0
        for c in part:
            f, scale = f * 10.0 + (c - 48), scale * 10.0
        v += f / scale
    return v


def power_of_ten(exponent: int) -> float:
    v = 1.0
    for _ in range(min(abs(exponent), 400)):  # at 400 it has long come to infinity or 0
        v = v * 10.0 if exponent >= 0 else v / 10.0
    return v


def numbers(text: bytes, skip: list[Ident]) -> list[Number]:
    """Numbers that don't begin within an identifier; one that begins before an identifier may run into it."""
    found: list[Number] = []
    at, k = 0, 0
    while (m := _DIGIT.search(text, at)) is not None:
        at = m.start()
        while k < len(skip) and skip[k].end <= at:
            k += 1
        if k < len(skip) and skip[k].start <= at:
            at = skip[k].end
            continue
        m = _NUMBER.match(text, at)
        value = _value(m["whole"], m["part"])
        if m["power"]:
            value *= power_of_ten(int(m["sign"] + m["power"]))
        end = m.end()
        if m["scale"]:
            scale = SCALES.get(m["scale"].lower())
            if scale is None:  # the word, and a space before it, are no part of the number
                end = m.end("power") if m["power"] else m.end("part") if m["part"] else m.end("whole")
            else:
                value *= scale
        start = at
        before = text[at - 2 : at - 1] if at > 1 else b""
        if at > 0 and text[at - 1] == 0x2D and not before.isalpha():
            value, start = -value, at - 1
        sign = start
        while sign > 0 and text[sign - 1] == 0x20:
            sign -= 1
        if currency := sign > 0 and text[sign - 1] == 0x24:
            start = sign - 1
        found.append(Number(value, m["percent"] is not None, currency, start, end))
        at = end
    return found


def _each(texts: pd.Series, scan) -> pd.Series:
    return pd.Series([[x._asdict() for x in scan((t or "").encode())] for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(schema.IDENT))
def scan_identifiers(texts: pd.Series) -> pd.Series:
    """The identifiers of each text; a null text has none."""
    return _each(texts, identifiers)


@F.pandas_udf(T.ArrayType(schema.NUMBER))
def scan_numbers(texts: pd.Series) -> pd.Series:
    """The numbers of each text that are no identifiers; a null text has none."""
    return _each(texts, lambda t: numbers(t, identifiers(t)))
