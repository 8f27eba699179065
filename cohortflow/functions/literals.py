r"""Errors embedded in messages as dictionary literals, such as {'code': 503, 'message': 'Busy'}.

Messages are parsed by the grammar of literals, never evaluated: strings with prefixes, escapes and adjacent parts, numbers in
all bases, None, True and False, nested lists, tuples, sets and dictionaries. Containers stand on a list instead of the call
stack, so nesting is limited by the text's length only, and the time is linear in it.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?P<space>[ \t\f\r\n]+|\#[^\n]*|\\\n)
    |(?P<string>(?P<prefix>[uU]|[rR]|[bB]|[bB][rR]|[rR][bB])?(?P<quote>'''|\"\"\"|'|\"))
    |(?P<name>None|True|False)(?!\w)
    |(?P<float>(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*)(?!\w)
    |(?P<int>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|0(?:_?0)*|[1-9](?:_?\d)*)(?!\w|\.)
    |(?P<mark>[\[\](){}:,+-])""",
    re.X,
)
_ESCAPE = re.compile(r"\\(\n|[\\'\"abfnrtv]|[0-7]{1,3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]+\})")
_PLAIN = {"\n": "", "\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_CLOSE = {"[": "]", "(": ")", "{": "}"}


def _unescaped(body: str, raw: bool, binary: bool) -> str | bytes:
    def one(m):
        x = m[1]
        if x in _PLAIN:
            return _PLAIN[x]
        if x[0] in "01234567":
            return chr(int(x, 8) & (255 if binary else 0x1FF))
        if x[0] == "x":
            return chr(int(x[1:], 16))
        if binary:
            return m[0]
        if x[0] == "N":
            import unicodedata

            return unicodedata.lookup(x[2:-1])  # a KeyError for unknown names
        return chr(int(x[1:], 16))

    if binary and not body.isascii():
        raise ValueError("bytes of letters outside ASCII")
    if not raw:
        if re.search(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})", body) or not binary and re.search(r"(?<!\\)(?:\\\\)*\\(?:u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8})|N(?!\{))", body):
            raise ValueError("a truncated escape")
        body = _ESCAPE.sub(one, body)
    return body.encode("latin-1") if binary else body


class _Reader:
    """Tokens of a text, strings already joined from their adjacent parts."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _string(self, m) -> str | bytes:
        quote, prefix = m["quote"], (m["prefix"] or "").lower()
        end = re.compile(r"(?:[^\\]|\\.)*?" + quote, re.S) if len(quote) == 3 else re.compile(rf"(?:[^\\\n{quote}]|\\.)*+{quote}", re.S)
        body = end.match(self.text, m.end())
        if body is None:
            raise ValueError("an open string")
        self.at = body.end()
        return _unescaped(body[0][: -len(quote)], "r" in prefix, "b" in prefix)

    def __iter__(self):
        parts: list = []
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if m is None:
                raise ValueError(f"no literal at {self.at}")
            self.at = m.end()
            if m["space"]:
                continue
            if m["quote"]:
                parts.append(self._string(m))
                if type(parts[-1]) is not type(parts[0]):
                    raise ValueError("text and bytes side by side")
                continue
            if parts:
                yield "value", type(parts[0])().join(parts)
                parts = []
            if m["name"]:
                yield "value", {"None": None, "True": True, "False": False}[m["name"]]
            elif m["float"]:
                yield "number", float(m["float"].replace("_", ""))
            elif m["int"]:
                yield "number", int(m["int"].replace("_", ""), 0)
            else:
                yield "mark", m["mark"]
        if parts:
            yield "value", type(parts[0])().join(parts)


def parse(text: str):
    """The value of a literal; a ValueError for any other text."""
    stack: list[tuple[str, list, list]] = [("", [], [])]  # what opened it, its values, its marks between values
    sign, ready = None, False  # ready: the innermost container has a value that no comma or colon follows yet

    def put(value):
        nonlocal ready
        if ready:
            raise ValueError("two values side by side")
        stack[-1][1].append(value)
        ready = True

    for kind, x in _Reader(text.lstrip(" \t")):
        if kind == "mark" and x in "+-":
            if ready or sign is not None:
                raise ValueError("an expression")
            sign = -1 if x == "-" else 1
            continue
        if sign is not None and kind != "number":
            raise ValueError("a sign without a number")
        if kind == "number":
            put(x if sign is None else sign * x)
            sign = None
        elif kind == "value":
            put(x)
        elif x in _CLOSE:
            if ready:
                raise ValueError("an expression")
            stack.append((x, [], []))
        elif x in ",:":
            if not ready or not stack[-1][0] and x == ":":
                raise ValueError(f"{x} without a value before it")
            stack[-1][2].append(x)
            ready = False
        else:
            opened, values, marks = stack.pop()
            if _CLOSE.get(opened) != x or marks and not ready and marks[-1] == ":":
                raise ValueError(f"{x} closes nothing")
            ready = False
            put(_container(opened, values, marks))
    opened, values, marks = stack.pop()
    if stack or sign is not None or not values:
        raise ValueError("the literal doesn't end")
    return tuple(values) if marks else values[0]


def _container(opened: str, values: list, marks: list):
    if opened == "{" and (not values or marks and marks[0] == ":"):
        if len(values) % 2 or any(m != ":,"[i % 2] for i, m in enumerate(marks)):
            raise ValueError("not a dictionary")
        return _hashed(lambda: dict(zip(values[::2], values[1::2], strict=True)))
    if ":" in marks:
        raise ValueError("a colon outside a dictionary")
    if opened == "{":
        return _hashed(lambda: set(values))
    if opened == "(":
        return tuple(values) if marks or not values else values[0]
    return values


def _hashed(make):
    try:
        return make()
    except TypeError as e:
        raise ValueError("a key that can't be one") from e


def _code(value) -> int | None:
    """A status code of three digits, as a number or text; truth values aren't numbers here."""
    if isinstance(value, str) and re.fullmatch(r"\d{3}", value.strip()):
        value = int(value)
    return value if type(value) is int and 100 <= value <= 599 else None


def _message(value) -> str | None:
    return " ".join(value.split())[:240] or None if isinstance(value, str) else None


def _read(text: str | None, within: str | None) -> tuple[int | None, str | None]:
    try:
        value = parse(text) if text else None
    except (ValueError, KeyError):
        value = None
    value = value if isinstance(value, dict) else {}
    if within and not {"code", "message"} & {k for k in value if isinstance(k, str)} and isinstance(value.get(within), dict):
        value = value[within]
    return _code(value.get("code")), _message(value.get("message"))


#: Errors repeat: a worker remembers what the latest texts held, those of up to so many characters.
KNOWN, KNOWN_LENGTH = 1 << 14, 2048


@functools.lru_cache(KNOWN)
def _known(text: str, within: str | None) -> tuple[int | None, str | None]:
    return _read(text, within)


def embedded_errors(frame: DataFrame, column: str = "error_message", within: str | None = None) -> DataFrame:
    """Adds embedded_code and embedded_message of the dictionary literals in a text column; null where a text isn't one.

    With `within`, a dictionary that has neither is searched for another under that key. Null and empty texts, other
    literals, and literals that don't end have neither; texts of any length are parsed whole.
    """

    @F.pandas_udf("code int, message string")
    def read(texts: pd.Series) -> pd.DataFrame:
        found = [_known(text, within) if text and len(text) <= KNOWN_LENGTH else _read(text, within) for text in texts]
        return pd.DataFrame({"code": pd.array([c for c, _ in found], "Int32"), "message": [m for _, m in found]})

    return frame.withColumn("_e", read(F.col(column))).withColumns({"embedded_code": F.col("_e.code"), "embedded_message": F.col("_e.message")}).drop("_e")
