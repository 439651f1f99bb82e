"""Configuration in code: the object literal that a script exports, read without running it.

Comments go, strings and patterns are masked, and in what is left the exported literal is found: assigned to the
module's exports, exported by default, wrapped in a call that types it, or bound to a name that is exported. It is then read
token by token with a stack of open containers. Everything is linear in the source. Values are literals only; whatever would need
evaluation is an error, as are spreads, templates and bare names.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Deeper nesting is an error, as VARIANT has a limit of its own.
MAX_DEPTH = 500

# What JavaScript counts as white space, where a slash begins a pattern (after these signs, these words, or nothing), what stands
# before an exported literal, the words and numbers that are literals, and the escapes that aren't the sign itself.
SPACE = r"[\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
BEFORE_PATTERN = frozenset("=(:,[!&|?{};") | {"=>", "await", "case", "delete", "do", "else", "in", "instanceof", "new", "of", "return", "throw", "typeof", "void", "yield"}
EXPORTS = re.compile(rf"\bmodule\.exports{SPACE}*=", re.ASCII)
DEFAULT = re.compile(rf"\bexport{SPACE}+default\b", re.ASCII)
WRAPPER = "defineConfig"
NAME = re.compile(r"[A-Za-z_$][\w$]*", re.ASCII)
CONSTANTS = {"true": True, "false": False, "null": None}
NUMBER = re.compile(r"-?\d+(?:\.\d+)?", re.ASCII)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}

_STRINGS = "|".join(rf"{q}(?:\\.|[^{q}\\])*+{q}" for q in "\"'`")
_COMMENTS = re.compile(rf"({_STRINGS})|(//[^\n]*+\n?)|/\*.*?(?:\*/|\Z)|([\"'`])", re.DOTALL)
_MASKED = re.compile("|".join(rf"{q}(?:\\.|[^{q}\\])*+(?:{q}|\\?\Z)" for q in "\"'`"), re.DOTALL)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\])*+(?:\]|\\?\Z)|[^/\\\[])*+(?:/[A-Za-z]*|\\?\Z)", re.DOTALL)
_LEXEME = re.compile(rf"({SPACE}+)|([A-Za-z_$][\w$]*+)|(=>)|([\"'`])|(/)|.", re.DOTALL | re.ASCII)
_VALUE = re.compile(rf"{SPACE}*+(?:([{{}}\[\]:,])|(\"(?:\\.|[^\"\\])*+\"|'(?:\\.|[^'\\])*+')|([A-Za-z0-9_$.-]++)|(.)|\Z)", re.DOTALL)
_ENDS = re.compile("[=;]")
_BLANKS = re.compile(f"{SPACE}*")


class NotLiteral(ValueError):
    """What a source exports can't be read without running it, or isn't there."""


def _without_comments(source: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            raise NotLiteral("a string has no end")
        return m[1] or ("\n" if m[2] else " ")

    return _COMMENTS.sub(one, source)


def _masked(clean: str) -> str:
    """The source with blanks for strings and patterns, of equal length."""
    out, at, before = [], 0, None
    while at < len(clean):
        m = _LEXEME.match(clean, at)
        space, word, arrow, quote, slash = m.groups()
        hidden = _MASKED.match(clean, at) if quote else _PATTERN.match(clean, at) if slash and (before is None or before in BEFORE_PATTERN) else None
        m = hidden or m
        out.append(" " * len(m[0]) if hidden else m[0])
        at = m.end()
        if not space:
            before = "literal" if hidden else m[0]
    return "".join(out)


def _after_blanks(mask: str, at: int) -> int:
    return _BLANKS.match(mask, at).end()


def _declared(mask: str, name: str) -> int:
    """Where the value of the first declaration of a name begins."""
    end = -1
    for m in re.finditer(rf"\b(?:const|let|var){SPACE}+{re.escape(name)}{SPACE}*+", mask, re.ASCII):
        at = m.end()
        if mask.startswith(":", at):  # a type, up to the next of = and ;
            if end <= at and not (found := _ENDS.search(mask, at + 1)):
                break
            end = found.start() if end <= at else end
            if end == at + 1:
                continue
            at = end
        if mask.startswith("=", at):
            return _after_blanks(mask, at + 1)
    raise NotLiteral(f"{name} isn't declared with a value")


def _exported(mask: str) -> int:
    """Where the exported literal begins."""
    if m := EXPORTS.search(mask):
        at = _after_blanks(mask, m.end())
    elif m := DEFAULT.search(mask):
        at = _after_blanks(mask, m.end())
        if mask.startswith(WRAPPER, at):
            at = _after_blanks(mask, at + len(WRAPPER))
            if not mask.startswith("(", at):
                raise NotLiteral("the export isn't an object literal")
            at = _after_blanks(mask, at + 1)
            if not mask.startswith("{", at):
                raise NotLiteral("the export isn't an object literal")
    else:
        raise NotLiteral("nothing is exported")
    if not mask.startswith("{", at) and (name := NAME.match(mask, at)):
        at = _declared(mask, name[0])
    if not mask.startswith("{", at):
        raise NotLiteral("the export isn't an object literal")
    return at


def _number(word: str) -> int | float | None:
    x = float(word)
    return None if math.isinf(x) else int(x) if x == int(x) and abs(x) < 1 << 53 else x


def _read(clean: str, at: int) -> Any:
    """The value of the literal that begins there; what follows it is not looked at."""
    open_: list[dict | list] = []
    keys: list[str] = []  # of the open objects, the last being the one whose value comes next
    wanted = "value"
    while True:
        m = _VALUE.match(clean, at)
        sign, string, word, other = m.groups()
        at = m.end()
        text = None if string is None else re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.DOTALL)
        if wanted == "colon":
            if sign != ":":
                raise NotLiteral(f"the key {keys[-1]} has no literal value")
            wanted = "value"
            continue
        if wanted == "comma" and sign == ",":
            wanted = "key" if isinstance(open_[-1], dict) else "item"
            continue
        closing = sign == ("}" if open_ and isinstance(open_[-1], dict) else "]") and wanted in ("comma", "key", "item")
        if wanted == "key" and not closing:
            if not (key := text or word):
                raise NotLiteral("a key is missing")
            keys.append(key)
            wanted = "colon"
            continue
        if wanted == "comma" and not closing:
            raise NotLiteral("a comma or an end is missing")
        if closing:
            value: Any = open_.pop()
        elif sign in ("{", "["):
            if len(open_) >= MAX_DEPTH:
                raise NotLiteral("nested too deep")
            open_.append({} if sign == "{" else [])
            wanted = "key" if sign == "{" else "item"
            continue
        elif text is not None:
            value = text
        elif word in CONSTANTS:
            value = CONSTANTS[word]
        elif word and NUMBER.fullmatch(word):
            value = _number(word)
        else:
            raise NotLiteral(f"no literal: {word or sign or other or 'end'}")
        if not open_:
            return value
        if isinstance(open_[-1], dict):
            open_[-1][keys.pop()] = value
        else:
            open_[-1].append(value)
        wanted = "comma"


def read(source: str) -> Any:
    """The object that a source exports; NotLiteral if it can't be read. Of keys that repeat the last counts."""
    clean = _without_comments(source)
    return _read(clean, _exported(_masked(clean)))


def _json(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for sources in batches:
        rows = []
        for source in sources:
            try:
                rows.append((None, None) if source is None else (json.dumps(read(source), ensure_ascii=False), None))
            except NotLiteral as e:
                rows.append((None, str(e)))
        yield pd.DataFrame(rows, columns=["json", "error"], dtype=object)


def exported_literal(source: Column) -> Column:
    """Struct (value variant, error string) of a source; exactly one is null, but both for a null source. A value that VARIANT can't hold is an error, too."""
    got = F.pandas_udf(_json, StructType([StructField("json", StringType()), StructField("error", StringType())]))(source)
    value = F.try_parse_json(got["json"])
    return F.struct(value.alias("value"), F.coalesce(got["error"], F.when(got["json"].isNotNull() & value.isNull(), "too large")).alias("error"))
