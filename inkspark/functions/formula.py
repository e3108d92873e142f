"""Formulas: tokens, their plain rendering, and shared formulas moved to another cell."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ERRORS = "#DIV/0!|#N/A|#NAME\\?|#REF!|#VALUE!|#NUM!|#NULL!|#SPILL!|#CALC!|#GETTING_DATA"
_TOKEN = re.compile(
    r'(?P<string>"(?:[^"]|"")*"?)|(?P<error>' + _ERRORS + r")|(?P<space>\s+)|(?P<open>\()|(?P<close>\))|(?P<array>\{)|(?P<end>\})|(?P<comma>,)|(?P<semi>;)"
    r"|(?P<operator><=|>=|<>|[-+*/^&=<>%@])|(?P<word>(?:'(?:[^']|'')*'|\[[^\]]*\]|[0-9.]+[eE][-+]?[0-9]+|[^\s\"#(){},;<>=+\-*/^&%@'\[\]])+)|(?P<other>.)", re.S
)


@dataclass(frozen=True)
class Token:
    kind: str  # operand, function, argument, operator, subexpression, space
    sub: str  # text, number, logical, error, range, start, stop, prefix, infix, postfix, intersect, union
    text: str


def _operand(text: str) -> Token:
    if re.fullmatch(r"[0-9.]+(?:[eE][-+]?[0-9]+)?", text):
        return Token("operand", "number", text)
    return Token("operand", "logical" if text in ("TRUE", "FALSE") else "range", text)


def _unquoted(word: str) -> str:
    return re.sub(r"'((?:[^']|'')*)'", lambda m: m[1].replace("''", "'"), word)


def tokens(formula: str) -> list[Token]:
    """Tokens of a formula; one leading equals sign is not part of it, and a leading plus has no effect."""
    raw = formula.strip()
    raw = raw[1:].strip() if raw.startswith("=") else raw
    out: list[Token] = []
    stack: list[str] = []
    found = list(_TOKEN.finditer(raw))
    for k, m in enumerate(found):
        kind, text = m.lastgroup, m[0]
        last = next((t for t in reversed(out) if t.kind != "space"), None)
        after = last is not None and (last.kind == "operand" or last.sub in ("stop", "postfix"))
        if kind == "string":
            out.append(Token("operand", "text", text[1:].removesuffix('"').replace('""', '"')))
        elif kind == "error":
            out.append(Token("operand", "error", text))
        elif kind == "space":
            following = found[k + 1] if k + 1 < len(found) else None
            joins = after and following is not None and following.lastgroup in ("word", "string", "error", "open", "array")
            if joins:
                out.append(Token("operator", "intersect", " "))
        elif kind == "word":
            follow = found[k + 1].lastgroup if k + 1 < len(found) else ""
            if follow == "open":
                stack.append("function")
                out.append(Token("function", "start", _unquoted(text)))
            else:
                out.append(_operand(_unquoted(text)))
        elif kind == "open":
            if out and out[-1].sub == "start" and found[k - 1].lastgroup == "word":
                continue
            stack.append("subexpression")
            out.append(Token("subexpression", "start", ""))
        elif kind == "close":
            out.append(Token(stack.pop() if stack else "subexpression", "stop", ""))
        elif kind == "array":
            stack += ["function", "function"]
            out += [Token("function", "start", "ARRAY"), Token("function", "start", "ARRAYROW")]
        elif kind == "end":
            stack[-2:] = []
            out += [Token("function", "stop", ""), Token("function", "stop", "")]
        elif kind == "semi" and "function" in stack:
            out += [Token("function", "stop", ""), Token("argument", "", ","), Token("function", "start", "ARRAYROW")]
        elif kind in ("comma", "semi"):
            out.append(Token("argument", "", ",") if stack and stack[-1] == "function" else Token("operator", "union", text))
        elif kind == "operator" and text == "%":
            out.append(Token("operator", "postfix", text))
        elif kind == "operator" and text == "@":
            continue
        elif kind == "operator" and not after:
            if text != "+":
                out.append(Token("operator", "prefix", text))
        elif kind == "operator":
            out.append(Token("operator", "infix", text))
        else:
            out.append(Token("operand", "range", text))
    return out


def render(parts: list[Token]) -> str:
    """Tokens as plain text."""
    out = []
    for t in parts:
        if t.kind == "function":
            out.append(t.text + "(" if t.sub == "start" else ")")
        elif t.kind == "subexpression":
            out.append("(" if t.sub == "start" else ")")
        elif t.kind == "operand" and t.sub == "text":
            out.append(f'"{t.text}"')
        else:
            out.append(t.text)
    return "".join(out)


_CELL = re.compile(r"(\$?)([A-Z]{1,3})(\$?)([1-9][0-9]{0,6})")


def shifted(ref: str, rows: int, cols: int) -> str:
    """A reference moved by rows and columns; ``$`` pins, whole rows and columns move, and what leaves the sheet is empty."""
    from ..sources.xlsx import column_name, column_number

    sheet, bang, area = ref.rpartition("!")
    out = []
    for part in area.split(":"):
        if m := _CELL.fullmatch(part):
            col = column_number(m[2]) + (0 if m[1] else cols)
            row = int(m[4]) + (0 if m[3] else rows)
            if not (1 <= col <= 16384 and 1 <= row <= 1048576):
                return ""
            out.append(f"{m[1]}{column_name(col)}{m[3]}{row}")
        elif m := re.fullmatch(r"(\$?)([A-Z]{1,3})", part):
            col = column_number(m[2]) + (0 if m[1] else cols)
            if not 1 <= col <= 16384:
                return ""
            out.append(m[1] + column_name(col))
        elif m := re.fullmatch(r"(\$?)([1-9][0-9]*)", part):
            row = int(m[2]) + (0 if m[1] else rows)
            if not 1 <= row <= 1048576:
                return ""
            out.append(m[1] + str(row))
        else:
            return ref
    return sheet + bang + ":".join(out)


def expand_shared(formula: str, rows: int, cols: int) -> str:
    """A shared formula as it reads in a cell so many rows and columns from its first one."""
    word = re.compile(r'"(?:[^"]|"")*"|(?:(?:\'(?:[^\']|\'\')*\'|[A-Za-z0-9_.\[\]]+)!)?\$?(?:[A-Z]{1,3}\$?[1-9][0-9]*|[A-Z]{1,3}(?=:)|[1-9][0-9]*(?=:))(?::\$?[A-Z]{0,3}\$?[0-9]*)?(?![A-Za-z0-9_(.])')
    out, at = [], 0
    for m in word.finditer(formula):
        before = formula[m.start() - 1] if m.start() else ""
        if m[0].startswith('"') or before.isalnum() or before in ("_", "."):
            continue
        moved = shifted(m[0], rows, cols)
        if moved == "":
            return ""
        out += [formula[at : m.start()], moved]
        at = m.end()
    return "".join([*out, formula[at:]])


def rendered_column(formula: Column) -> Column:
    """:func:`render` of a column of formulas, in Arrow batches."""
    from pyspark.sql import SparkSession

    from ..session import ship

    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: None if v is None else render(tokens(v)))

    return run(formula)
