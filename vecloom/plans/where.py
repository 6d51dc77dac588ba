"""The filter dialect: a boolean fragment is translated to Spark SQL.

A double-quoted token is a field where an operand starts and a string where a value is expected; backticks are always fields, and
field names with dots stay one name. ``field CONTAINS value`` tests an array. Everything else is SQL as Spark knows it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.|"")*")|(`[^`]*`)|('(?:[^'\\]|\\.|'')*')|(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_][\w.]*)|(==|!=|<>|<=|>=|[=<>(),+\-*/%]))""")
COMPARE = {"=", "==", "!=", "<>", "<", "<=", ">", ">="}
WORDS = {"and", "or", "not", "in", "like", "is", "null", "between", "true", "false", "contains", "exists", "case", "when", "then", "else", "end", "div", "rlike", "ilike"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read the filter at {text[at:at + 20]!r}")
        kind = ("dq", "bt", "sq", "num", "word", "op")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


def _string(raw: str) -> str:
    quote = raw[0]
    body = raw[1:-1].replace(quote * 2, quote)
    body = re.sub(r"\\(.)", r"\1", body)
    return "'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _field(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def translate(text: str) -> str:
    """The Spark SQL of a filter; ValueError if it can't be read."""
    if not isinstance(text, str):
        raise ValueError("a filter is a string")
    parts = tokens(text)
    if not parts:
        raise ValueError("the filter is empty")
    out: list[str] = []
    value, lists, depth = False, [], 0  # value: a literal is expected; lists: depths of open IN lists
    for i, (kind, raw) in enumerate(parts):
        low = raw.lower()
        nxt = parts[i + 1] if i + 1 < len(parts) else ("", "")
        in_list = bool(lists) and depth >= lists[-1]
        if kind == "dq":
            out.append(_string(raw) if value or in_list else _field(raw[1:-1].replace('""', '"')))
            value = False
        elif kind == "bt":
            out.append(_field(raw[1:-1]))
            value = False
        elif kind == "sq":
            out.append(_string(raw))
            value = False
        elif kind == "num":
            out.append(raw)
            value = False
        elif kind == "word" and low == "contains":
            if not out:
                raise ValueError("CONTAINS needs a field")
            out.append(f"\0{out.pop()}")  # closed with the value
            value = True
            continue
        elif kind == "word" and low in WORDS:
            if low == "null" and out and out[-1] in ("=", "=="):
                out[-1] = "IS"
            elif low == "null" and out and out[-1] in ("!=", "<>"):
                out[-1] = "IS NOT"
            out.append(raw.upper())
            value = low in ("like", "between", "rlike", "ilike") or (low == "and" and _between(parts, i))
            if low == "in":
                lists.append(depth + 1)
        elif kind == "word":
            out.append(raw if nxt[1] == "(" else _field(raw))
            value = False
        else:
            if raw == "(":
                depth += 1
            elif raw == ")":
                if lists and depth == lists[-1]:
                    lists.pop()
                depth -= 1
                if depth < 0:
                    raise ValueError("a bracket too many")
            out.append("=" if raw == "==" else raw)
            value = raw in COMPARE
            continue
        if len(out) > 1 and out[-2].startswith("\0"):
            right, left = out.pop(), out.pop()[1:]
            out.append(f"array_contains({left}, {right})")
    if depth or any(x.startswith("\0") for x in out):
        raise ValueError("the filter is cut off")
    return " ".join(out)


def _between(parts, i: int) -> bool:
    """Whether this AND belongs to a BETWEEN before it."""
    for kind, raw in reversed(parts[:i]):
        if kind == "word" and raw.lower() == "between":
            return True
        if kind == "word" and raw.lower() in ("and", "or"):
            return False
    return False


def condition(text: str) -> Column:
    return F.expr(translate(text))


def apply_where(df: DataFrame, text: str | None) -> DataFrame:
    """Rows for which the filter is true; all rows without a filter."""
    if text is None:
        return df
    sql = translate(text)
    try:
        return df.where(F.expr(sql))
    except Exception as e:
        raise ValueError(f"the filter {text!r} doesn't fit the fields: {str(e).splitlines()[0]}") from e
