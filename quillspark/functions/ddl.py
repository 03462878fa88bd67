"""Columns of CREATE TABLE statements; F34.

A text is cut into tokens once (comments, strings and quoted names are one each), so that commas, brackets
and keywords inside them count for nothing; a table's body is then split at its own commas.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_TOKEN = re.compile(r"""--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)|"(?:[^"]|"")*(?:"|\Z)|`[^`]*(?:`|\Z)|\[[^\]]*(?:\]|\Z)|[\w$]+|[^\s\w]""", re.S)
#: What begins a part of a table that is no column.
_CONSTRAINTS = {"constraint", "primary", "foreign", "unique", "check", "exclude", "like"}


def _name(token: str) -> str:
    """A name without its quotes."""
    if token[0] in "\"`":
        return token[1:-1].replace(token[0] * 2, token[0])
    return token[1:-1] if token[0] == "[" else token


def scan(ddl: str) -> list[tuple[str, str]]:
    """Table and column of every column that CREATE TABLE statements in the text define, in order."""
    tokens = [t for t in _TOKEN.findall(ddl) if not t.startswith(("--", "/*"))]
    low, out, k = [t.lower() for t in tokens], [], 0
    while k < len(tokens):
        begun, k = low[k] == "create", k + 1
        while begun and k < len(tokens) and low[k] in ("temp", "temporary", "or", "replace"):
            k += 1
        if not begun or k >= len(tokens) or low[k] != "table":
            continue
        k += 1
        if low[k : k + 3] == ["if", "not", "exists"]:
            k += 3
        if k >= len(tokens):
            break
        table, k = _name(tokens[k]), k + 1
        while k + 1 < len(tokens) and tokens[k] == ".":  # the name behind the last dot is the table's
            table, k = _name(tokens[k + 1]), k + 2
        if k >= len(tokens) or tokens[k] != "(":
            continue
        depth, first, k = 1, True, k + 1
        while k < len(tokens) and depth:
            t = tokens[k]
            if first and depth == 1 and t not in "(),":
                if low[k] not in _CONSTRAINTS:
                    out.append((table, _name(t)))
                first = False
            depth += (t == "(") - (t == ")")
            first = first or (t == "," and depth == 1)
            k += 1
    return out


@F.pandas_udf(ArrayType(StructType([StructField("table_name", StringType()), StructField("column_name", StringType())])))
def table_columns(ddl: pd.Series) -> pd.Series:
    """the columns that a text of DDL defines."""
    return ddl.map(lambda t: [{"table_name": a, "column_name": b} for a, b in scan(t or "")])


def is_sealed_name(column: Column) -> Column:
    """Columns that must hold envelopes, by their names."""
    return column.endswith("_envelope") | (column == "filename")
