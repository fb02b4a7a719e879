"""Text rules: case-insensitive comparison, trailing blanks, wildcard search, yes/no."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts read as "yes" (compared without case).
YES_TEXTS = ("yes", "y", "1")


def is_blank(text: str | None) -> bool:
    return text is None or not text.rstrip(" ")


def text_key(text: Column) -> Column:
    """Comparison form of a text: equality ignores case and trailing blanks."""
    return F.lower(F.rtrim(text))


def yes_no(text: Column) -> Column:
    return F.coalesce(text_key(text).isin(*YES_TEXTS), F.lit(False))


def yes_no_arg(text: str | None) -> bool:
    return text is not None and text.rstrip(" ").lower() in YES_TEXTS


def _search_regex(text: str) -> str:
    """Regular expression for a search text in which % _ [set] [^set] are wildcards."""
    parts = []
    pos = 0
    while pos < len(text):
        char = text[pos]
        close = text.find("]", pos + 1) if char == "[" else -1
        if char == "%":
            parts.append(".*")
        elif char == "_":
            parts.append(".")
        elif close > pos + 1:
            body = text[pos + 1 : close]
            negate = "^" if body.startswith("^") and len(body) > 1 else ""
            members = re.sub(r"([\\\[\]^&])", r"\\\1", body[len(negate):])
            parts.append(f"[{negate}{members}]")
            pos = close
        else:
            parts.append(re.escape(char))
        pos += 1
    return "(?s)" + "".join(parts)


def contains_text(column: Column, text: str) -> Column:
    """Wildcard substring search without case; a NULL column never matches."""
    wanted = text.lower()
    if "[" in wanted:
        return F.lower(column).rlike(_search_regex(wanted))
    if "%" in wanted or "_" in wanted:
        return F.lower(column).like("%" + wanted.replace("\\", "\\\\") + "%")
    return F.lower(column).contains(wanted)


def where_text(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Keep rows whose column contains the text; a blank text keeps every row."""
    return df if is_blank(text) else df.where(contains_text(F.col(column), text))
