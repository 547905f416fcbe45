"""Name splitting and SQL LIKE with ASCII-only case folding."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_qualified(name: str) -> tuple[str, str | None]:
    """(bare name, qualifier): cut at the last ::, else the last backslash, else the last dot."""
    for mark in ("::", "\\", "."):
        before, found, after = name.rpartition(mark)
        if found:
            return after, before
    return name, None


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ascii_like(c: Column, part: str) -> Column:
    """c LIKE '%part%': % and _ in part are wildcards, nothing escapes them, A-Z fold."""
    folded = part.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    if "%" not in folded and "_" not in folded:
        return F.contains(ascii_lower(c), F.lit(folded))
    return F.like(ascii_lower(c), F.lit(f"%{folded}%"), F.lit("\x01"))


def last_segment(c: Column, marks: str) -> Column:
    """The text after the last of the given characters."""
    inside = "".join("\\" + m for m in marks)
    return F.regexp_extract(c, f"(?s)([^{inside}]*)$", 1)
