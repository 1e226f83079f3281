"""Text predicates and formatting, as built-in expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK_FROM = 6


def ascii_contains(column: Column, text: str) -> Column:
    """``column LIKE '%text%'`` that ignores the case of ASCII letters only.

    ``%`` and ``_`` in the text are wildcards and nothing escapes them. Each
    stretch between ``%`` is found at its leftmost place and kept (atomic
    groups), so a match takes one pass over the column.
    """
    if not re.search(r"[A-Za-z%_]", text):
        return column.contains(text)
    stretches = [s for s in text.split("%") if s]
    if not stretches:
        return column.isNotNull()
    found = ["".join("." if part == "_" else _quote(part) for part in re.split("(_)", s) if part) for s in stretches]
    if len(found) == 1:
        return column.rlike("(?is)" + found[0])
    return column.rlike(r"(?is)\A" + "".join(f"(?>.*?{f})" for f in found))


def _quote(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def clock(timestamp: Column) -> Column:
    """The time of day: what follows the first six characters, if anything does."""
    rest = F.substring(timestamp, CLOCK_FROM + 1, 2**31 - 1)
    return F.when(F.length(timestamp) > CLOCK_FROM, rest).otherwise(timestamp)


def first_line(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def trace(message: Column) -> Column:
    """What follows the first newline, or ""."""
    return F.substring(message, F.length(first_line(message)) + 2, F.lit(2**31 - 1))


def indent_trace(text: Column) -> Column:
    """Every line set in by two spaces and ended by a newline; "" stays ""."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.concat(F.lit("  "), line, F.lit("\n")))
    return F.when(text == "", "").otherwise(F.array_join(lines, ""))
