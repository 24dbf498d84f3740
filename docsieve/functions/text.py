"""Text expressions: cleaning, and what stands around a span. Offsets are code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that cleaning drops: controls, formats and separators other than space, newline, return and tab.
_DROPPED = r"[\p{C}\p{Z}&&[^ \n\r\t]]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sanitised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _DROPPED, ""))


def cleaned(text: Column) -> Column:
    """sanitised, with runs of blanks made one and runs of three or more newlines made two."""
    return F.trim(F.regexp_replace(F.regexp_replace(sanitised(text), "[ \t]+", " "), "\n{3,}", "\n\n"))


def left_of(text: Column, start: Column) -> Column:
    return F.substring(text, F.lit(1), start)


def right_of(text: Column, end: Column) -> Column:
    return F.substring(text, end + 1, F.length(text))


def line_of(text: Column, start: Column, end: Column) -> Column:
    """The line of a span."""
    return F.concat(F.substring_index(left_of(text, start), "\n", -1), F.substring(text, start + 1, end - start), F.substring_index(right_of(text, end), "\n", 1))


def clause_of(text: Column, start: Column, end: Column) -> Column:
    """The part of a span's line between semicolons."""
    cut = lambda c, n: F.substring_index(F.substring_index(c, "\n", n), ";", n)
    return F.concat(cut(left_of(text, start), -1), F.substring(text, start + 1, end - start), cut(right_of(text, end), 1))


def back(text: Column, start: Column, n: int) -> Column:
    """The n characters before a span."""
    first = F.greatest(start - n, F.lit(0))
    return F.substring(text, first + 1, start - first)


def window(text: Column, start: Column, end: Column, n: int) -> Column:
    first = F.greatest(start - n, F.lit(0))
    return F.substring(text, first + 1, end + n - first)
