"""String folds, list codec and small path expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once; keeps nested expressions from growing by repetition."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def nocase(c: Column | str) -> Column:
    """Sort and equality key that folds ASCII letters only (store queries)."""
    return F.translate(c, UPPER, LOWER)


def ordinal_ignore_case(c: Column | str) -> Column:
    """Key of comparisons that fold all letters to upper case (lists, filters, paths)."""
    return F.upper(c)


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.upper(a) == F.upper(b)


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.coalesce(F.upper(text).contains(F.upper(part)), F.lit(False))


def join_list(c: Column) -> Column:
    """Array to stored text; null for an empty or null array."""
    return F.when(F.size(c) > 0, F.array_join(c, ", "))


def split_list(c: Column) -> Column:
    """Stored text to array: split at commas, trim, drop empty. Names that hold a comma don't survive."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.btrim(x))
    return F.filter(parts, lambda x: x != "")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def extension(c: Column) -> Column:
    """Lower-cased extension of the last path segment with its dot; empty without one."""
    return F.lower(F.regexp_extract(basename(c), r"(\.[^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many))
