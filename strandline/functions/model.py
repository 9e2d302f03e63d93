"""Mapping of bound facts to model values: kinds, provenance, locations, checked enums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline import schema

# Method kinds that count as ordinary methods, and type kinds by name.
METHOD_LIKE = ("Ordinary", "ExplicitInterfaceImplementation", "UserDefinedOperator", "Conversion", "Destructor")
CONSTRUCTOR_LIKE = ("Constructor", "StaticConstructor")
TYPE_LIKE = ("Class", "Interface", "Struct", "Enum", "Delegate")


def map_kind(kind_name: Column, type_kind: Column, is_record: Column) -> Column:
    """Symbol kind of a raw symbol; null for anything that isn't indexed. A record struct is a Record."""
    by_type = F.when(F.coalesce(is_record, F.lit(False)) & type_kind.isin("Class", "Struct"), "Record").when(type_kind.isin(*TYPE_LIKE), type_kind)
    return (
        F.when(kind_name == "Namespace", "Namespace")
        .when(kind_name == "NamedType", by_type)
        .when(kind_name == "Method", F.when(type_kind.isin(*CONSTRUCTOR_LIKE), "Constructor").when(type_kind.isin(*METHOD_LIKE), "Method"))
        .when(kind_name.isin("Property", "Field", "Event"), kind_name)
    )


def is_type(kind: Column) -> Column:
    return kind.isin(*schema.TYPE_KINDS)


def is_container(kind: Column) -> Column:
    return (kind == "Namespace") | is_type(kind)


def accessibility_of(kind: Column, accessibility: Column) -> Column:
    return F.when(kind != "Namespace", accessibility)


def one_based(zero_based: Column) -> Column:
    return (zero_based + 1).cast("int")


def bind(exact: Column, candidates: Column) -> tuple[Column, Column]:
    """(target, provenance): the exact symbol, else the only candidate as Inferred, else nulls."""
    only = F.when(F.size(candidates) == 1, F.element_at(candidates, 1))
    target = F.coalesce(exact, only)
    return target, F.when(exact.isNotNull(), "Exact").when(only.isNotNull(), "Inferred")


def checked(value: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value if allowed; the query fails on any other."""
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))))


def defaulted(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def parse_timestamp(text: Column) -> Column:
    """ISO round-trip text to timestamp; null if it isn't one."""
    return F.try_to_timestamp(text)


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def any_of(c: Column, values: list) -> Column:
    """Membership test; an empty list matches nothing."""
    return c.isin(*values) if values else F.lit(False)
