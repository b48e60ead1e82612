"""Address and text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_mac(s: Column) -> Column:
    """Six pairs of hex digits between colons or dashes."""
    return s.rlike(r"^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\z")


def parse_mac(s: Column) -> Column:
    """Six bytes, or null for what is no address; twelve bare hex digits are taken too."""
    bare = F.regexp_replace(s, "[:-]", "")
    return F.when(is_mac(s) | s.rlike(r"^[0-9A-Fa-f]{12}\z"), F.unhex(bare))


def format_mac(b: Column) -> Column:
    """Upper-case pairs between colons."""
    return F.regexp_replace(F.hex(b), "(..)(?!$)", "$1:")


def ascii_only(s: Column) -> Column:
    """Each character beyond ASCII becomes a question mark."""
    return F.regexp_replace(s, r"[^\x00-\x7F]", "?")


def utf8_length(s: Column) -> Column:
    return F.octet_length(s)


def number_kind(s: Column) -> Column:
    """Of a number's JSON text: float if it has a point or an exponent."""
    return F.when(s.rlike("[.eE]"), "float").otherwise("int")


def json_kind(s: Column) -> Column:
    """Kind of value that a JSON text holds, by its first character."""
    t = F.ltrim(s)
    return F.when(t.startswith("{"), "object").when(t.startswith("["), "array").when(t.startswith('"'), F.when(is_mac(F.regexp_extract(t, r'^"([^"]*)"', 1)), "mac").otherwise("string")).when(t.isin("true", "false"), "boolean").when(t == "null", "null").otherwise(number_kind(t))
