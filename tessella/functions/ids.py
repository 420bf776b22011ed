"""Stable identifiers as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column, sep: str = "|") -> Column:
    """Parts joined with a separator; null counts as empty and keeps its place."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def uuid5(namespace_hex: str, name: Column) -> Column:
    """RFC 4122 name-based UUID (version 5) of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def zero_filled(c: Column, width: int) -> Column:
    """A code with zeros before it up to a width; longer codes stay whole."""
    c = c.cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def hash_share(c: Column) -> Column:
    """The first 60 bits of a text's SHA-256 as a number from 0 (included) to 1, for reproducible samples."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("long") / F.lit(float(1 << 60))


def first_present(*choices: Column) -> Column:
    """The first choice that is neither null nor blank."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.when(F.trim(c) != "", c) for c in choices])
