"""Years without a zero, sortable time keys and the domain's date texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F


def year_after(y):
    """The next year; -1 is followed by 1."""
    return F.when(y == -1, 1).otherwise(y + 1)


def years_between(a, b):
    """Signed distance of two years on an axis without year zero."""
    line = lambda y: F.when(y < 0, y + 1).otherwise(y)
    return line(b) - line(a)


def time_key(y, m=None, d=None):
    """Sortable key; a year stands before its own months, a month before its days."""
    zero = F.lit(0)
    return (y * 10000 + F.coalesce(m if m is not None else zero, zero) * 100 + F.coalesce(d if d is not None else zero, zero)).cast("long")


def parsed_key(text):
    """Key of '-1450-01-14', '-1450-01' or '-1450'; null where it isn't a date."""
    pattern = r"^(-?[0-9]+)(?:-([0-9]{2}))?(?:-([0-9]{2}))?$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int")
    y, m, d = part(1), part(2), part(3)
    ok = y.isNotNull() & (y != 0) & (m.isNull() | m.between(1, 12)) & (d.isNull() | d.between(1, 31))
    return F.when(ok, time_key(y, m, d))


def epoch_of(name):
    """Year in a file name: world_bc2000 is -2000, world_1500 is 1500."""
    n = F.regexp_extract(name, r"_(?:bc)?([0-9]+)", 1)
    year = F.nullif(n, F.lit("")).cast("int")
    return F.when(F.regexp_like(name, F.lit("_bc[0-9]")), -year).otherwise(year)
