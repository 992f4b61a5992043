"""Row-level validation expressions (JVM-side, no UDF).

Each rule is a pair (failing-condition, message); :func:`errors` folds the
rules into one ``array<string>`` of the messages that apply, in rule order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Integer text: optional sign, no leading zeros, digits only (as an int check).
INT_PATTERN = r"^[-+]?(0|[1-9][0-9]*)$"
# Decimal text: optional sign, digits with an optional fraction, or a bare fraction.
FLOAT_PATTERN = r"^[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"
# A deliberately simple e-mail shape: something@something.tld, no spaces.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+[.][^@\s]+$"


def blank(c: Column) -> Column:
    """NULL or only whitespace."""
    return c.isNull() | (F.length(F.trim(c)) == 0)


def not_int_at_least(c: Column, lo: int, hi: int | None = None) -> Column:
    s = F.trim(c.cast("string"))
    v = s.try_cast("bigint")
    bad = c.isNull() | ~s.rlike(INT_PATTERN) | v.isNull() | (v < lo)
    if hi is not None:
        bad = bad | (v > hi)
    return F.coalesce(bad, F.lit(True))


def not_float_at_least(c: Column, lo: float) -> Column:
    s = F.trim(c.cast("string"))
    v = s.try_cast("double")
    return F.coalesce(c.isNull() | ~s.rlike(FLOAT_PATTERN) | v.isNull() | (v < lo), F.lit(True))


def not_email(c: Column) -> Column:
    return F.coalesce(c.isNull() | ~c.rlike(EMAIL_PATTERN), F.lit(True))


def too_long(c: Column, n: int, required: bool = False) -> Column:
    bad = F.length(c) > n
    if required:
        bad = c.isNull() | bad
    return F.coalesce(bad, F.lit(False))


def errors(rules: list[tuple[Column, str]]) -> Column:
    """``array<string>`` of the messages whose condition is true."""
    arr = F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rules])
    return F.filter(arr, lambda x: x.isNotNull())
