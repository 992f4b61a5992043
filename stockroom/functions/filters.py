"""Predicate builders: optional conjuncts, search, date bounds, paging.

Every builder returns a Column (or applies one), so predicates stay inside
Catalyst: they are pushed to the parquet scan where the column is a plain
source column, and evaluated in generated code everywhere else.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conds: Column | None) -> Column | None:
    """AND of the conditions that are given (``None`` = not asked for)."""
    given = [c for c in conds if c is not None]
    if not given:
        return None
    return reduce(lambda a, b: a & b, given)


def where(df: DataFrame, *conds: Column | None) -> DataFrame:
    """Apply the optional conjuncts; a frame with no conditions is unchanged."""
    cond = all_of(*conds)
    return df if cond is None else df.filter(cond)


def eq_if(col: str | Column, value) -> Column | None:
    """``col = value`` only if a value is given."""
    if value is None:
        return None
    c = F.col(col) if isinstance(col, str) else col
    return c == F.lit(value)


def search_any(cols: list[str], term: str | None) -> Column | None:
    """Case-insensitive substring match over OR-ed columns.

    The term is embedded in ``%term%`` unescaped, as the source does, so
    ``%`` and ``_`` inside it act as wildcards. NULL columns never match.
    """
    if not term:
        return None
    pattern = f"%{term}%"
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in cols])


def as_timestamp(value) -> Column:
    """A bound as a timestamp literal. A date-only bound means its 00:00:00."""
    if isinstance(value, dt.datetime):
        return F.lit(value).cast("timestamp_ntz")
    if isinstance(value, dt.date):
        return F.lit(dt.datetime(value.year, value.month, value.day)).cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")


def ts_range(col: str | Column, start=None, end=None) -> Column | None:
    """Inclusive timestamp range, each side optional.

    ``end`` given as a date compares against that day's midnight, so the rest
    of the end day is excluded -- the behaviour of the listing endpoints.
    """
    c = F.col(col) if isinstance(col, str) else col
    return all_of(None if start is None else c >= as_timestamp(start),
                  None if end is None else c <= as_timestamp(end))


def date_between(col: str | Column, start, end) -> Column:
    """``DATE(col) BETWEEN start AND end``, both days inclusive."""
    c = F.col(col) if isinstance(col, str) else col
    return F.to_date(c).between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))


def stock_flag(col: str | Column, in_stock) -> Column | None:
    """Tri-state stock filter: 'true' -> quantity > 0, 'false' -> = 0, else none."""
    c = F.col(col) if isinstance(col, str) else col
    flag = str(in_stock).lower() if in_stock is not None else None
    if flag == "true":
        return c > 0
    if flag == "false":
        return c == 0
    return None


def check_paging(page_no, limit) -> tuple[int, int]:
    """Page numbers start at 1 and a page holds at least one row (a negative
    OFFSET or a zero LIMIT is an error in the source's database as well)."""
    page_no, limit = int(page_no), int(limit)
    if page_no < 1 or limit < 1:
        raise ValueError(f"page must be >= 1 and limit >= 1, got page={page_no}, limit={limit}")
    return page_no, limit


def page(df: DataFrame, order: list[Column], page_no: int = 1, limit: int = 10) -> DataFrame:
    """LIMIT/OFFSET paging; ``order`` must end in a unique key so pages are stable.

    Spark plans ``orderBy().offset().limit()`` as a top-k (TakeOrderedAndProject
    on ``offset + limit`` rows per partition), so a shallow page never sorts the
    whole input.
    """
    page_no, limit = check_paging(page_no, limit)
    offset = (page_no - 1) * limit
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)
