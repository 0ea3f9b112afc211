"""Small column helpers used everywhere."""
from __future__ import annotations

import datetime as dt
from typing import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# No list page is longer than this, which is what makes a page safe to broadcast.
MAX_PAGE = 1000


def texts_of(*names: str) -> T.ArrayType:
    """Type of a list of structs with text fields."""
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def moment(value: str | dt.datetime | Column) -> Column:
    """A timestamp literal without a time zone (sessions run in UTC)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp_ntz")


def trailing(ts, as_of, *, days=0, hours=0, minutes=0) -> Column:
    """``ts`` lies in the window of the given length that ends at ``as_of``."""
    span = F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))
    return (as_col(ts) >= moment(as_of) - span) & (as_col(ts) <= moment(as_of))


def blank(c) -> Column:
    """Null, empty or whitespace only."""
    return F.coalesce(F.length(F.trim(as_col(c))) == 0, F.lit(True))


def non_empty(c) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def first_non_empty(*cols) -> Column:
    return F.coalesce(*[non_empty(c) for c in cols])


def strip(c) -> Column:
    """Trim every kind of white space, not just the space character."""
    return F.regexp_replace(as_col(c), r"^\s+|\s+$", "")


def bind(value, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(as_col(value)), fn), F.lit(0))


def lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """``mapping[key]`` as a CASE expression (for tables of a few dozen entries)."""
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def avg_where(value, cond: Column) -> Column:
    return F.avg(F.when(cond, as_col(value)))


def mean_where(value, cond: Column) -> Column:
    """Mean that is compared with a threshold later: the order in which a cluster adds
    doubles varies, so noise beyond nine digits must not decide the verdict."""
    return F.round(avg_where(value, cond), 9)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def scoped(df: DataFrame, org: str | None) -> DataFrame:
    """The organization predicate, first on every read so that it reaches the scan."""
    return df if org is None else df.filter(F.col("organization_id") == org)


def broadcast_page(page: DataFrame, limit: int) -> DataFrame:
    """Broadcast a page of keys: at most ``MAX_PAGE`` rows of a few short columns.

    A longer "page" is left to the optimizer, which measures it and falls back to a
    shuffled join.
    """
    return F.broadcast(page) if limit <= MAX_PAGE else page


def page_of(df: DataFrame, order: Iterable[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order (a top-k, never a full sort)."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns here, once per row.

    Filters on a projected expression are pushed below it by repeating the expression.
    A generator stops that, which matters for expressions over whole texts.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))
