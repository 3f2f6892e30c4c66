"""A compact filter, sort, page and group language over nested entities, compiled to Columns.

    expression := condition (',' condition)*
    condition  := ['!'] path ':' value
    value      := ['!'] alternative ('|' alternative)*
    alternative:= '>' n | '<' n | a '-' b | text
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most alternatives of a condition, rows of a page, rows that paging reaches.
MOST_ALTERNATIVES, MOST_PAGE, MOST_REACH = 50, 200, 10_000
_NUMERIC = (T.IntegerType, T.LongType, T.ShortType, T.DoubleType, T.FloatType, T.DecimalType)


class FilterError(ValueError):
    pass


def conditions(text: str) -> list[tuple[bool, str, list[str]]]:
    """(negated, path, alternatives) of each condition."""
    out = []
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        head, colon, value = part.partition(":")
        negated, path = head.startswith("!"), head.removeprefix("!").strip()
        if not colon or not path or not value:
            raise FilterError(f"not a condition: {part!r}")
        if value.startswith("!"):
            negated, value = not negated, value[1:]
        alternatives = value.split("|")
        if len(alternatives) > MOST_ALTERNATIVES:
            raise FilterError(f"more than {MOST_ALTERNATIVES} alternatives for {path}")
        out.append((negated, path, alternatives))
    return out


def _test(value: Column, kind: T.DataType, alternative: str) -> Column:
    if isinstance(kind, _NUMERIC):
        if m := re.fullmatch(r"([<>])(-?\d+(?:\.\d+)?)", alternative):
            return value > F.lit(float(m[2])) if m[1] == ">" else value < F.lit(float(m[2]))
        if m := re.fullmatch(r"(\d+(?:\.\d+)?)?-(\d+(?:\.\d+)?)?", alternative):
            parts = [value >= float(m[1])] if m[1] else []
            parts += [value <= float(m[2])] if m[2] else []
            if parts:
                return reduce(and_, parts)
        try:
            return value == float(alternative)
        except ValueError:
            raise FilterError(f"not a number: {alternative!r}") from None
    if isinstance(kind, T.BooleanType):
        return value == (alternative.lower() == "true")
    return value == alternative


def along(value: Column, kind: T.DataType, path: list[str], test) -> Column:
    """``test`` of what ``path`` leads to below ``value``; across an array: of any element."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: F.coalesce(along(x, kind.elementType, path, test), F.lit(False))), F.lit(False))
    if not path:
        return test(value, kind)
    if not isinstance(kind, T.StructType) or path[0] not in kind.names:
        raise FilterError(f"no field {path[0]!r}")
    return along(value[path[0]], kind[path[0]].dataType, path[1:], test)


def compiled(df: DataFrame, text: str) -> Column | None:
    """The filter as one Column over ``df``; None for an empty one.  A missing value meets no condition, but for a negated one."""
    parts = []
    for negated, path, alternatives in conditions(text):
        first, *rest = path.split(".")
        if first not in df.columns:
            raise FilterError(f"no field {first!r}")
        test = lambda v, k: reduce(or_, [_test(v, k, a) for a in alternatives])  # noqa: B023, E731
        hit = F.coalesce(along(F.col(first), df.schema[first].dataType, rest, test), F.lit(False))
        parts.append(~hit if negated else hit)
    return reduce(and_, parts) if parts else None


def filtered(df: DataFrame, text: str) -> DataFrame:
    test = compiled(df, text)
    return df if test is None else df.where(test)


def searched(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows in which every word of ``text`` stands, as a whole word, in one of ``columns``.  Words are not stemmed."""
    bag = F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+")
    return df.where(reduce(and_, [F.array_contains(bag, w) for w in text.lower().split()] or [F.lit(True)]))


def sort_keys(text: str) -> list[Column]:
    """``field[:desc]``, comma separated; missing values last."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, way = part.partition(":")
        out.append(F.desc_nulls_last(name) if way == "desc" else F.asc_nulls_last(name))
    return out


def page(df: DataFrame, sort: str, ident: str, number: int = 1, size: int = 25) -> DataFrame:
    """A page of rows in order; ties by ``ident``."""
    if not 1 <= size <= MOST_PAGE or number < 1 or number * size > MOST_REACH:
        raise FilterError("a page has 1 to 200 rows and ends within 10000")
    return df.orderBy(*sort_keys(sort), ident).offset((number - 1) * size).limit(size)


def after(df: DataFrame, column: str, ident: str, cursor: tuple | None, size: int = 25) -> DataFrame:
    """The rows after a cursor (value, id) by ``column`` falling, then ``ident``: a predicate, so no row before it is sorted."""
    if cursor is not None:
        value, last = cursor
        df = df.where((F.col(column) < value) | ((F.col(column) == value) & (F.col(ident) > last)))
    return df.orderBy(F.desc(column), ident).limit(size)


def sample(df: DataFrame, n: int, seed: int, ident: str) -> DataFrame:
    """``n`` rows by the order of a hash of seed and id: the same for the same seed, however the rows are dealt."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(ident).cast("string"))), ident).limit(n)


def group_by(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """key, key_display_name, count: most first."""
    rows = df.groupBy(F.col(key).cast("string").alias("key"), F.col(name or key).cast("string").alias("key_display_name")).agg(F.count("*").alias("count"))
    return rows.orderBy(F.desc("count"), "key")


def selected(df: DataFrame, fields: str) -> DataFrame:
    return df.select(*[f.strip() for f in fields.split(",") if f.strip()])
