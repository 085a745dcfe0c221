"""Words of a text as native columns. A word is a run of anything but space and U+0009-U+000D."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` refers to it, also
    within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(rows: DataFrame) -> DataFrame:
    """``rows`` with all columns computed here: later filters aren't pushed in front of costly
    expressions, which would then run once more for the filter."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII text in SQL, bit by bit."""
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, y: list_reduce(list_prepend(xor(x, y), [CAST(b AS BIGINT) for b in range(8)]),
      lambda v, bit: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
