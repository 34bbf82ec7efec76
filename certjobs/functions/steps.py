"""Computing several columns once, for use by many others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(rows: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` and the new columns, each evaluated once per row.

    Projections above one another are merged by the optimiser, so a costly column that several others use would be
    evaluated for each of them. A one-element array that is inlined again stands between them.
    """
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` names it: what ``computed`` is to rows, within an expression.

    Inside lambdas, arrays and branches nothing else keeps a repeated part from being evaluated again. ``c`` is bound as the variable
    of a one-element array.
    """
    return F.get(F.transform(F.array(c), use), F.lit(0))
