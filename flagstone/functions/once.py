"""Values computed once inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value computed once.

    A column used many times in one expression is otherwise written out, compiled and possibly
    evaluated at each use; long rules would outgrow what the JVM accepts as one method.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])
