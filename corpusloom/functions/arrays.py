"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    An expression named inside a lambda would otherwise be evaluated again for
    every element the lambda visits.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def elements(values: str | Column) -> Column:
    """Argument for ``explode`` that keeps its input from being computed twice.

    Exploding a bare column makes the optimizer add a ``size > 0`` filter and push it,
    with everything the column is made of, below the projection that makes it. An
    expression is left alone.
    """
    if isinstance(values, str):
        return F.when(F.size(values) > 0, F.col(values))
    return values
