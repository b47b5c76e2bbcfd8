"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`.

    Keeps expressions small: naming a column twice in Python copies its whole tree.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
