"""Values that an expression needs more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row: inside the lambdas of ``transform`` and its like, an expression is computed again for each element."""
    return F.get(F.transform(F.array(value), body), 0)
