"""Functions of columns."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once a row. An expression that is used many times would otherwise be written out, and grow with each level."""
    return F.element_at(F.transform(F.array(value), then), 1)
