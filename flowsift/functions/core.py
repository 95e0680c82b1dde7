"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    Column aliases are pasted into every use when projections collapse or filters move down; a
    value bound here stays one node, so long chains of derived values keep a plan of linear size.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
