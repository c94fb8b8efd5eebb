"""What planning must leave alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kept_apart(x: Column) -> Column:
    """x, as something that Catalyst may not copy into filters and projections around it. Filters, those too that it infers
    from generators, are else pushed below a projection with its expressions in place of its names; one that is
    named inside a function over an array is then computed for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, x)
