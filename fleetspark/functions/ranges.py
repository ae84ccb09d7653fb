"""Number ranges (G3): ``seq START STOP`` and ``seq START -1 STOP``.

``sequence`` raises when the step points away from ``stop``; ``seq`` prints
nothing, so that case is an empty array here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def number_range(start, stop, step=1) -> Column:
    """``seq start step stop`` as an array (both ends included), empty when the
    step points away from ``stop``."""
    a, b, s = _c(start), _c(stop), _c(step)
    empty = ((s > 0) & (a > b)) | ((s < 0) & (a < b))
    return F.when(empty, F.array().cast("array<int>")).otherwise(F.sequence(a, b, s).cast("array<int>"))
