"""Array functions over logits / probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(c) -> Column:
    """Numerically stable softmax of a numeric array (max subtracted)."""
    a = F.transform(_col(c), lambda x: x.cast("double"))
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(c) -> Column:
    """0-based index of the first maximum."""
    a = _col(c)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def array_max(c) -> Column:
    """The maximum element."""
    return F.array_max(_col(c))


def round4(c) -> Column:
    """H8."""
    return F.round(_col(c), 4)
