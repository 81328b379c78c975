"""Binary search over a sorted array column, written as plain column expressions.

:func:`with_count_less` adds the number of elements of an ascending array column
that are strictly smaller than a value (``searchsorted`` with side='left').  It is
built from ``ceil(log2(n + 1))`` projection steps of ``try_element_at`` + ``if``,
so it costs O(log n) per row, stays inside whole-stage codegen and needs no
Python worker.  Each step is its own projection, so the expression does not
grow with the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_count_less(df: DataFrame, bounds: str, value: Column, size: int, out: str,
                    *, or_equal: bool = False) -> DataFrame:
    """Add column ``out`` = #elements of array column ``bounds`` below ``value``.

    ``size`` is an upper bound on the array length (arrays may be shorter).
    With ``or_equal=True`` elements equal to ``value`` are counted too.
    A NULL value gives 0.
    """
    tmp = f"__{out}_v"
    df = df.withColumn(tmp, value).withColumn(out, F.lit(0))
    if size > 0:
        step = 1 << (max(1, int(size).bit_length()) - 1)
        while step >= 1:
            probe = F.try_element_at(F.col(bounds), F.col(out) + F.lit(step))
            hit = (probe <= F.col(tmp)) if or_equal else (probe < F.col(tmp))
            df = df.withColumn(out, F.col(out) + F.when(hit, F.lit(step)).otherwise(F.lit(0)))
            step //= 2
    return df.drop(tmp)
