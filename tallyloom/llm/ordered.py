"""Aggregates over what stands earlier, without a task that gets all rows of a key.

Places are cut into blocks of 4,096 numbers.  Each block of a key is summed up, the
sums are carried over blocks by the same rule, and what stands before a block is
joined to its rows, where a window does the rest.  A window or a block's sum so never
has more than 4,096 rows, whatever a key's share is, and the number of levels follows
the range of the places: two to 16 million, three to 68 billion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 12

_TOGETHER = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def preceding(rows: DataFrame, by: list[str], place: str, **how: str) -> DataFrame:
    """rows with `<name>_before` for each name=sum|min|max: that of the column over the rows of the same `by` whose place is smaller.

    Places are whole numbers, no two alike within a key; keys have no nulls.  Nulls are
    left out of min and max, which are null where there is nothing before; a sum is 0
    there.
    """
    low, high = rows.agg(F.min(place), F.max(place)).first()
    levels = 0
    while low is not None and (low >> (BITS * levels)) != (high >> (BITS * levels)) and (high >> (BITS * levels)) - (low >> (BITS * levels)) >= 1 << BITS:
        levels += 1
    return _preceding(rows, by, place, how, levels)


def _preceding(rows: DataFrame, by: list[str], place: str, how: dict[str, str], levels: int) -> DataFrame:
    own = lambda window: {f"{c}_before": _TOGETHER[kind][0](c).over(window) for c, kind in how.items()}
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    if not levels:
        out = rows.withColumns(own(earlier(*(by or [F.lit(0)]))))
        return out.withColumns({f"{c}_before": F.coalesce(f"{c}_before", F.lit(0)) for c, kind in how.items() if kind == "sum"})
    block = f"_block{levels}"
    blocked = rows.withColumn(block, F.shiftright(F.col(place).cast("long"), BITS))
    sums = blocked.groupBy(*by, block).agg(*(_TOGETHER[kind][0](c).alias(c) for c, kind in how.items()))
    above = _preceding(sums, by, block, how, levels - 1).select(*by, block, *(F.col(f"{c}_before").alias(f"_{c}_above") for c in how))
    inside = blocked.join(above, [*by, block]).withColumns(own(earlier(*by, block)))
    both = {f"{c}_before": _TOGETHER[kind][1](F.col(f"_{c}_above"), F.col(f"{c}_before")) for c, kind in how.items()}
    return inside.withColumns(both).drop(block, *(f"_{c}_above" for c in how))
