"""Exact medians of long series by selection: no task holds a series, and no map of its values."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.operators import series as S
from sunloom.session import checkpointed

#: widths of the slices a value is looked for in, coarse to fine (microseconds): 1000 s, 0.1 s, the value itself.  A step looks
#: at no more than one slice's children: 10^4 of the second, 10^5 of the third width, however many rows there are
WIDTHS = (1_000_000_000, 100_000, 1)


def _slice_of(value: str, width: int | None) -> Column:
    """Number of the slice that holds a value, downwards for negative ones too, in 64-bit integers; NULL for the whole series."""
    if width is None:
        return F.lit(None).cast("long")
    return F.expr(f"({value} - pmod({value}, {width}L)) div {width}L")


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """One row per key with the exact median of each value (whole microseconds; NULLs do not count, a key without any value has
    no row).

    Rows become counts per distinct value, with partial sums before the shuffle.  The two middle ranks are then looked for from
    coarse slices to fine ones: in each step the slices inside the last chosen one are counted and summed up in order, and the
    one that holds the rank is chosen.  Keys may be NULL.
    """
    names = list(values)
    keys = [*keys, "_which"]
    known = df.select(*keys[:-1], F.inline(F.array(*[F.struct(F.lit(n).alias("_which"), v.cast("long").alias("_us")) for n, v in values.items()])))
    counts = checkpointed(known.filter("_us IS NOT NULL").groupBy(*keys, "_us").agg(F.count(F.lit(1)).alias("_n")))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    middle = F.array_distinct(F.array(F.expr("(_total - 1) div 2"), F.expr("_total div 2")))
    wanted = totals.select(*keys, F.explode(middle).alias("_rank"), F.lit(None).cast("long").alias("_slice"))
    wanted = wanted.withColumn("_left", F.col("_rank"))
    above: int | None = None
    for width in WIDTHS:
        sliced = counts.withColumns({"_slice": _slice_of("_us", above), "_part": _slice_of("_us", width)})
        if above:
            sliced = S._join(sliced, wanted.select(*keys, "_slice").distinct(), [*keys, "_slice"], "inner")
        sizes = sliced.groupBy(*keys, "_slice", "_part").agg(F.sum("_n").alias("_n"))
        order = Window.partitionBy(*keys, "_slice").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sizes = sizes.withColumn("_upto", F.sum("_n").over(order))
        hit = S._join(wanted, sizes, [*keys, "_slice"], "inner").filter((F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_n")))
        wanted = hit.select(*keys, "_rank", F.col("_part").alias("_slice"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"))
        above = width
    found = wanted.groupBy(*keys).agg((F.sum("_slice") / F.count(F.lit(1))).alias("_median"))
    return found.groupBy(*keys[:-1]).agg(*[F.max(F.when(F.col("_which") == n, F.col("_median"))).alias(n) for n in names])
