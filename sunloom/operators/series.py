"""Row frames, running totals, EWMA and CUSUM over long series without one task per series.

A series may hold a third of all rows, so nothing here orders a whole series in a single window
partition.  Rows get an exact position from per-slice counts, are cut into equal blocks of
consecutive rows, and each block carries copies of the few neighbouring rows its frames need.
What crosses block borders (running totals, filter state) is computed on one summary row per
block and joined back.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sunloom.session import stored

BLOCK = "_block"
POS = "_pos"
HALO = "_halo"
PACK = "_row"


@dataclass(frozen=True)
class Series:
    """Key columns, the time column, and tie-breakers that make the order total."""

    keys: tuple[str, ...]
    time: str
    ties: tuple[str, ...] = ()
    slice_seconds: int = 86400
    block_rows: int = 8192

    @property
    def order(self) -> list[str]:
        return [self.time, *self.ties]

    def window(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *extra).orderBy(*self.order)

    @property
    def blocked(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(POS)


def number_rows(df: DataFrame, s: Series, name: str = POS, seen: dict[str, Column] | None = None) -> DataFrame:
    """Exact 0-based position of each row in its series: slice offset + position in the slice.

    `seen` names tests; each becomes a column that tells whether any row of the series passes.
    """
    tests = seen or {}
    # one column for keys that may be NULL: join and window share its partitions
    slice_ = F.struct(*s.keys, F.floor(F.unix_seconds(F.col(s.time)) / s.slice_seconds).alias("_n"))
    sliced = df.withColumn("_slice", slice_)
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"), *[F.max(t).alias(n) for n, t in tests.items()])
    whole = Window.partitionBy(*[F.col("_slice")[k] for k in s.keys])
    before = whole.orderBy("_slice._n").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), *[F.max(n).over(whole).alias(n) for n in tests])
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy(*s.order)) - 1
    return sliced.join(starts, "_slice", "left").withColumn(name, F.col("_start") + rank).drop("_slice", "_start")


def blocks(df: DataFrame, s: Series, before: int = 0, after: int = 0, seen: dict[str, Column] | None = None) -> DataFrame:
    """Cut every series into blocks; rows near a border are copied into the neighbour as halo.  `seen`: see `number_rows`."""
    rows = max(s.block_rows, before, after)
    pos = F.col(POS)
    home = F.floor(pos / rows)
    targets = [home]
    if before:
        targets.append(F.when(pos % rows >= rows - before, home + 1))
    if after:
        targets.append(F.when((pos % rows < after) & (home > 0), home - 1))
    numbered = number_rows(df, s, seen=seen)
    if len(targets) == 1:
        return numbered.withColumn(BLOCK, home).withColumn(HALO, F.lit(False))
    return numbered.withColumn(BLOCK, F.explode(F.array_compact(F.array(*targets)))).withColumn(
        HALO, F.col(BLOCK) != home
    )


def packed(df: DataFrame, read: Sequence[str]) -> DataFrame:
    """The columns that are read, and all others as one struct.

    Every sort, window and join copies its rows column by column; what it does not read then travels as one value.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in read]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in read], F.struct(*rest).alias(PACK)) if rest else df


def unpacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Undo `packed`: first `columns` in their order, then what was added since."""
    have = set(df.columns)
    first = [F.col(f"`{c}`") if c in have else F.col(PACK).getField(c).alias(c) for c in columns]
    return df.select(*first, *[F.col(f"`{c}`") for c in df.columns if c != PACK and c not in columns])


def core(df: DataFrame) -> DataFrame:
    """Drop the halo copies once the framed columns exist."""
    return df.filter(~F.col(HALO))


def without_marks(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK, POS, HALO)


def running(df: DataFrame, s: Series, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Inclusive running sum / max / min / last over each series of an already blocked table.

    `columns` maps a name to (kind, expression); `last` keeps the latest non-NULL value.
    """
    keys = [*s.keys, BLOCK]
    frame = s.blocked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*s.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    inner, totals, carried, merged = {}, [], [], {}
    for name, (kind, expr) in columns.items():
        here, back = F.col(f"_in_{name}"), F.col(f"_carry_{name}")
        if kind == "last":
            inner[f"_in_{name}"] = F.last(expr, ignorenulls=True).over(frame)
            totals.append(F.max_by(expr, F.when(expr.isNotNull(), F.col(POS))).alias(name))
            carried.append(F.last(name, ignorenulls=True).over(earlier).alias(f"_carry_{name}"))
            merged[name] = F.coalesce(here, back)
            continue
        agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
        inner[f"_in_{name}"] = agg(expr).over(frame)
        totals.append(agg(expr).alias(name))
        carried.append(agg(name).over(earlier).alias(f"_carry_{name}"))
        if kind == "sum":
            merged[name] = F.when(here.isNull() & back.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(back, F.lit(0))
            )
        else:
            merged[name] = (F.greatest if kind == "max" else F.least)(here, back)
    summary = df.groupBy(*keys).agg(*totals).select(*keys, *carried)
    out = _join(df, summary, keys).withColumns(inner).withColumns(merged)
    return out.drop(*inner, *[f"_carry_{n}" for n in columns])


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL on both sides."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def previous(df: DataFrame, s: Series, columns: dict[str, str]) -> DataFrame:
    """Previous row's values in each series; the result keeps its block marks."""
    b = blocks(df, s, before=1)
    return core(b.withColumns({name: F.lag(c).over(s.blocked) for name, c in columns.items()}))


def islands(df: DataFrame, s: Series, opens: Column, name: str = "island") -> DataFrame:
    """Gaps-and-islands id: running count of rows where `opens` is true (needs block marks)."""
    return running(df, s, {name: ("sum", F.when(F.coalesce(opens, F.lit(True)), 1).otherwise(0))})


def attach(df: DataFrame, per_series: DataFrame, s: Series, store: bool = False) -> DataFrame:
    """Join one-row-per-series values to a blocked table on (keys, block).

    The per-series rows are first spread over each series' blocks, so a hot series never meets its
    statistics in one task and the big side keeps its partitioning.  With `store` the spread rows are
    materialised first: of a size that can be broadcast, they are, and the blocked rows are not shuffled.
    """
    keys = [*s.keys, BLOCK]
    spread = _join(df.select(*keys).distinct(), per_series, s.keys, "inner")
    return _join(df, stored(spread) if store else spread, keys)


def for_ewma(s: Series, lam: float) -> Series:
    """Block length for which (1-λ)^-rows stays far from overflow."""
    q = 1.0 - lam
    if not 0.0 < q < 1.0:
        return s
    return replace(s, block_rows=max(16, min(s.block_rows, int(200 / -math.log10(q)))))


def _carried_ewma(ends: DataFrame, s: Series, q: float) -> DataFrame:
    """`_in`: what a block receives, from the (n, end, first) of the blocks before it.

    The state after a block is end + q^n · what it received, so what is received is a geometric sum over earlier ends.  Blocks
    are taken together by the span of eligible rows in which they begin, so long that powers of q stay finite and that what is
    a whole span away is below the precision of a double: only the sums of the two spans before still count.
    """
    rows = max(1, int(50 / -math.log10(q)))
    order = Window.partitionBy(*s.keys).orderBy(BLOCK)
    n = F.coalesce("_b.n", F.lit(0))
    total = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = ends.withColumns({"_upto": total, "_here_n": n}).withColumn("_span", F.floor((F.col("_upto") - F.col("_here_n")) / rows))
    # q^-N, measured from the begin of the span
    grown = F.pow(F.lit(1.0 / q), F.col("_upto") - F.col("_span") * rows)
    seed = Window.partitionBy(*s.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_first", F.first("_b.first", ignorenulls=True).over(seed))
    inside = Window.partitionBy(*s.keys, "_span").orderBy(BLOCK)
    d = d.withColumn("_sum", F.sum(F.coalesce("_b.end", F.lit(0.0)) * grown).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.withColumn("_before", F.coalesce(F.lag("_sum").over(inside), F.lit(0.0)))
    last = d.groupBy(*s.keys, "_span").agg(F.max("_upto").alias("_end_N"), F.max_by("_sum", BLOCK).alias("_end_sum"))
    last = last.withColumn("_level", F.col("_end_sum") * F.pow(F.lit(q), F.col("_end_N") - F.col("_span") * rows))
    spans = Window.partitionBy(*s.keys).orderBy("_span")
    back = {f"{name}_{k}": F.lag(name, k).over(spans) for name in ("_level", "_end_N") for k in (1, 2)}
    last = last.select(*s.keys, "_span", *[e.alias(n) for n, e in back.items()])
    d = _join(d, last, [*s.keys, "_span"])
    here = F.col("_upto") - F.col("_here_n")
    inner = F.col("_before") * F.pow(F.lit(q), here - F.col("_span") * rows)
    # the first eligible row of the series stands for everything before it
    outer = sum(F.coalesce(F.col(f"_level_{k}") * F.pow(F.lit(q), here - F.col(f"_end_N_{k}")), F.lit(0.0)) for k in (1, 2))
    start = F.coalesce(F.col("_first") * F.pow(F.lit(q), here), F.lit(0.0))
    out = d.withColumn("_in", F.when(F.col("_first").isNotNull(), inner + outer + start))
    return out.drop("_upto", "_here_n", "_span", "_first", "_sum", "_before", *back)


def _ewma_local(d: DataFrame, s: Series, value: str, ok: Column, lam: float) -> DataFrame:
    q = 1.0 - lam
    upto = s.blocked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z = F.when(ok, F.col(value))
    d = d.withColumns({"_z": z, "_t": F.count(z).over(upto)})
    grown = F.sum(lam * F.col("_z") * F.pow(F.lit(1.0 / q), F.col("_t"))).over(upto)
    return d.withColumn("_e", grown * F.pow(F.lit(q), F.col("_t")))


def _cusum_local(d: DataFrame, s: Series, value: str, ok: Column, k: float) -> DataFrame:
    d = d.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    upto = s.blocked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_seg", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(upto))
    seg = Window.partitionBy(*s.keys, BLOCK, "_seg").orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = {"pos": F.col(value) - k, "neg": -F.col(value) - k}
    d = d.withColumns({f"_p_{n}": F.coalesce(F.sum(F.when(F.col("_ok"), u)).over(seg), F.lit(0.0)) for n, u in sides.items()})
    return d.withColumns({f"_s_{n}": F.col(f"_p_{n}") - F.least(F.lit(0.0), F.min(f"_p_{n}").over(seg)) for n in sides})


def add_filters(df: DataFrame, s: Series, value: str, eligible: Column, lam: float | None = None, k: float | None = None,
                ewma: str = "ewma", cusum: str = "cusum", store: bool = False) -> DataFrame:
    """EWMA and/or two-sided CUSUM over the eligible rows of a blocked table.

    EWMA (`lam`): the first eligible row seeds, state survives gaps.  Inside a block the recursion
    e = (1-λ)e + λz is a geometric running sum (see `for_ewma` for the block length).
    CUSUM (`k`): restarts at every ineligible row; within a run s = P - min(0, running min P) for the
    running total P of z-k.  Both need one summary row per block; what a block receives from the
    earlier ones is worked out on those summaries and joined back (materialised first with `store`, see `attach`).
    """
    ok = eligible & F.col(value).isNotNull()
    keys = [*s.keys, BLOCK]
    q = None if lam is None else 1.0 - lam
    smooth, sums = q is not None and q > 0.0, k is not None
    columns = df.columns
    if smooth or sums:
        df = packed(df.withColumn("_fit", ok), [*keys, POS, value, "_fit"])
        ok = F.col("_fit")
    d, aggs, names = df, [], ("pos", "neg")
    if smooth:
        d = _ewma_local(d, s, value, ok, lam)
        have = F.when(F.col("_z").isNotNull(), F.col(POS))
        aggs.append(F.struct(F.count("_z").alias("n"), F.max_by("_e", have).alias("end"), F.min_by("_z", have).alias("first")).alias("_b"))
    if sums:
        d = _cusum_local(d, s, value, ok, k)
        aggs.append(F.max("_seg").alias("_resets"))
        aggs += [F.max_by(f"_s_{n}", POS).alias(f"_end_{n}") for n in names]
        aggs += [F.max_by(f"_p_{n}", POS).alias(f"_tot_{n}") for n in names]
    if not aggs:
        return d.withColumn(ewma, F.when(ok, F.col(value)))
    ends = d.groupBy(*keys).agg(*aggs)
    # what is carried reads the summaries several times
    ends = stored(ends) if store else ends
    order = Window.partitionBy(*s.keys).orderBy(BLOCK)
    entry = {}
    if smooth:
        ends = _carried_ewma(ends, s, q)
        entry["_in"] = F.col("_in")
    if sums:
        reset = F.col("_resets") > 0
        ends = ends.withColumn("_run", F.sum(F.when(reset, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        run = Window.partitionBy(*s.keys, "_run").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # the first block of a run ends at its own value; later blocks add their totals
        ends = ends.withColumns({f"_T_{n}": F.sum(F.when(reset, 0.0).otherwise(F.col(f"_tot_{n}"))).over(run) for n in names})
        ends = ends.withColumns({f"_o_{n}": F.col(f"_T_{n}") + F.max(F.col(f"_end_{n}") - F.col(f"_T_{n}")).over(run) for n in names})
        entry.update({f"_in_{n}": F.lag(f"_o_{n}").over(order) for n in names})
    ends = ends.select(*keys, *[e.alias(n) for n, e in entry.items()])
    out = _join(d, stored(ends) if store else ends, keys)
    spare = ["_in", "_fit"]
    if lam is not None:
        level = F.col("_e") + F.pow(F.lit(q), F.col("_t")) * F.col("_in") if smooth else F.col(value)
        out = out.withColumn(ewma, F.when(ok, level))
        spare += ["_z", "_t", "_e"]
    if sums:
        def side(n: str) -> Column:
            carried = (F.col("_seg") == 0) & F.col(f"_in_{n}").isNotNull()
            return (
                F.when(~F.col("_ok"), F.lit(0.0))
                .when(carried, F.greatest(F.col(f"_s_{n}"), F.col(f"_in_{n}") + F.col(f"_p_{n}"))).otherwise(F.col(f"_s_{n}"))
            )

        out = out.withColumns({f"{cusum}_{n}": side(n) for n in names})
        out = out.withColumn(f"{cusum}_score", F.when(F.col("_ok"), F.greatest(f"{cusum}_pos", f"{cusum}_neg")))
        spare += ["_ok", "_seg", *[f"_{x}_{n}" for x in ("p", "s", "in") for n in names]]
    return unpacked(out.drop(*spare), columns)
