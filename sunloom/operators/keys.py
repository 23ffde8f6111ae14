"""Source names: kinds, roots, tracker numbers, device keys and fuzzy matches."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.functions.values import col, normal_id


def _text(c: Column | str) -> Column:
    return F.trim(F.coalesce(col(c), F.lit("")))


def is_mppt(c: Column | str) -> Column:
    return F.contains(F.upper(F.coalesce(col(c), F.lit(""))), F.lit("|MPPT"))


def is_agg(c: Column | str) -> Column:
    u = F.upper(_text(c))
    return (u != "") & (~F.contains(u, F.lit("|")) | F.endswith(u, F.lit("|AGG")))


def kind(c: Column | str) -> Column:
    return F.when(is_mppt(c), "mppt").when(is_agg(c), "agg").otherwise("other")


def root(c: Column | str) -> Column:
    return F.trim(F.substring_index(_text(c), "|", 1))


def base(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_text(c), r"(?i)\|MPPT.*$", ""), r"(?i)\|AGG$", ""))


def mppt_number(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?i)(?:^|\|)MPPT\s*([0-9]+)\b", 1).try_cast("int")


def canonical_source(df: DataFrame, keys: Sequence[str], source: str, rank: Column) -> DataFrame:
    """Per key: the first aggregate source in rank order, else the root of the first source."""
    agg = F.when(is_agg(source), rank)
    return df.groupBy(*keys).agg(
        F.coalesce(F.min_by(source, agg), root(F.min_by(source, rank)), F.lit("")).alias("canonical_source")
    )


def device_key(pn: Column, devcode: Column, devaddr: Column, sn: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (pn, devcode, devaddr, sn)])


def parse_device_key(c: Column | str) -> Column:
    """`pn|devcode|devaddr|sn` or `pn=.. | devcode=.. | devaddr=.. | sn=..`; NULL when a part is missing."""
    s = _text(c)
    names = ("pn", "devcode", "devaddr", "sn")
    parts = F.split(s, r"\|")
    named = {n: F.nullif(F.trim(F.regexp_extract(s, rf"(?i)\b{n}\s*=\s*([^|]+)", 1)), F.lit("")) for n in names}
    placed = {n: F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")) for i, n in enumerate(names)}
    value = {n: F.when(F.contains(s, F.lit("=")), named[n]).when(F.size(parts) == 4, placed[n]) for n in names}
    address = value["devaddr"].try_cast("int")
    whole = F.struct(
        value["pn"].alias("pn"), value["devcode"].alias("devcode"), address.alias("devaddr"), value["sn"].alias("sn")
    )
    return F.when(value["pn"].isNotNull() & value["devcode"].isNotNull() & address.isNotNull() & value["sn"].isNotNull(), whole)


def _substrings(c: Column) -> Column:
    """All distinct substrings of a short identifier."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    parts = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - i + 1, F.lit(1))), lambda n: F.substring(c, i, n)))
    return F.array_distinct(F.flatten(parts))


def _prefixes(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda n: F.left(c, n))


def match_device_keys(sources: DataFrame, devices: DataFrame, keys: Sequence[str], source: str = "source_oper",
                      device: str = "device_key", order: str = "device_order") -> DataFrame:
    """Best device for every source of a plant.

    Exact normalised name first, then containment (0.9 · shorter/longer), then shared prefix share;
    equal scores go to the first device in order.  Containment and prefixes are equi-joins on
    substrings of the short identifiers, so a plant with many devices never forms all pairs.
    """
    keys = list(keys)
    c = F.col
    s = sources.select(*keys, source).distinct().withColumn("_s", normal_id(c(source)))
    named = s.filter("_s <> ''")
    d = devices.withColumn("_d", normal_id(c(device))).filter("_d <> ''")
    d = d.groupBy(*keys, "_d").agg(F.min_by(device, order).alias(device), F.min(order).alias("_o"))
    pick = lambda score: F.struct(score.alias("score"), (-c("_o")).alias("o"), c(device).alias("device"))
    same = c("_s") == c("_d")
    longest, shortest = F.greatest(F.length("_s"), F.length("_d")), F.least(F.length("_s"), F.length("_d"))
    part = F.when(same, 2.0).otherwise(1.0 + 0.9 * shortest / longest)
    in_source = named.withColumn("_d", F.explode(_substrings(c("_s")))).join(d, [*keys, "_d"])
    in_device = d.withColumn("_s", F.explode(_substrings(c("_d")))).join(named, [*keys, "_s"])
    cols = [*keys, source, pick(part).alias("_p")]
    # devices with one prefix and length score alike: the first of them stands for all
    stems = d.withColumn("_x", F.explode(_prefixes(c("_d")))).groupBy(*keys, "_x", F.length("_d").alias("_len")).agg(
        F.min_by(device, "_o").alias(device), F.min("_o").alias("_o"))
    shared = named.withColumn("_x", F.explode(_prefixes(c("_s")))).join(stems, [*keys, "_x"])
    prefix = pick(F.length("_x") / F.greatest(F.length("_s"), c("_len"))).alias("_p")
    best = in_source.select(*cols).union(in_device.select(*cols)).union(shared.select(*keys, source, prefix)).groupBy(*keys, source).agg(F.max("_p").alias("_p"))
    return s.select(*keys, source).join(best, [*keys, source], "left").select(*keys, source, c("_p.device").alias(device))


def dominant(df: DataFrame, keys: Sequence[str], value: Sequence[str], where: Column | None = None,
             weight: Column | None = None) -> DataFrame:
    """Most frequent combination per key; ties go to the alphabetically first."""
    d = df.filter(where) if where is not None else df
    counted = d.groupBy(*keys, *value).agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).alias("n_rows"))
    pick = F.min_by(F.struct(*value, "n_rows"), F.struct(-F.col("n_rows"), *value))
    if not keys:
        return counted.agg(pick.alias("_b")).select("_b.*")
    return counted.groupBy(*keys).agg(pick.alias("_b")).select(*keys, "_b.*")


def dominant_operation_source(df: DataFrame, keys: Sequence[str], source: str = "source_oper") -> DataFrame:
    """Largest aggregate source; without one, the base name with the most tracker rows."""
    counted = df.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("_n"))
    agg = F.when(is_agg(source), F.struct(-F.col("_n"), F.col(source)))
    bases = counted.groupBy(*keys, base(source).alias("_base")).agg(
        F.sum("_n").alias("_bn"), F.min_by(source, agg).alias("_agg"), F.min(agg).alias("_rank")
    )
    pick_base = F.min_by("_base", F.when(F.col("_base") != "", F.struct(-F.col("_bn"), F.col("_base"))))
    return bases.groupBy(*keys).agg(F.coalesce(F.min_by("_agg", "_rank"), pick_base).alias(source))


def first_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Distinct keys keeping the first row in order, reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def trackers_seen(df: DataFrame, source: str = "source_oper") -> list[int]:
    """Tracker numbers of the sources of a table; a plant has a handful."""
    found = df.select(mppt_number(F.col(source)).alias("k")).filter("k is not null").distinct()
    return sorted(r["k"] for r in found.collect())


def trackers_in(columns: Sequence[str], quantity: str) -> list[int]:
    """Numbers k of the columns mppt<k>_<quantity>."""
    found = (re.fullmatch(rf"mppt(\d+)_{quantity}", c) for c in columns)
    return sorted(int(m[1]) for m in found if m)


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int | None) -> DataFrame:
    """Top rows per key, all of them without a limit; two rounds, so a hot key is cut down before it meets in one task."""
    if limit is None:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(64))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= limit)
    return cut.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= limit).drop("_salt", "_rank")
