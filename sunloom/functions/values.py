"""NULL-safe numbers, localised parsing, identifiers and small lookups."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, so aggregates are never poisoned."""
    c = col(c).try_cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def clean_doubles(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: finite(n) for n in names}) if names else df


def flag(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(False))


def clamp(c: Column, low: float, high: float) -> Column:
    """Clip keeping NULL (least/greatest skip NULL arguments, hence the guard)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def clamp01(c: Column) -> Column:
    """Clip to [0, 1]; a missing score counts as 0."""
    return F.greatest(F.least(F.coalesce(c, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def sum_or_null(c: Column) -> Column:
    return F.sum(c)


def mean_nonzero(c: Column, eps: float = 1e-9) -> Column:
    return F.avg(F.when(F.abs(c) > eps, c))


def first_by(value: Column, order: Column) -> Column:
    """First non-NULL value in the given order (an aggregate)."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def array_mean_nonzero(values: Iterable[Column], min_abs: float) -> Column:
    kept = F.filter(F.array(*values), lambda x: x.isNotNull() & (F.abs(x) > min_abs))
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(kept) > 0, total / F.size(kept))


def _strip_units(text: Column) -> Column:
    return F.when(text.rlike(r"[^0-9\-.,]"), F.regexp_replace(text, r"[^0-9\-.,]", "")).otherwise(text)


def _local_number(s: Column) -> Column:
    swap = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    comma, dot = F.locate(",", F.reverse(s)), F.locate(".", F.reverse(s))
    number = (
        F.when(~F.contains(s, F.lit(",")), s).when(~F.contains(s, F.lit(".")), swap(s, ",", "."))
        .when(comma < dot, swap(swap(s, ".", ""), ",", ".")).otherwise(swap(s, ",", ""))
    )
    return number.try_cast("double")


def parse_local_number(c: Column | str) -> Column:
    """`1.234,56`, `1234.56`, `20 V` → double: with both marks the rightmost one is the decimal mark."""
    return _local_number(_strip_units(F.trim(col(c).cast("string"))))


def with_local_numbers(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Many localised numbers at once.

    One lambda over the array of texts keeps the generated code small; spelled out per column it grows
    past what the JIT compiles.
    """
    words = F.array(*[F.trim(t.cast("string")) for t in texts.values()])
    df = df.withColumn("_n", F.transform(F.transform(words, _strip_units), _local_number))
    return df.withColumns({n: F.get("_n", F.lit(i)) for i, n in enumerate(texts)}).drop("_n")


def local_number(text: Column) -> Column:
    """One localised number, units stripped."""
    return _local_number(_strip_units(F.trim(text.cast("string"))))


def parse_comma_number(c: Column | str) -> Column:
    return finite(F.replace(F.trim(col(c).cast("string")), F.lit(","), F.lit(".")).try_cast("double"))


# fixed values: accented letters and their plain forms
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"


def normal_id(c: Column | str) -> Column:
    """Lower-case, accents dropped, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(col(c), F.lit(""))), ACCENTED, PLAIN), "[^a-z0-9]", "")


def normal_label(c: Column | str, default: str = "unknown") -> Column:
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(t == "", F.lit(default)).otherwise(t)


def first_filled(*cols: Column | str) -> Column:
    """First non-NULL, non-blank text."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in cols])


def lookup(key: Column, table: dict[str, object], default: Column | None = None) -> Column:
    """Constant map lookup; absent keys give `default`."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return F.coalesce(found, default) if default is not None else found


def confidence_level(score: Column) -> Column:
    return (
        F.when(score.isNull(), "").when(score >= 0.85, "very_high").when(score >= 0.70, "high")
        .when(score >= 0.50, "moderate").when(score >= 0.30, "low").otherwise("very_low")
    )


def select_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[n for n in names if n in have])


def canonicalise(df: DataFrame, aliases: dict[str, Iterable[str]], required: Iterable[str] = ()) -> DataFrame:
    """Pick the first existing physical column for every canonical name; absent ones are NULL."""
    have = set(df.columns)
    out, missing = [], []
    for canon, names in aliases.items():
        hit = next((n for n in names if n in have), None)
        if hit is not None:
            out.append(F.col(hit).alias(canon))
        else:
            if canon in required:
                missing.append(canon)
            out.append(F.lit(None).cast("double").alias(canon))
    if missing:
        raise ValueError(f"no source column for {missing}")
    return df.select(*out)


def residual_rel(observed: Column, expected: Column, eps: float = 50.0) -> Column:
    return (observed - expected) / F.greatest(F.abs(expected), F.lit(float(eps)))


def residual_abs(observed: Column, expected: Column) -> Column:
    return observed - expected


def clip_abs(c: Column, limit: float) -> Column:
    return clamp(c, -float(limit), float(limit))


def irradiance_tier(g: Column, coarse: float | Column, fine: float | Column) -> Column:
    """A at or above fine, B at or above coarse, C when known, else N."""
    return F.when(g >= fine, "A").when(g >= coarse, "B").when(g.isNotNull(), "C").otherwise("N")


def in_native_region(lat: Column, lon: Column) -> Column:
    """The two boxes with native 15-minute solar data."""
    europe = lat.between(41.0, 59.5) & lon.between(-10.5, 26.0)
    america = lat.between(14.0, 84.5) & lon.between(-170.0, -50.0)
    return F.coalesce(europe | america, F.lit(False))


def vendor_azimuth(az: Column) -> Column:
    """0 = north, clockwise → (-180, 180] with 0 = south."""
    south_zero = F.pmod(F.pmod(az, F.lit(360.0)), F.lit(360.0)) - 180.0
    return F.when(F.abs(south_zero + 180.0) < 1e-12, F.lit(180.0)).otherwise(south_zero)


def clamp_tilt(t: Column) -> Column:
    return clamp(t, 0.0, 90.0)
