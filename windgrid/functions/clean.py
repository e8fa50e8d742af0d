"""Cleaning: finite numbers, identities, units, bands, ordered reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(x: Column) -> Column:
    """A double, or null for what does not parse or is not finite."""
    y = x.try_cast("double")
    return F.when(~F.isnan(y) & (F.abs(y) != float("inf")), y)


def all_finite(df: DataFrame) -> DataFrame:
    """Non-finite values of every float column become null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: finite(F.col(c)) for c in floats})


def require(df: DataFrame, numbers: list[str], others: list[str] = ()) -> DataFrame:
    """Rows in which the listed columns, as far as they exist, are finite or not null."""
    tests = [finite(F.col(c)).isNotNull() for c in numbers if c in df.columns] + [F.col(c).isNotNull() for c in others if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first non-null of the columns that exist; null if none does."""
    there = [F.col(c) for c in names if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def identity(x: Column, missing: str | None = "MISSING") -> Column:
    """Upper case, letters and digits only; one word for a missing one."""
    out = F.regexp_replace(F.upper(F.trim(x)), "[^A-Z0-9]", "")
    out = F.when(out != "", out)
    return F.coalesce(out, F.lit(missing)) if missing else out


def altitude_unit(alt: Column) -> Column:
    """As an aggregate: 'feet' or 'metre' by median, share above 15000, and share in 20000-45000."""
    high = F.avg(F.when(alt > 15000, 1.0).otherwise(0.0))
    band = F.avg(F.when((alt >= 20000) & (alt <= 45000), 1.0).otherwise(0.0))
    return F.when((F.median(alt) > 15000) | (high > 0.5) | (band > 0.20), "feet").otherwise("metre")


def altitude_metres(alt: Column, unit: Column) -> Column:
    """Source-wide units: feet are converted; above 20000 m is no altitude."""
    metres = F.when(unit == "feet", alt * 0.3048).otherwise(alt)
    return F.when(metres <= 20000, metres)


def altitude_metres_by_row(alt: Column) -> Column:
    """Row-wise units of position reports: only (15000, 45000] is feet."""
    return F.when((alt > 15000) & (alt <= 45000), alt * 0.3048).otherwise(alt)


def coordinate(text: Column, limit: float) -> Column:
    """Degrees from N28203089, E109399986 or decimal text; whole numbers are scaled by 1e6, else 1e4."""
    sign = F.when(F.upper(text).rlike("[SW]"), -1.0).otherwise(1.0)
    number = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    scaled = F.when(F.abs(number) <= limit, number).when(F.abs(number) / 1e6 <= limit, number / 1e6).when(F.abs(number) / 1e4 <= limit, number / 1e4)
    return sign * scaled


def any_time(text: Column, formats: list[str]) -> Column:
    """The first format that fits; a bare number is a day since 1899-12-30."""
    day = text.try_cast("double")
    serial = F.to_timestamp_ntz(F.lit("1899-12-30 00:00:00")) + F.make_dt_interval(secs=F.round(day * 86400).cast("decimal(18,6)"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats], F.when(day.between(1, 100000), serial))


def band(x: Column, bounds: list[float], names: list[str]) -> Column:
    """names[i] where x < bounds[i], the last name beyond; null stays null."""
    out = F.when(x < bounds[0], names[0])
    for b, n in zip(bounds[1:], names[1:-1], strict=True):
        out = out.when(x < b, n)
    return F.when(x.isNotNull(), out.otherwise(names[-1]))


ALTITUDE_BANDS = ([3000.0, 6000.0, 9000.0, 12000.0], ["0-3km", "3-6km", "6-9km", "9-12km", "12km+"])
SPEED_BANDS = ([5.0, 15.0, 30.0, 60.0], ["<5", "5-15", "15-30", "30-60", "60+"])
BATCH_BANDS = ([2.0, 5.0, 11.0, 26.0, 50.0], ["1", "2-4", "5-10", "11-25", "26-49", "50+"])


def reasons(rules: list[tuple[str, Column]], joint: str = ";") -> Column:
    """The names of the rules that hold, in order; empty if none does. A null rule does not hold."""
    return F.concat_ws(joint, *[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules])


def first_reason(rules: list[tuple[str, Column]], none: str = "kept") -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules], F.lit(none))
