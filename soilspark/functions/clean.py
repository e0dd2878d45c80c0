"""One place for missing values, keys and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL = -9999.0


def finite(c: Column) -> Column:
    """The value, null if it is not a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def missing_to_null(df: DataFrame, columns: list[str], at_most: float | None = SENTINEL, equal: tuple[float, ...] = ()) -> DataFrame:
    """NaN, infinities, values of at most ``at_most`` and the values ``equal`` become null."""

    def rule(name: str) -> Column:
        c = finite(F.col(name).cast("double"))
        if at_most is not None:
            c = F.when(c > at_most, c)
        return F.when(~c.isin(*equal), c) if equal else c

    return df.withColumns({c: rule(c) for c in columns})


def keep_valid_targets(df: DataFrame, targets: list[str]) -> DataFrame:
    """Rows whose every target is known."""
    cond = F.lit(True)
    for t in targets:
        cond = cond & F.col(t).isNotNull() & (F.col(t) > SENTINEL)
    return df.where(cond)


def enough_data(df: DataFrame, count: str, least: int) -> DataFrame:
    """Rows of at least ``least`` observations; an unknown number (-9999) does not count."""
    return df.where((F.col(count) >= least) & (F.col(count) != SENTINEL))


def join_key(c: Column) -> Column:
    """Lower case with ``-`` for ``_``."""
    return F.translate(F.lower(c.cast("string")), "_", "-")


def safe_name(c: Column) -> Column:
    """Without characters that file names can't hold."""
    return F.translate(c, ":/ \\", "____")


def first_present(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Renames the first column that is there of each list to its name."""
    found = {next(o for o in options if o in df.columns): new for new, options in aliases.items() if any(o in df.columns for o in options)}
    return df.withColumnsRenamed(found)


def keep_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select([c for c in columns if c in df.columns])


def percent_to_fraction(df: DataFrame, column: str, by: list[str], at: float = 0.9, above: float = 1.2) -> DataFrame:
    """A group whose ``at`` quantile is above ``above`` is in percent and is divided by 100."""
    q = df.groupBy(*by).agg(F.percentile(column, at).alias("__q"))
    return df.join(q, by).withColumn(column, F.when(F.col("__q") > above, F.col(column) / 100).otherwise(F.col(column))).drop("__q")


# fixed values: suction and length units in cm of water
TO_CM = {"kPa": 10.19716, "MPa": 10197.16, "bar": 1019.716, "m": 100.0, "cm": 1.0}


def to_cm(c: Column, unit: str) -> Column:
    """Suction as a non-negative number of cm."""
    return F.abs(c) * TO_CM[unit]


def volumetric(gravimetric_percent: Column, bulk_density: Column) -> Column:
    return gravimetric_percent / 100 * bulk_density


def et_from_latent_heat(le: Column, seconds: Column) -> Column:
    """Millimetres of evaporated water of a latent heat flux (W/m2) over ``seconds``."""
    return le * seconds / 2.45e6
