"""Networks' observations in one form: profile_id, depth_cm, suction_cm, theta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.functions import clean
from soilspark.operators import aggregates, joins, reshape


def network(raw: DataFrame, key: str, depth: str | None, suction: str, unit: str, water: str, percent: bool = False, least: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Suction in cm, water as a fraction, depth 0 where there is none; rows without either measure go, and (profile, depth) with fewer than ``least`` rows."""
    theta = F.col(water).cast("double") / (100 if percent else 1)
    out = raw.select(
        F.translate(F.col(key).cast("string"), "/\\", "__").alias("profile_id"), (F.col(depth).cast("double") if depth else F.lit(0.0)).alias("depth_cm"),
        clean.finite(clean.to_cm(F.col(suction).cast("double"), unit)).alias("suction_cm"), clean.finite(theta).alias("theta"), *[c for c in keep if c in raw.columns],
    )
    out = out.na.drop("any", subset=["suction_cm", "theta"])
    return joins.at_least(out, ["profile_id", "depth_cm"], least) if least else out


def quality_only(raw: DataFrame, flag: str, good: str = "good quality estimate") -> DataFrame:
    return raw.where(F.col(flag) == good)


def paired_curves(raw: DataFrame, ids: list[str]) -> DataFrame:
    """Columns h1, t1, h2, t2 ... as rows of suction and water content."""
    pairs = [(f"h{c[1:]}", f"t{c[1:]}") for c in raw.columns if c[0] == "h" and c[1:].isdigit() and f"t{c[1:]}" in raw.columns]
    out = reshape.paired_columns(raw, ids, pairs, ("suction_cm", "theta"))
    return out.withColumn("suction_cm", F.abs("suction_cm"))


def gravimetric_long(wide: DataFrame, ids: list[str], suctions: dict[str, float], density: str) -> DataFrame:
    """Water retained (percent by mass) at fixed suctions, one column each, as rows of volumetric content with the profile's coverage class."""
    held = [c for c in suctions if c in wide.columns]
    long = reshape.melt(wide.select(*ids, density, *[F.col(c).cast("double") for c in held]), [*ids, density], held, "variable", "value", keep_null=False)
    cm = F.element_at(F.create_map(*[F.lit(x) for c in held for x in (c, suctions[c])]), F.col("variable"))
    rows = long.select(*ids, cm.alias("suction_cm"), clean.volumetric(F.col("value"), F.col(density)).alias("theta"))
    ends = rows.groupBy(*ids).agg(F.min("suction_cm").alias("lo"), F.max("suction_cm").alias("hi"))
    return rows.join(ends, ids).withColumn("class", aggregates.coverage_class(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def one_site(raw: DataFrame, site: str) -> DataFrame:
    """The rows, after the check that they are of one site."""
    names = [r[0] for r in raw.select(site).distinct().limit(2).collect()]
    if len(names) > 1:
        raise ValueError(f"rows of more than one site: {', '.join(map(str, names))}")
    return raw
