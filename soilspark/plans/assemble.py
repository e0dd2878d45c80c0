"""Assembly of feature tables and of the unified training table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soilspark.functions import clean, vg
from soilspark.operators import aggregates, joins, reshape

MAX_CODES = 100_000  # some megabytes
# fixed values: the columns that lead the training table
FIRST_COLUMNS = ["sample_id", "source", "rosetta_level", "depth_cm", "data_ct", "theta_r", "theta_s", "alpha", "n"]


@dataclass(frozen=True)
class Source:
    """A source of labels: its name, its id column, whether curves must be fitted first, and the format of its parameters (plain or log10)."""

    name: str
    key: str
    fitted: bool = True
    form: str = "plain"
    dropped: tuple[str, ...] = field(default_factory=tuple)


# fixed values: the networks that labels come from
SOURCES = {
    s.name: s
    for s in (
        Source("ncss", "profile_id"), Source("gshp", "profile_id", fitted=False), Source("mt_mesonet", "station"), Source("reesh", "site_id"), Source("rosetta", "site_id", fitted=False, form="log10"),
    )
}


def source(name: str) -> Source:
    if name not in SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


def requiring_fits() -> list[Source]:
    return [s for s in SOURCES.values() if s.fitted]


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): whole numbers from 1 in the order of the values; more than ``MAX_CODES`` of them are an error, as such a column is no category."""
    few = df.select(column).where(F.col(column).isNotNull()).distinct()
    if few.limit(MAX_CODES + 1).count() > MAX_CODES:
        raise ValueError(f"{column} has more than {MAX_CODES} values")
    return few.withColumn("code", F.dense_rank().over(Window.orderBy(column)))


def encoded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Categorical columns replaced by their codes; null stays null."""
    for c in columns:
        df = df.join(F.broadcast(category_codes(df, c)), c, "left").drop(c).withColumnRenamed("code", c)
    return df


def feature_table(frames: list[DataFrame], key: str, dropped: list[str], categorical: list[str], order: str | None = None) -> DataFrame:
    """Per-tile extracts as one table of a row for each key: the first known value of each column, categories as codes, columns in order."""
    every = reshape.union_filled([f for f in frames if "uid" not in f.columns]).drop(*dropped)
    every = every.withColumn(key, F.col(key).cast("string"))
    values = sorted(c for c in every.columns if c not in (key, order))
    one = aggregates.first_known(every, [key], values, order or key).drop("n")
    return encoded(one, [c for c in categorical if c in values]).select(key, *values)


def labels(fits: DataFrame, src: Source) -> DataFrame:
    """Label rows of a source in the common form: sample_id, source, depth_cm, data_ct and plain parameters."""
    if src.form == "log10":
        fits = vg.from_log10(fits)
    key = F.translate(F.col(src.key).cast("string"), "/\\", "__")
    depth = F.col("depth_cm").cast("string") if "depth_cm" in fits.columns else F.lit(None).cast("string")
    out = fits.withColumn("source", F.lit(src.name)).withColumn("join_id", clean.join_key(key)).withColumn("sample_id", F.concat_ws("_", F.lit(src.name), key, depth))
    if "data_ct" not in out.columns:
        out = out.withColumn("data_ct", F.lit(int(clean.SENTINEL)))
    return clean.missing_to_null(out, [p for p in vg.PARAMS if p in out.columns]).drop(*src.dropped)


def unified(parts: list[tuple[Source, DataFrame]], features: DataFrame, key: str, order: list, least: int | None = None) -> DataFrame:
    """The training table: labels of every source, null where a source lacks a column, rows without all four parameters left out, with the features of their key."""
    every = reshape.union_filled([labels(df, s) for s, df in parts]).na.drop("any", subset=list(vg.PARAMS))
    if least is not None:
        every = every.where((F.col("data_ct") >= least) | (F.col("data_ct") == clean.SENTINEL))
    right = features.withColumn("join_id", clean.join_key(F.col(key))).drop(key)
    out = joins.left_first(every, right, ["join_id"], order).drop("join_id")
    first = [c for c in FIRST_COLUMNS if c in out.columns]
    return out.select(*first, *sorted(c for c in out.columns if c not in first))


# --- feature selection -----------------------------------------------------------------------------------------------------------------


def feature_names(columns: list[str], targets: list[str], ids: list[str], depth: str = "both", excluded: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> list[str]:
    """All columns but targets, ids and the excluded families. ``depth``: none, feature (the level), continuous (centimetres) or both."""
    held = {"none": (), "feature": ("rosetta_level",), "continuous": ("depth_cm",), "both": ("rosetta_level", "depth_cm")}[depth]
    out = []
    for c in columns:
        if c in targets or c in ids or c in excluded or any(c == p or c.startswith(p + "_") for p in prefixes):
            continue
        if c in ("rosetta_level", "depth_cm") and c not in held:
            continue
        out.append(c)
    return out


def missing_features(wanted: list[str], df: DataFrame) -> list[str]:
    """Names that a model needs and the table lacks."""
    return sorted(set(wanted) - set(df.columns))
