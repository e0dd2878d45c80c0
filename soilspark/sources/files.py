"""Readers of observation, fit and feature files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soilspark.functions import clean
from soilspark.operators import joins, reshape
from soilspark.sources.scratch import kept

FIT_DOCUMENT = (
    "map<string, struct<status: string, n_obs: int, chi_squared: double, reduced_chi_squared: double, aic: double, bic: double, "
    "parameters: map<string, struct<value: double, stderr: double, q025: double, q975: double>>, data: struct<suction_cm: array<double>, theta: array<double>>>>"
)
GRAM = 4  # characters of the pieces by which ids are looked for in names
METADATA = "struct<metadata: map<string, map<string, string>>>"


def csv(spark: SparkSession, path: str | list[str], schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Files with a header line. With a schema nothing is read twice."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("nanValue", "NaN")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV or Parquet file by its ending; anything else is an error."""
    ending = path.rpartition(".")[2].lower()
    if ending in ("parquet", "pq"):
        return spark.read.parquet(path)
    if ending == "csv":
        return csv(spark, path, schema)
    raise ValueError(f"neither CSV nor Parquet: {path}")


def tree(spark: SparkSession, folder: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """All files of a kind below a folder, at any depth."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}")
    if kind == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).format("csv" if kind == "csv" else "parquet").load(folder)


def concatenated(spark: SparkSession, paths: list[str], schema: str | None = None, key: str = "uid") -> DataFrame:
    """CSV files whose columns differ, as one table; files without rows and files with a ``key`` column are passed over, never removed."""
    frames = [csv(spark, p, schema) for p in sorted(paths)]
    kept = [f for f in frames if key not in f.columns and not f.isEmpty()]
    if not kept:
        raise ValueError("no file with rows")
    return reshape.union_filled(kept)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def decoded(name: Column) -> Column:
    """A file's name as it was given; Spark tells it as part of a URI."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def keyed_by_name(df: DataFrame, key: str, first: bool = False, order: str | None = None) -> DataFrame:
    """The file's name without ending as a column; ``first`` keeps one row of each file."""
    out = df.select("*", file_stem(decoded(F.col("_metadata.file_name"))).alias(key))
    return joins.first_row(out, [key], [order]) if first else out


def fit_documents(spark: SparkSession, path: str, key: str = "profile_id") -> DataFrame:
    """One row for each depth of each JSON fit document whose fit succeeded: id, depth_cm, parameters with errors, statistics and data_ct.

    The id is the metadata's ``key``, else its station, else its profile_id, else the file's name. Keys that are not numbers are passed over;
    without observations data_ct is -9999; infinite values are null.
    """
    text = spark.read.option("wholetext", True).text(path).select("value", file_stem(decoded(F.col("_metadata.file_name"))).alias("__name"))
    fit = text.select("__name", F.from_json("value", METADATA)["metadata"].alias("__m"), F.explode(F.map_entries(F.from_json("value", FIT_DOCUMENT))).alias("e"))
    fit = fit.withColumn("depth_cm", F.expr("try_cast(e.key AS double)")).where("depth_cm is not null and e.value.status = 'Success'")
    meta = F.try_element_at(F.col("__m"), F.col("e.key"))
    known = F.coalesce(*[F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in dict.fromkeys((key, "station", "profile_id"))], F.col("__name"))
    value = F.col("e.value")
    of = lambda p, x: clean.finite(F.try_element_at(value["parameters"], F.lit(p))[x])
    cols = [of(p, x).alias(p if x == "value" else f"{p}_{x}") for p in ("theta_r", "theta_s", "alpha", "n") for x in ("value", "stderr", "q025", "q975")]
    count = F.when(value["data"]["theta"].isNotNull(), F.size(value["data"]["theta"])).otherwise(int(clean.SENTINEL))
    return fit.select(known.alias(key), "depth_cm", *cols, *[value[c].alias(c) for c in ("n_obs", "chi_squared", "reduced_chi_squared", "aic", "bic")], count.alias("data_ct"))


def half_hourly(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Tower files with comment lines before the header, all of the same columns: site, ts and the columns as numbers; 0, -99.99 and -9999 are missing. Without ``site`` it is told by each file's name."""
    own = F.lit(site) if site is not None else tower_site(file_stem(decoded(F.col("_metadata.file_name"))))
    lines = spark.read.text(path).select("value", own.alias("site_id")).where(~F.col("value").startswith("#"))
    header = lines.where(F.col("value").startswith("TIMESTAMP")).first()
    if header is None:
        raise ValueError(f"no header in {path}")
    names = header["value"].split(",")
    parts = lines.where(~F.col("value").startswith("TIMESTAMP")).select("site_id", F.split("value", ",").alias("p"))
    rows = parts.select("site_id", *[F.expr(f"try_cast(p[{k}] AS double)").alias(c) if not c.startswith("TIMESTAMP") else F.get("p", F.lit(k)).alias(c) for k, c in enumerate(names)])
    numbers = [c for c in names if not c.startswith("TIMESTAMP")]
    out = clean.missing_to_null(rows, numbers, at_most=clean.SENTINEL, equal=(0.0, -99.99))
    return out.select("site_id", F.try_to_timestamp(F.col("TIMESTAMP_START"), F.lit("yyyyMMddHHmm")).alias("ts"), *numbers)


def family(df: DataFrame, prefix: str) -> list[str]:
    """The columns of one measured quantity: its name alone or followed by ``_``."""
    return [c for c in df.columns if c == prefix or c.startswith(prefix + "_")]


def candidates(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, modified, length) of the files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", file_stem(F.col("path")).alias("name"), F.col("modificationTime").alias("modified"), "length")


def for_ids(ids: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Each id with the file that is named as it, else the first that begins with it and ``_``, else the first that holds it, else null.

    The first two are joins on the beginnings of names. Ids that these leave are looked for within names by an index: a string that holds an id holds the
    id's pieces of ``GRAM`` characters, so the id meets only the names that hold its rarest one. Null ids are passed over; an empty id is in every name.
    """
    parts = F.split("name", "_")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    named = files.select("path", "name", F.explode(begins).alias(key))
    first = F.min_by("path", F.struct(F.col("name") != F.col(key), "name", "path")).alias("path")
    found = kept(ids.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct().join(named, key, "left").groupBy(key).agg(first), "named")
    rest = found.where("path is null").select(key)
    return found.where("path is not null").unionByName(_within(rest, files, key))


def grams(text: Column, size: Column | int) -> Column:
    """All different pieces of ``size`` characters."""
    last = F.char_length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substr(text, k, F.lit(size) if isinstance(size, int) else size)))).otherwise(F.array())


def _within(ids: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Each id with the first file whose name holds it, else null."""
    size = F.least(F.char_length(key), F.lit(GRAM))
    of_ids = ids.where(F.char_length(key) > 0).select(key, F.explode(grams(F.col(key), size)).alias("gram"))
    wanted = kept(of_ids, "grams-of-ids")
    held = files.select("path", "name", F.explode(F.flatten(F.array(*[grams(F.col("name"), k) for k in range(1, GRAM + 1)]))).alias("gram"))
    held = held.join(wanted.select("gram").distinct(), "gram", "left_semi")  # of the few kinds that ids have
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy(key).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = held.join(rarest, "gram").where(F.col("name").contains(F.col(key))).groupBy(key).agg(F.min_by("path", F.struct("name", "path")).alias("path"))
    least = files.agg(F.min_by("path", F.struct("name", "path")).alias("least"))
    return ids.join(met, key, "left").join(F.broadcast(least)).select(key, F.when(F.char_length(key) == 0, F.col("least")).otherwise(F.col("path")).alias("path"))


def tower_site(name: Column) -> Column:
    """The site of a tower file's name: lower case, ``-`` for ``_``; empty if it is none."""
    return F.translate(F.lower(F.regexp_extract(name, r"AMF_([A-Za-z]{2}[-_][A-Za-z0-9]+)_BASE", 1)), "_", "-")


def best_checkpoint(files: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """The file of the best ``<metric>=<number>`` in its name, else the newest."""
    score = F.expr(f"try_cast(regexp_extract(name, '{metric}=(-?[0-9]+(?:[.][0-9]+)?)', 1) AS double)")
    scored = files.withColumn("score", score)
    order = [F.col("score").desc_nulls_last() if largest else F.col("score").asc_nulls_last(), F.desc("modified"), F.desc("name")]
    return scored.orderBy(*order).limit(1)


def many(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
