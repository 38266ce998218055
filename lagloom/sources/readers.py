"""Readers for annual series, landed index feeds and earlier results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def series_schema(covariates: Sequence[str], series_id: bool = False) -> T.StructType:
    head = [T.StructField("series_id", T.StringType())] if series_id else []
    return T.StructType(
        head
        + [
            T.StructField("year", T.IntegerType()),
            T.StructField("species", T.StringType()),
            T.StructField("period", T.IntegerType()),
            T.StructField("abundance", T.DoubleType()),
        ]
        + [T.StructField(c, T.DoubleType()) for c in covariates]
    )


def read_series(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "csv") -> DataFrame:
    """An annual series; in text files ``NA`` is missing."""
    reader = spark.read.schema(schema)
    if file_format == "csv":
        return reader.csv(path, header=True, nullValue="NA")
    return reader.format(file_format).load(path)


def read_index(
    spark: SparkSession,
    path: str,
    columns: Sequence[tuple[str, str]],
    sep: str | None = None,
    data_pattern: str = r"^\s*[0-9]",
    comment: str = "#",
) -> DataFrame:
    """A feed without header: ``columns`` are (name, type) by position.

    Leading prose and comments are recognised by content, a data line matches
    ``data_pattern``, so the result does not depend on which task reads which
    part of the file.  ``sep=None`` splits on white space.  A field that does
    not parse is NULL.
    """
    line = F.trim("value")
    lines = spark.read.text(path).filter(F.col("value").rlike(data_pattern))
    if comment:
        line = F.trim(F.substring_index(line, comment, 1))
    parts = F.split(line, r"\s+" if sep is None else sep)
    fields = [
        F.trim(F.get(F.col("_parts"), F.lit(i))).try_cast(kind).alias(name)
        for i, (name, kind) in enumerate(columns)
    ]
    return lines.select(parts.alias("_parts")).select(*fields)


def read_table(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """A headed table with typed columns; text that does not parse is NULL."""
    raw = spark.read.csv(path, header=True, nullValue="NA")
    return raw.select(*[F.col(f"`{name}`").try_cast(kind).alias(name) for name, kind in columns])


def read_brood(
    spark: SparkSession, path: str, ages: Sequence[str], stock: str = "Stock", cohort: str = "BroodYear"
) -> DataFrame:
    """Counts by cohort and age, as ``int``; where one passes it, those of all ages are ``bigint``."""
    wide = read_table(spark, path, [(stock, "string"), (cohort, "int"), *[(a, "bigint") for a in ages]])
    past = F.lit(False)
    for a in ages:
        past = past | (F.col(f"`{a}`").isNotNull() & F.col(f"`{a}`").try_cast("int").isNull())
    if not wide.filter(past).isEmpty():
        return wide
    return wide.withColumns({a: F.col(f"`{a}`").cast("int") for a in ages})


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecasts written earlier, to be used instead of fitting."""
    return spark.read.parquet(path)
