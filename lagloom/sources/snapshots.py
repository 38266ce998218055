"""Published versions of a partitioned table: new partitions beside the old, one file to switch.

Below a path lie data folders, one per publish and never rewritten, and a manifest table to which
each publish adds one file: all partitions of the new version and the data
folder of each.  The file appears by the rename that ends its task, so readers see the old version
or the new one, never a mixture, and a publish that fails before changes
nothing.  Old versions stay readable.  There is one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, part string, folder string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, part, folder) of every published version; empty before the first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def latest(spark: SparkSession, path: str) -> int:
    return manifest(spark, path).agg(F.max("version")).first()[0] or 0


def publish(new: DataFrame, path: str, by: str = "t") -> int:
    """The next version: ``new`` in place of the partitions it has rows of, the others as they are; returns its number.

    ``by`` has no NULL and few values, such as times.  Only ``new`` is read and written.
    """
    spark = new.sparkSession
    version = latest(spark, path) + 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    new.withColumn("_part", F.col(by).cast("string")).write.partitionBy("_part").parquet(f"{path}/data/{folder}")
    written = spark.read.schema("_part string").parquet(f"{path}/data/{folder}").select(F.col("_part").alias("part")).distinct()
    written = written.withColumn("folder", F.lit(folder))
    old = manifest(spark, path).filter(F.col("version") == version - 1).select("part", "folder")
    every = old.join(written, "part", "left_anti").union(written)
    every.select(F.lit(version).cast("long").alias("version"), "part", "folder").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default."""
    version = latest(spark, path) if version is None else version
    parts = manifest(spark, path).filter(F.col("version") == version)
    # as many rows as publishes that still have a part in this version
    folders = parts.groupBy("folder").agg(F.sort_array(F.collect_list("part")).alias("parts")).orderBy("folder").collect()
    if not folders:
        raise ValueError(f"no version {version} at {path}")
    out = None
    for row in folders:
        root = f"{path}/data/{row.folder}"
        own = spark.read.option("basePath", root).parquet(*[f"{root}/_part={p}" for p in row.parts]).drop("_part")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
