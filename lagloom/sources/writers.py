"""Sinks, and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(
    results: Mapping[str, DataFrame],
    path: str,
    partition_by: Sequence[str] = (),
    file_format: str = "parquet",
    mode: str = "overwrite",
) -> dict[str, str]:
    """Write each result below ``path``; returns the folder of each.

    Partition columns a result does not have are ignored for it.  Text formats
    get arrays, maps and structs as JSON.
    """
    folders = {}
    for name, df in results.items():
        folders[name] = f"{path}/{name}"
        parts = [c for c in partition_by if c in df.columns]
        if file_format == "csv":
            nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
            df = df.withColumns({c: F.to_json(c) for c in nested})
        writer = df.write.mode(mode).format(file_format).option("nullValue", "NA").option("header", True)
        if mode == "overwrite" and parts:
            writer = writer.option("partitionOverwriteMode", "static")
        (writer.partitionBy(*parts) if parts else writer).save(folders[name])
    return folders


def write_tasks(forecasts: DataFrame, path: str, origin: str = "origin_year", time: str = "t") -> None:
    """One folder per (origin, model) and a combined table beside them."""
    labelled = forecasts.withColumn(origin, F.col(time) - 1)
    # rows of a folder meet in few tasks, but a large folder is split over several
    labelled.hint("rebalance", origin, "model").write.mode("overwrite").partitionBy(origin, "model").parquet(f"{path}/by_task")
    labelled.write.mode("overwrite").parquet(f"{path}/combined")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it then uses a new
    temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="lagloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lagloom/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows read back from a table in the shared folder.

    Later stages restart from the files when an executor is lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
