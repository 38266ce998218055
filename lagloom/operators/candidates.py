"""Candidate models: numbered covariate subsets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.functions.safe import spread


@dataclass(frozen=True)
class Candidates:
    """Subsets of ``min_vars..max_vars`` covariates, numbered by size then position.

    The empty subset appears only with ``include_null`` or when it is all that
    is asked for; it takes the last number, so the numbers of the others do not
    depend on it.

    Subsets are generated inside each row by extending positions step by step,
    and the number of a subset is computed from its own positions, so pairing
    rows with candidates needs neither a join nor a broadcast nor a sort.
    """

    covariates: tuple[str, ...]
    min_vars: int = 0
    max_vars: int = 1
    include_null: bool = False

    def __post_init__(self):
        object.__setattr__(self, "covariates", tuple(self.covariates))
        if not 0 <= self.min_vars <= self.max_vars:
            raise ValueError("need 0 <= min_vars <= max_vars")
        if not self.count:
            raise ValueError("no candidate of the wanted size")

    @property
    def sizes(self) -> range:
        return range(max(self.min_vars, 1), min(self.max_vars, len(self.covariates)) + 1)

    @property
    def with_null(self) -> bool:
        return (self.include_null and self.min_vars == 0) or self.max_vars == 0

    @property
    def count(self) -> int:
        return sum(comb(len(self.covariates), s) for s in self.sizes) + self.with_null

    def pair(self, df: DataFrame, spread_by: Sequence[str] | None = None) -> DataFrame:
        """Every row with every candidate: adds ``model``, ``positions``, ``covariates``.

        ``spread_by`` deals the rows out by those columns and the first
        position before the subsets grow further, so that the candidates of
        one row are worked on by many tasks.
        """
        n = len(self.covariates)
        out = df.withColumn("positions", F.array().cast("array<int>")).withColumn("_open", F.lit(True))
        for step in range(self.sizes[-1] if self.sizes else 0):
            first = F.coalesce(F.try_element_at("positions", F.lit(-1)) + 1, F.lit(0))
            later = F.when(
                F.col("_open") & (first < n), F.sequence(first, F.lit(n - 1))
            ).otherwise(F.array().cast("array<int>"))
            out = (
                out.withColumn("_next", F.explode(F.concat(F.array(F.lit(-1)), later)))
                .withColumn("_open", F.col("_next") >= 0)
                .withColumn(
                    "positions",
                    F.when(F.col("_open"), F.concat("positions", F.array("_next"))).otherwise(
                        F.col("positions")
                    ),
                )
            )
            if spread_by and step == 0:
                out = spread(out, *spread_by, "_next")
        size = F.size("positions")
        lowest = 0 if self.with_null else self.sizes[0]
        wanted = (size >= lowest) & ((size == 0) | (size >= (self.sizes[0] if self.sizes else 0)))
        names = F.array(*[F.lit(c) for c in self.covariates]) if n else F.array().cast("array<string>")
        return (
            out.filter(wanted)
            .withColumn("model", self._number().cast("int"))
            .withColumn("covariates", F.transform("positions", lambda p: F.get(names, p)))
            .drop("_open", "_next")
        )

    def _number(self) -> Column:
        """1-based number: smaller sizes first, then lexicographic by position."""
        n = len(self.covariates)
        number = F.lit(self.count)
        for size in self.sizes:
            smaller = sum(comb(n, s) for s in self.sizes if s < size)
            after = [
                F.get(
                    F.array(*[F.lit(comb(n - 1 - p, size - i)) for p in range(n)]),
                    F.get("positions", F.lit(i)),
                )
                for i in range(size)
            ]
            rank = F.lit(smaller + comb(n, size)) - reduce(Column.__add__, after)
            number = F.when(F.size("positions") == size, rank).otherwise(number)
        return number

    def table(self, spark: SparkSession) -> DataFrame:
        """The candidates as rows: model, covariates, model_name, formula."""
        one = spark.range(0, 1, 1, 1).drop("id")
        return with_labels(self.pair(one)).select("model", "covariates", "model_name", "formula")


def with_labels(df: DataFrame) -> DataFrame:
    """Readable name and formula of a candidate from its ``covariates``."""
    text = F.array_join("covariates", " + ")
    return df.withColumn(
        "model_name", F.when(F.size("covariates") > 0, text).otherwise(F.lit("1"))
    ).withColumn("formula", F.concat(F.lit("abundance ~ "), "model_name"))


def model_list(models: DataFrame) -> DataFrame:
    return models.select("model", "model_name")


def covariate_subsets(
    spark: SparkSession, covariates: Sequence[str], min_vars: int = 0, max_vars: int = 1, include_null: bool = False
) -> DataFrame:
    return Candidates(tuple(covariates), min_vars, max_vars, include_null).table(spark)
