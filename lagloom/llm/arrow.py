"""Arrow batches in and out of tasks, in slices bounded by bytes rather than rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lagloom.sources.session import ship

SLICE_BYTES = 1 << 20  # text bytes worked on at a time; one longer text makes a slice of its own


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        size = batch.column(column).cast(pa.large_binary())
        ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(size).to_numpy(zero_copy_only=False)))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def map_slices(df: DataFrame, schema: str, column: str, make: Callable[[], Callable], limit: int = SLICE_BYTES):
    """``make()`` once per task, then its result on every slice; it returns ``{name: values}`` or None."""
    names = [part.split()[0] for part in schema.split(", ")]
    ship(df.sparkSession)

    def run(batches):
        work = make()
        for batch in slices(batches, column, limit):
            out = work(batch)
            if out is not None:
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def filter_slices(df: DataFrame, column: str, make: Callable[[], Callable], limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``df``, all columns, for which ``make()``'s result on a slice is true."""

    ship(df.sparkSession)

    def run(batches):
        work = make()
        for batch in slices(batches, column, limit):
            yield batch.filter(pa.array(work(batch)))

    return df.mapInArrow(run, df.schema)


def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``values[starts[i]:starts[i + 1]]`` as a list column."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))


def mapped(df: DataFrame, schema: str, work: Callable) -> DataFrame:
    """``work`` on every Arrow batch of rows of bounded width; it returns ``{name: values}`` or None."""
    names = [part.split()[0] for part in schema.split(", ")]
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            out = work(batch) if batch.num_rows else None
            if out is not None:
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)
