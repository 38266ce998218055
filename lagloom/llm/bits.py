"""A Bloom filter of fixed size over hashes that lie in a table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.arrow import mapped
from lagloom.llm.words import U64, mix

BITS, PROBES = 1 << 24, 4


def probes(hashes: np.ndarray, bits: int = BITS, k: int = PROBES) -> list[np.ndarray]:
    """The bit positions of each hash, one array per probe."""
    return [(mix(hashes + U64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U64(bits)).astype(np.int64) for j in range(1, k + 1)]


def held(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash; a hash that was put in always passes."""
    out = np.ones(len(hashes), bool)
    for at in probes(hashes, len(filled) * 64):
        out &= (filled[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
    return out


def bloom(rows: DataFrame, hashes: Callable, bits: int = BITS) -> np.ndarray:
    """The filter over ``hashes(batch)`` of all rows, as 64-bit words.

    Each task sends its filled words, each at most once per batch; the driver
    gets ``bits / 64`` pairs of numbers at most, however many rows there are.
    """

    def work(batch):
        at = np.concatenate(probes(hashes(batch), bits))
        order = np.argsort(at, kind="stable")
        at = at[order]
        word, heads = np.unique(at >> 6, return_index=True)
        if not len(at):
            return None
        filled = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), heads)
        return {"at": word, "filled": filled.view(np.int64)}

    parts = mapped(rows, "at long, filled long", work).groupBy("at").agg(F.bit_or("filled").alias("filled"))
    found = parts.toArrow()
    out = np.zeros(bits // 64, U64)
    out[found.column("at").to_numpy()] = found.column("filled").to_numpy().view(U64)
    return out
