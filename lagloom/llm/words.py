"""Words, shingles and rolling hashes of whole Arrow batches, vectorised over bytes.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``.  All
hashes are 64 bits wide and depend on the content alone, so any task computes
the same value for the same words.  NULL texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 19  # bytes hashed at a time; bounds the temporaries, not the texts
_MUL = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x = x * U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _tables(lower: bool, seed: int = 0) -> np.ndarray:
    table = mix((np.arange(1, 257, dtype=U64) + U64(256 * seed)) * _MUL)
    if lower:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more entry at the end)."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the number of the first word of each text."""
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[offsets[1:][offsets[:-1] < offsets[1:]] - 1] |= inside[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, seed: int = 0) -> np.ndarray:
    """``seed`` names one of many functions that agree on nothing but equal words."""
    table, out = _tables(lower, seed), np.empty(len(starts), U64)
    size = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + PIECE, side="right")))
        lens = (ends - starts)[at:to]
        total = int(size[to - 1] - done)
        heads = np.concatenate(([0], np.cumsum(lens)[:-1]))
        inner = np.arange(total) - np.repeat(heads, lens)
        powers = np.cumprod(np.full(int(lens.max()), _MUL, U64))
        value = table[buf[np.repeat(starts[at:to], lens) + inner]] * powers[inner]
        out[at:to] = np.add.reduceat(value, heads) + lens.astype(U64)
        at = to
    return mix(out)


class Words:
    """Word hashes of a batch; ``first[i]:first[i + 1]`` are the words of text ``i``."""

    def __init__(self, texts: pa.Array, lower: bool = True, hashed: bool = True):
        self.buf, self.offsets = text_buffer(texts)
        self.starts, self.ends, self.first = word_spans(self.buf, self.offsets)
        if hashed:
            self.hashes = word_hashes(self.buf, self.starts, self.ends, lower)
        self.counts = np.diff(self.first)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; the last ``k - 1`` entries of the batch are missing."""
        return grams(self.hashes, k)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every ``k``-word shingle, repeats included.

        A text with fewer words has its whole sequence as one, an empty one none.
        """
        n = self.counts
        per = np.where(n >= k, n - k + 1, 0)
        text = np.repeat(np.arange(len(n)), per)
        inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        full = self.grams(k)[self.first[:-1].repeat(per) + inner] if per.sum() else np.zeros(0, U64)
        short = np.flatnonzero((n > 0) & (n < k))
        if not len(short):
            return text, full
        whole = np.empty(len(short), U64)
        for size in range(1, k):
            own = n[short] == size
            if own.any():
                whole[own] = grams(self.hashes, size)[self.first[:-1][short[own]]] + U64(size)
        text, full = np.concatenate((text, short)), np.concatenate((full, mix(whole)))
        order = np.argsort(text, kind="stable")
        return text[order], full[order]

    def distinct_shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same without repeats within a text, by text, then hash."""
        text, value = self.shingles(k)
        return distinct(text, value, len(self.counts))


def distinct(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``value`` sorted and without repeats within each text; ``text`` ascends."""
    if not len(text):
        return text, value
    value, heads = value.copy(), np.searchsorted(text, np.arange(n + 1)).tolist()
    for a, b in zip(heads, heads[1:]):
        value[a:b].sort()
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[keep], value[keep]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``k`` consecutive hashes by doubling: log k passes instead of k."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    n, power, width, done, out = len(hashes) - k + 1, hashes, 1, 0, None
    rest = k
    while rest:
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else mix(out * _MUL + part)
            done += width
        rest >>= 1
        if rest:
            power = mix(power[: len(power) - width] * U64(0xD6E8FEB86659FD93) + power[width:])
            width *= 2
    return out


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    n, have, out = len(values) - width + 1, 1, values
    while have * 2 <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    return pick(out[:n], out[width - have : width - have + n])
