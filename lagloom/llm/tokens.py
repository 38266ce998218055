"""Token ids as binary shards with Elias-Fano coded document boundaries.

A shard holds the concatenated ids of a range of documents in ascending
``doc_id`` order, two bytes an id where the vocabulary allows, followed by a
footer: the ends of the documents and their ids as two Elias-Fano sequences
with select samples.  An offset is found by ``select`` without a table of
64-bit numbers.  Rows without ``doc_id`` come first, in one shard each range
gives them; NULL text counts as empty and yields the end id alone; repeated
ids stay repeated rows, in any order.  A very long text is a slice of its own; an empty table
has no shards and no rows.  Further columns are ignored.  Any tokenizer file works.

Shards are written by tasks, under names that no other attempt uses; only the
manifest, a table, says which of them count.  A task that is repeated after a
lost executor leaves an unused file behind and nothing else.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.arrow import slices
from lagloom.llm.files import new_file, opened
from lagloom.llm.words import Words, word_hashes
from lagloom.sources.session import ship
from lagloom.sources.writers import cut_lineage, scratch_path

MAGIC = b"EFTOKEN1"
SAMPLE = 256  # every so many-th one of the upper bits has its position stored
CACHED = 1 << 20  # pieces a worker remembers: about 30 MB


class EliasFano:
    """A non-decreasing sequence below ``bound``: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, bound: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        low_bits = max(0, int(bound // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) if n else 0) + 1, np.uint8)
        bits[ones] = 1
        rest = values & np.uint64((1 << low_bits) - 1)
        low = np.packbits((rest[:, None] >> np.arange(low_bits, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        from_bit, to_bit = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[from_bit // 8 : -(-to_bit // 8)], bitorder="little")
        bits = bits[from_bit % 8 : from_bit % 8 + to_bit - from_bit].reshape(-1, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The ``i``-th value: from the sample before it on, a few bytes of upper bits are read."""
        start = int(self.samples[i // SAMPLE])
        need, at = i % SAMPLE, start // 8
        first = np.unpackbits(self.high[at : at + 1], bitorder="little")
        first[: start % 8] = 0
        while True:
            ones = np.flatnonzero(first)
            if need < len(ones):
                place = at * 8 + int(ones[need])
                return (place - i << self.low_bits) + int(self._low(i, i + 1)[0])
            need, at = need - len(ones), at + 1
            first = np.unpackbits(self.high[at : at + 1], bitorder="little")

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        return (high | self._low(0, self.n)).astype(np.int64)

    def to_bytes(self) -> tuple[dict, bytes]:
        head = {"n": self.n, "low_bits": self.low_bits, "low": self.low.nbytes, "high": self.high.nbytes, "samples": len(self.samples)}
        return head, self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, head: dict, data: bytes) -> EliasFano:
        a, b = head["low"], head["low"] + head["high"]
        raw = np.frombuffer(data, np.uint8)
        return cls(head["n"], head["low_bits"], raw[:a], raw[a:b], np.frombuffer(data, "<u8", head["samples"], b))


def _byte_kinds() -> np.ndarray:
    """1 letter, 2 digit, 3 punctuation, 4 first byte of À to ÿ, 9 what only the tokenizer can judge."""
    kinds = np.full(256, 9, np.uint8)
    kinds[33:127] = 3
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[ord("A") : ord("Z") + 1] = kinds[ord("a") : ord("z") + 1] = 1
    kinds[0xC3] = 4
    kinds[ord("'")] = 9
    return kinds


#: A tokenizer with this pattern, lower-casing, never joins across white space, and within a word of
#: ASCII and À-ÿ letters it splits runs of letters, single digits and runs of other signs (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_into_pieces(settings: dict) -> bool:
    """Whether a tokenizer file's rules are those that ``Encoder`` builds pieces by."""
    steps = (settings.get("normalizer") or {}).get("normalizers", [])
    lower = [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": "\\s+"}
    parts = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = bool(parts) and parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": PIECES}
    whole = [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0].get("invert") is True and not parts[1].get("use_regex")
    return lower and split and whole and not parts[1].get("add_prefix_space")


class Encoder:
    """Ids of whole batches; every distinct piece of text meets the tokenizer once per worker.

    Words with anything but ASCII and À-ÿ (apostrophes, other scripts, special
    tokens) are pieces as a whole.  A tokenizer file with other rules than those
    of ``splits_into_pieces`` gets whole texts.
    """

    KINDS = _byte_kinds()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.between = self._ids(["0"])[0]
        self.in_pieces = splits_into_pieces(json.loads(self.tokenizer.to_str()))
        self._reset()

    def _reset(self):
        self.parts = []  # (sorted hashes, first id, number of ids), ids in pool
        self.pool, self.filled = np.zeros(1 << 16, self.dtype), 0

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _spans(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and plainness (letters only) of every piece."""
        buf = w.buf
        kinds = self.KINDS[buf]
        lead = np.flatnonzero(kinds == 4)
        if len(lead):
            after = buf[lead + 1]
            kinds[lead] = kinds[lead + 1] = np.where((after == 0x97) | (after == 0xB7), 9, 1)
        opened_special = np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|"))) if len(buf) > 1 else []
        kinds[opened_special] = 9
        odd = np.concatenate((np.zeros(1, np.int32), np.cumsum(kinds == 9, dtype=np.int32)))
        whole = np.flatnonzero(odd[w.ends] > odd[w.starts])
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[w.starts] += 1
        inside[w.ends[w.ends < len(buf)]] -= 1
        first = np.zeros(len(buf), bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        for i in whole:
            first[w.starts[i] : w.ends[i]] = False
        first[w.starts] = True
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        first &= ~space
        starts = np.flatnonzero(first)
        word = np.searchsorted(w.starts, starts, side="right") - 1
        ends = np.minimum(np.append(starts[1:], len(buf)), w.ends[word]) if len(starts) else starts
        plain = kinds[starts] == 1
        plain &= ~np.isin(word, whole)
        return starts, ends, plain

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, size, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for have, begin, count in self.parts:
            i = np.searchsorted(have, keys)
            i[i == len(have)] = 0
            hit = have[i] == keys
            at[hit], size[hit] = begin[i[hit]], count[i[hit]]
            known |= hit
        return at, size, known

    def _learn(self, buf, starts, ends, keys, plain):
        if sum(len(p[0]) for p in self.parts) + len(keys) > CACHED:
            self._reset()
        sizes, flat = np.zeros(len(keys), np.int64), [None] * len(keys)
        text = [bytes(buf[a:b]).decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]
        rows = np.flatnonzero(plain)
        groups = [rows[i : i + 1000] for i in range(0, len(rows), 1000)]
        joined = self._ids([" 0 ".join([text[i] for i in g]) for g in groups]) if len(self.between) == 1 else []
        for g, ids in zip(groups, joined):
            ids = np.array(ids)
            cut = np.flatnonzero(ids == self.between[0])
            for i, part in zip(g, np.split(ids, cut)):
                flat[i] = part[1:] if i != g[0] else part
        rest = [i for i in range(len(keys)) if flat[i] is None]
        for i, ids in zip(rest, self._ids([text[i] for i in rest])):
            flat[i] = ids
        sizes[:] = [len(x) for x in flat]
        total = int(sizes.sum())
        if self.filled + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(total, len(self.pool)), self.dtype)))
        if total:
            self.pool[self.filled : self.filled + total] = np.concatenate([np.asarray(x, np.int64) for x in flat])
        begin = self.filled + np.cumsum(sizes) - sizes
        self.filled += total
        self.parts.append((keys, begin, sizes))
        while len(self.parts) > 1 and len(self.parts[-1][0]) * 2 > len(self.parts[-2][0]):
            b, a = self.parts.pop(), self.parts.pop()
            merged = [np.concatenate(x) for x in zip(a, b)]
            order = np.argsort(merged[0], kind="stable")
            self.parts.append(tuple(x[order] for x in merged))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` after each, and the number of ids of each text."""
        if not self.in_pieces:
            found = [np.array([*ids, end], self.dtype) for ids in self._ids([t or "" for t in texts.to_pylist()])]
            return np.concatenate(found) if found else np.zeros(0, self.dtype), np.array([len(f) for f in found], np.int64)
        w = Words(texts, hashed=False)
        starts, ends, plain = self._spans(w)
        keys, first, back = np.unique(word_hashes(w.buf, starts, ends, True), return_index=True, return_inverse=True)
        at, size, known = self._find(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(w.buf, starts[first[new]], ends[first[new]], keys[new], plain[first[new]])
            at, size, known = self._find(keys)
            if not known.all():  # the cache was emptied for the new pieces
                new = np.flatnonzero(~known)
                self._learn(w.buf, starts[first[new]], ends[first[new]], keys[new], plain[first[new]])
                at, size, known = self._find(keys)
        many = size[back]
        owner = np.searchsorted(w.offsets, starts, side="right") - 1
        # a text of no bytes shares its offset with the next one, which owns the piece
        count = np.bincount(owner, weights=many, minlength=len(texts)).astype(np.int64) + 1
        total = int(many.sum())
        ids = self.pool[np.repeat(at[back] - (np.cumsum(many) - many), many) + np.arange(total)] if total else self.pool[:0]
        out = np.empty(total + len(texts), self.dtype)
        stop = np.zeros(len(out), bool)
        stop[np.cumsum(count) - 1] = True
        out[stop], out[~stop] = end, ids
        return out, count


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, tokenizer: str, end: int = 1, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Write the shards; returns the manifest (shard, path, n_docs, n_ids, start)."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        shard = TaskContext.get().partitionId()
        enc, path, out = None, None, None
        ids, sizes, nulls = [], [], 0
        for batch in slices(batches, "text"):
            if out is None:
                enc, path = encoder(tokenizer), new_file(folder, f"shard-{shard:06d}", ".tok")
                store, place = opened(path)
                out = store.open_output_stream(place)
                out.write(MAGIC)
            found, count = enc.encode(batch.column("text"), end)
            out.write(found.astype(found.dtype.newbyteorder("<"), copy=False).tobytes())
            sizes.append(count)
            nulls += batch.column("doc_id").null_count
            ids.append(batch.column("doc_id").drop_null().to_numpy())
        if out is None:
            return
        sizes, ids = np.concatenate(sizes), np.concatenate(ids)
        base = int(ids[0]) if len(ids) else 0
        ends = np.cumsum(sizes)
        parts = [EliasFano.encode(ends, int(ends[-1])), EliasFano.encode(ids - base, int(ids[-1]) - base if len(ids) else 0)]
        heads, blobs = zip(*[p.to_bytes() for p in parts])
        head = {"width": enc.dtype().itemsize, "n_ids": int(ends[-1]), "nulls": nulls, "base": base, "ends": heads[0], "ids": heads[1]}
        note = json.dumps(head | {"sizes": [len(b) for b in blobs]}).encode()
        for part in (*blobs, note, len(note).to_bytes(8, "little"), MAGIC):
            out.write(part)
        out.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(sizes)], "n_ids": [int(ends[-1])]}
        )

    manifest = cut_lineage(rows.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Shard:
    """One file: its footer, and ids by document."""

    def __init__(self, path: str):
        store, place = opened(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        length = int.from_bytes(tail[:8], "little")
        self.head = json.loads(self.file.read_at(length, size - 16 - length))
        a, b = self.head["sizes"]
        blobs = self.file.read_at(a + b, size - 16 - length - a - b)
        self.ends = EliasFano.from_bytes(self.head["ends"], blobs[:a])
        self.ids = EliasFano.from_bytes(self.head["ids"], blobs[a:])
        self.dtype = np.dtype(f"<u{self.head['width']}")

    def offsets(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def read(self, start: int, stop: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * width, len(MAGIC) + start * width), self.dtype)


def read_shards(manifest: DataFrame, block: int = 1 << 21) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(path)
                ends = shard.ends.values()
                begins = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                base, nulls = shard.head["base"], shard.head["nulls"]
                ids = np.concatenate((np.zeros(nulls, np.int64), shard.ids.values() + base))
                at = 0
                while at < len(ends):
                    to = max(at + 1, int(np.searchsorted(ends, begins[at] + block, side="right")))
                    data = shard.read(int(begins[at]), int(ends[to - 1])).astype("<u4")
                    cut = begins[at:to] - begins[at]
                    stop = ends[at:to] - begins[at]
                    crc = [zlib.crc32(data[a:b]) for a, b in zip(cut, stop)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids[at:to], mask=np.arange(at, to) < nulls), "start": begins[at:to] + start,
                        "n_tokens": stop - cut, "ids_crc32": pa.array(crc, pa.int64()),
                    })
                    at = to

    files = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return manifest.select("shard", "path", "start").repartition(files, "shard").mapInArrow(read, schema)


def token_ids(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write, then read back: one row per document."""
    return read_shards(write_shards(docs, tokenizer, end))
