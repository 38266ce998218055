"""Repeated byte strings across documents, by column-wise construction of a collection's suffix order.

A byte goes when some ``window``-byte string over it also starts in a document
with a smaller ``doc_id``.  Texts are UTF-8 bytes; strings never cross documents and
are judged on the input.

1. Tasks write the texts into block files, one after the other, with a manifest.
   Equal texts are one class: its first document stands for all, every later one goes whole
   (if it has a window at all).
2. Each window has an anchor, the gram of ``gram`` bytes with the smallest hash in
   it (the leftmost on ties).  Equal windows have equal anchors in the same place.  Each block sends the
   sorted hashes of its anchors by range of hashes and gets one bit per anchor
   back: whether another document may hold it.
3. The windows of such an anchor lie in one segment of at most ``2 * window - gram`` bytes
   around it.  Equal segments of a block are combined, with the smallest and largest document that holds
   them, and meet by anchor.
4. The segments of a task are a collection of short documents, aligned at their anchors.
   Round by round, from the last column to the first, one symbol per segment is
   inserted: the symbols in front of the suffixes, in suffix order, are the
   column's Burrows-Wheeler transform; a stable sort by them gives the next
   order, and the common prefix of two neighbours is one more than the least common
   prefix between their old places.  Symbols are read from one sequential file,
   orders and common prefixes appended to another, which a last pass reads once.
   Neighbours with a common prefix of ``window`` bytes or more share a window:
   exact, hashes only brought them together.
5. Blocks get back, per segment, which windows start in a smaller document, and
   read their file a last time to cut the spans.

The work of a task is bounded by its block or its range of hashes; a passage that
many documents hold costs one segment per block and different surroundings.  NULL and empty texts have no bytes.  Rows
without ``doc_id`` come after all others: they lose what others hold and make
nobody lose anything, not even each other.  Rows of one ``doc_id`` do not judge each
other.  Repeated rows get equal results.  Long texts make a block of their own and are
hashed in pieces.  Further columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.safe import spread
from lagloom.llm.arrow import lists, mapped, slices
from lagloom.llm.files import new_file, opened
from lagloom.llm.words import U64, mix, sliding, text_buffer
from lagloom.sources.session import ship
from lagloom.sources.writers import cut_lineage, scratch_path

WINDOW, GRAM = 50, 20
BLOCK = 1 << 22  # text bytes of a block file
PIECE = 1 << 20  # bytes whose hashes are held at a time
RANGE = 1 << 21  # bytes of anchors that meet in a range of hashes
LAST = np.iinfo(np.int64).max  # stands for a missing doc_id
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)

BYTES = mix(np.arange(1, 257, dtype=U64) * U64(_MUL))
PLACE = U64((1 << 24) - 1)


def named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST)))
    return docs.select(own.alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def block_files(docs: DataFrame, folder: str) -> DataFrame:
    """One row per block file: path, packed size, and the id, name and size of each text in it."""
    ship(docs.sparkSession)

    def run(batches):
        held, size = [], 0

        def flushed():
            texts = pa.chunked_array([b.column("text") for b in held]).combine_chunks()
            buf, offsets = text_buffer(texts)
            packed = pa.compress(buf.tobytes(), codec="zstd", asbytes=True)
            path = new_file(folder, "block", ".zst")
            store, place = opened(path)
            with store.open_output_stream(place) as out:
                out.write(packed)
            columns = [lists(np.concatenate([b.column(c).to_numpy() for b in held]), np.array([0, len(texts)])) for c in ("id", "k1", "k2")]
            sizes = lists(np.diff(offsets), np.array([0, len(texts)]))
            return pa.RecordBatch.from_arrays([pa.array([path]), *columns, sizes], names=["path", "id", "k1", "k2", "size"])

        for batch in slices(batches, "text", PIECE):
            own = pa.compute.sum(pa.compute.binary_length(batch.column("text"))).as_py() or 0
            if held and size + own > BLOCK:
                yield flushed()
                held, size = [], 0
            held.append(batch)
            size += own
        if held:
            yield flushed()

    schema = "path string, id array<long>, k1 array<long>, k2 array<long>, size array<long>"
    return named(docs).mapInArrow(run, schema)


def read_block(path: str, sizes: np.ndarray) -> np.ndarray:
    store, place = opened(path)
    with store.open_input_stream(place) as source:
        packed = source.read()
    total = int(sizes.sum())
    return np.frombuffer(pa.decompress(packed, decompressed_size=total, codec="zstd"), np.uint8) if total else np.zeros(0, np.uint8)


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each byte on, from running sums of powers."""
    power = np.cumprod(np.append(U64(1), np.full(len(buf), _MUL, U64)), dtype=U64)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(BYTES[buf] * power[:-1], dtype=U64)))
    back = np.cumprod(np.append(U64(1), np.full(max(len(buf) - gram, 0), _INV, U64)), dtype=U64)
    return mix((total[gram:] - total[:-gram]) * back)


def anchors(buf: np.ndarray, sizes: np.ndarray, use: np.ndarray, window: int, gram: int):
    """(hash, place, first, last, text) of each anchor: its windows start at ``first`` to ``last``, in texts in use."""
    out = []
    ends = np.cumsum(sizes)
    for a in range(0, len(buf) - window + 1, PIECE):
        part = buf[a : a + PIECE + window - 1]
        n = len(part) - window + 1
        value = gram_hashes(part, gram)
        least = sliding((value & ~PLACE) | np.arange(len(value), dtype=U64), window - gram + 1, np.minimum)
        place = (least & PLACE).astype(np.int64)
        text = np.searchsorted(ends, np.arange(a, a + n), side="right")
        good = np.flatnonzero(use[text] & (np.arange(a, a + n) + window <= ends[text]))
        if not len(good):
            continue
        at, owner = place[good], text[good]
        head = np.ones(len(good), bool)
        head[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(good)) - 1
        out.append((value[at[heads]], at[heads] + a, good[heads] + a, good[tails] + a, owner[heads]))
    if not out:
        return np.zeros(0, U64), *[np.zeros(0, np.int64)] * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def listed(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    value = batch.column(name)[row].values
    return value.to_numpy(zero_copy_only=False) if value is not None else np.zeros(0, np.int64)


def in_use(batch: pa.RecordBatch, row: int, n: int) -> np.ndarray:
    use = np.zeros(n, bool)
    use[listed(batch, "leaders", row)] = True
    return use


def by_range(value: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of hashes begins in sorted ``value``, one more entry at the end."""
    step = (1 << 64) // ranges
    return np.append(np.searchsorted(value, np.array([r * step for r in range(ranges)], U64)), len(value))


def sent_anchors(blocks: DataFrame, ranges: int, window: int, gram: int) -> DataFrame:
    """(part, block, n, hashes, twice): a block's anchors in each range, 6 bytes each, and whether two texts of it hold them."""

    def work(batch):
        out = {"part": [], "block": [], "n": [], "hashes": [], "twice": []}
        for r in range(batch.num_rows):
            sizes = listed(batch, "size", r)
            buf = read_block(batch.column("path")[r].as_py(), sizes)
            value, _, _, _, text = anchors(buf, sizes, in_use(batch, r, len(sizes)), window, gram)
            order = np.argsort(value, kind="stable")
            known, heads = np.unique(value[order], return_index=True)
            if not len(known):
                continue
            own = text[order]
            twice = np.minimum.reduceat(own, heads) < np.maximum.reduceat(own, heads)
            at = by_range(known, ranges)
            for part in np.flatnonzero(np.diff(at)).tolist():
                a, b = at[part], at[part + 1]
                out["part"].append(part)
                out["block"].append(batch.column("block")[r].as_py())
                out["n"].append(b - a)
                out["hashes"].append(known[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                out["twice"].append(np.packbits(twice[a:b]).tobytes())
        return {**out, "n": np.array(out["n"], np.int64), "part": np.array(out["part"], np.int64), "block": np.array(out["block"], np.int64),
                "hashes": pa.array(out["hashes"], pa.binary()), "twice": pa.array(out["twice"], pa.binary())}

    one = blocks.select("block", "path", "size", "leaders")
    return mapped(spread(one, "block"), "part long, block long, n long, hashes binary, twice binary", work)


def shared_anchors(sent: DataFrame) -> DataFrame:
    """(block, part, bits): of the anchors a block sent, those that another text may hold."""

    def work(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        raw = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("hashes")]).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        value = wide.view(U64).ravel()
        order = np.argsort(value, kind="stable")
        same = np.zeros(len(value) + 1, bool)
        same[1:-1] = value[order][1:] == value[order][:-1]
        again = np.zeros(len(value), bool)
        again[order] = same[1:] | same[:-1]
        rows, at = [], 0
        for size, twice in zip(n.tolist(), table.column("twice")):
            bits = np.packbits(again[at : at + size]) | np.frombuffer(twice.as_py(), np.uint8)
            rows.append(bits.tobytes() if bits.any() else None)
            at += size
        out = pa.table({"block": table.column("block"), "part": table.column("part"), "n": table.column("n"), "bits": pa.array(rows, pa.binary())})
        return out.filter(pa.compute.is_valid(out.column("bits")))

    ship(sent.sparkSession)
    return sent.groupBy("part").applyInArrow(work, "block long, part long, n long, bits binary")


class Segments:
    """The segments of a block's shared anchors; equal ones have one number, ascending by hash."""

    def __init__(self, batch: pa.RecordBatch, r: int, ranges: int, window: int, gram: int):
        self.sizes = listed(batch, "size", r)
        self.buf = read_block(batch.column("path")[r].as_py(), self.sizes)
        self.left = window - gram
        self.width = self.left + window
        ids = listed(batch, "id", r)
        shared = batch.column("shared")[r].as_py() or []
        if not shared:
            self.number = self.base = self.owner = np.zeros(0, np.int64)
            self.rows = np.zeros((0, 10 + self.width), np.uint8)
            self.heads = np.zeros(ranges + 1, np.int64)
            self.low = self.high = np.zeros(0, np.int64)
            return
        value, place, first, last, owner = anchors(self.buf, self.sizes, in_use(batch, r, len(self.sizes)), window, gram)
        known = np.unique(value)
        at = by_range(known, ranges)
        again = np.zeros(len(known), bool)
        for x in shared:
            again[at[x["part"]] : at[x["part"] + 1]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]).view(bool)
        take = again[np.searchsorted(known, value)]
        value, place, first, last, self.owner = (x[take] for x in (value, place, first, last, owner))
        self.base = place - self.left  # the byte in column 0
        start, end = first - self.base, last + window - self.base
        padded = np.concatenate((np.zeros(self.left, np.uint8), self.buf, np.zeros(self.width, np.uint8)))
        body = np.lib.stride_tricks.sliding_window_view(padded, self.width)[place]
        column = np.arange(self.width)
        body = np.where((column >= start[:, None]) & (column < end[:, None]), body, np.uint8(0))
        head = np.stack((start, end), axis=1).astype(np.uint8)
        rows = np.concatenate((value.astype(">u8").view(np.uint8).reshape(-1, 8), head, body), axis=1)
        packed = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
        self.rows, self.number = np.unique(packed, return_inverse=True)
        self.rows = self.rows.view(np.uint8).reshape(-1, rows.shape[1])
        self.low = np.full(len(self.rows), LAST)
        self.high = np.full(len(self.rows), np.iinfo(np.int64).min)
        np.minimum.at(self.low, self.number, ids[self.owner])
        np.maximum.at(self.high, self.number, ids[self.owner])
        self.heads = by_range(np.ascontiguousarray(self.rows[:, :8]).view(">u8").ravel().astype(U64), ranges)


def sent_segments(blocks: DataFrame, ranges: int, window: int, gram: int) -> DataFrame:
    """(part, block, first, rows, low, high): a block's segments in each range, from number ``first`` on."""

    def work(batch):
        out = {"part": [], "block": [], "first": [], "rows": [], "low": [], "high": []}
        for r in range(batch.num_rows):
            s = Segments(batch, r, ranges, window, gram)
            for part in np.flatnonzero(np.diff(s.heads)).tolist():
                a, b = s.heads[part], s.heads[part + 1]
                out["part"].append(part)
                out["block"].append(batch.column("block")[r].as_py())
                out["first"].append(a)
                for name, value in (("rows", s.rows), ("low", s.low), ("high", s.high)):
                    out[name].append(value[a:b].tobytes())
        longs = {n: np.array(out[n], np.int64) for n in ("part", "block", "first")}
        return longs | {n: pa.array(out[n], pa.binary()) for n in ("rows", "low", "high")}

    schema = "part long, block long, first long, rows binary, low binary, high binary"
    return mapped(spread(blocks, "block"), schema, work)


def insert_columns(group: np.ndarray, start: np.ndarray, end: np.ndarray, columns, width: int):
    """(column, order, common prefixes) after each round, from the last column to the first.

    ``columns()`` gives the next column's bytes.  ``group`` ascends; suffixes of different
    groups are never compared.  A segment has symbols in columns ``start`` to ``end - 1``.
    """
    m = len(group)
    order, common = np.arange(m), np.zeros(m, np.uint8)
    border = np.ones(m, bool)
    border[1:] = group[1:] != group[:-1]
    of = np.cumsum(border) - 1
    for c in range(width - 1, -1, -1):
        inside = (start <= c) & (c < end)
        symbol = np.where(inside, columns().astype(np.int16) + 1, 0)
        front = symbol[order]  # the column's Burrows-Wheeler transform
        differs = np.zeros(m, bool)
        differs[1:] = (front[1:] != front[:-1]) & ~border[1:]
        mixed = np.zeros(of[-1] + 1, bool)
        mixed[of[differs]] = True
        new = np.where((front > 0) & ~border, common + 1, 0).astype(np.uint8)
        at = np.flatnonzero(mixed[of])
        if len(at):
            key = of[at] * 512 + front[at]
            moved = np.argsort(key, kind="stable")
            key = key[moved]
            least = np.zeros(len(at), np.int64)
            pair = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % 512 > 0)) + 1
            before, after = moved[pair - 1], moved[pair]
            prefix = np.append(common[at], 0)
            low = prefix[after].astype(np.int64)
            far = np.flatnonzero(after > before + 1)
            if len(far):
                edges = np.stack((before[far] + 1, after[far] + 1), axis=1).ravel()
                low[far] = np.minimum.reduceat(prefix, edges)[::2]
            least[pair] = low + 1
            new[at] = least
            order[at] = order[at][moved]
        common = new
        yield c, order, common


def repeated_windows(sent: DataFrame, folder: str, window: int, gram: int) -> DataFrame:
    """(block, segment, first, last, low): windows of segments that also start in the smaller document ``low``."""
    left = window - gram
    width = left + window

    def work(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("rows")]).reshape(-1, 10 + width)
        low, high = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column(c)]) for c in ("low", "high"))
        n = [len(x.as_py()) // 8 for x in table.column("low")]
        block = np.repeat(table.column("block").to_numpy(), n)
        number = np.concatenate([np.arange(a, a + k) for a, k in zip(table.column("first").to_pylist(), n)])
        value = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(U64)
        by = np.argsort(value, kind="stable")
        start, end = rows[by, 8].astype(np.int64), rows[by, 9].astype(np.int64)
        low, high, block, number, value = low[by], high[by], block[by], number[by], value[by]
        m = len(by)
        symbols, ranks = new_file(folder, "columns", ".bin"), new_file(folder, "ranks", ".bin")
        (store, of_symbols), (_, of_ranks) = opened(symbols), opened(ranks)
        with store.open_output_stream(of_symbols) as out:
            for c in range(width - 1, -1, -1):
                out.write(np.ascontiguousarray(rows[by, 10 + c]).tobytes())
        del rows
        with store.open_input_stream(of_symbols) as source, store.open_output_stream(of_ranks) as out:
            for c, order, common in insert_columns(value, start, end, lambda: np.frombuffer(source.read(m), np.uint8), width):
                if c <= left:
                    out.write(order.astype(np.int32).tobytes())
                    out.write(common.tobytes())
        found = []
        running, since = np.full(m, LAST), np.zeros(m, np.int64)  # each segment's open stretch of windows

        def close(which, c):
            ended = np.flatnonzero(which & (running < LAST))
            if len(ended):
                found.append((block[ended], number[ended], np.full(len(ended), c + 1), since[ended], running[ended]))

        with store.open_input_stream(of_ranks) as source:
            for c in range(left, -1, -1):
                order = np.frombuffer(source.read(4 * m), np.int32)
                common = np.frombuffer(source.read(m), np.uint8)
                heads = np.flatnonzero(np.concatenate(([True], common[1:] < window)))
                least = np.minimum.reduceat(low[order], heads)
                now = np.full(m, LAST)
                now[order] = np.repeat(least, np.diff(np.append(heads, m)))
                now[(start > c) | (c + window > end) | (now >= high)] = LAST
                change = now != running
                close(change, c)
                since = np.where(change, c, since)
                running = now
        close(np.ones(m, bool), -1)
        for place in (of_symbols, of_ranks):
            store.delete_file(place)
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        by = np.argsort(columns[0], kind="stable")
        columns = [x[by] for x in columns]
        owner, heads = np.unique(columns[0], return_index=True)
        ends = np.append(heads, len(by))
        return pa.table({"block": owner} | {c: lists(x, ends) for c, x in zip(("segment", "first", "last", "low"), columns[1:])})

    ship(sent.sparkSession)
    schema = "block long, segment array<long>, first array<long>, last array<long>, low array<long>"
    return sent.groupBy("part").applyInArrow(work, schema)


def cut(blocks: DataFrame, ranges: int, window: int, gram: int) -> DataFrame:
    """(k1, k2, starts, ends, kept_sha256) of every class: its removed spans and the digest of what is left."""

    def work(batch):
        out = {"k1": [], "k2": [], "starts": [], "ends": [], "kept_sha256": []}
        for r in range(batch.num_rows):
            s = Segments(batch, r, ranges, window, gram)
            ids, k1, k2 = (listed(batch, c, r) for c in ("id", "k1", "k2"))
            edge = np.zeros(len(s.buf) + 1, np.int32)
            found = batch.column("found")[r].as_py() or []
            if found:
                columns = [np.concatenate([np.array(x[c], np.int64) for x in found]) for c in ("segment", "first", "last", "low")]
                by = np.argsort(columns[0], kind="stable")
                segment, first, last, low = (x[by] for x in columns)
                # every place of a segment takes its stretches
                a, b = np.searchsorted(segment, s.number), np.searchsorted(segment, s.number, side="right")
                n = b - a
                place = np.repeat(np.arange(len(n)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                smaller = low[at] < ids[s.owner[place]]
                place, at = place[smaller], at[smaller]
                np.add.at(edge, s.base[place] + first[at], 1)
                np.add.at(edge, s.base[place] + last[at] + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            heads = np.concatenate(([0], np.cumsum(s.sizes)))
            for i in listed(batch, "leaders", r).tolist():
                a, b = heads[i], heads[i + 1]
                own = np.concatenate(([False], gone[a:b], [False]))
                change = np.flatnonzero(own[1:] != own[:-1])
                out["k1"].append(k1[i])
                out["k2"].append(k2[i])
                out["starts"].append(change[::2])
                out["ends"].append(change[1::2])
                out["kept_sha256"].append(hashlib.sha256(s.buf[a:b][~gone[a:b]].tobytes()).hexdigest())
        names = {"k1": pa.int64(), "k2": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "kept_sha256": pa.string()}
        return {n: pa.array(out[n], t) for n, t in names.items()}

    return mapped(spread(blocks, "block"), "k1 long, k2 long, starts array<long>, ends array<long>, kept_sha256 string", work)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, starts, ends (of the removed spans, in bytes), kept_sha256."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "suffixes")
    blocks = cut_lineage(block_files(docs, folder), "manifest")
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    each = blocks.select("block", F.posexplode(F.arrays_zip("id", "k1", "k2", "size")).alias("at", "doc"))
    each = each.select("block", "at", "doc.*")
    classes = cut_lineage(each.groupBy("k1", "k2").agg(F.min(F.struct("id", "block", "at")).alias("leader")), "classes")
    leaders = classes.groupBy("leader.block").agg(F.collect_list(F.col("leader.at").cast("long")).alias("leaders"))
    blocks = cut_lineage(blocks.join(leaders, "block"), "leaders")
    total = blocks.agg(F.sum(F.expr("aggregate(size, 0L, (a, x) -> a + x)"))).first()[0] or 0
    ranges = 1
    while ranges * RANGE < total * 6 // 16:
        ranges *= 2
    bits = shared_anchors(sent_anchors(blocks, ranges, window, gram))
    bits = bits.groupBy("block").agg(F.collect_list(F.struct("part", "n", "bits")).alias("shared"))
    blocks = cut_lineage(blocks.join(bits, "block", "left"), "shared")
    sent = sent_segments(blocks.filter("shared IS NOT NULL"), ranges, window, gram)
    found = repeated_windows(sent, folder, window, gram)
    found = found.groupBy("block").agg(F.collect_list(F.struct("segment", "first", "last", "low")).alias("found"))
    done = cut(blocks.join(cut_lineage(found, "found"), "block", "left"), ranges, window, gram)
    rows = each.select("id", "k1", "k2", "size").join(cut_lineage(done, "spans"), ["k1", "k2"])
    rows = rows.join(classes.select("k1", "k2", F.col("leader.id").alias("first_id")), ["k1", "k2"])
    whole = (F.col("id") > F.col("first_id")) & (F.col("size") >= window)
    return rows.select(
        F.when(F.col("id") < int(LAST), F.col("id")).alias("doc_id"), F.col("size").alias("n_bytes"),
        F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.col("starts")).alias("starts"),
        F.when(whole, F.array("size")).otherwise(F.col("ends")).alias("ends"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def summary(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``repeated_spans``."""
    removed = F.expr("aggregate(zip_with(ends, starts, (e, s) -> e - s), 0L, (a, x) -> a + x)")
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")
