"""Repeated passages by relative Lempel-Ziv parsing of documents against indexed reference blocks.

A window is ``window`` consecutive words of one document; a word goes when some
window over it occurs anywhere else too, in the same document or another.

1. Tasks write the texts into block files; every block is both parsed and
   reference.  Equal texts are one class; a text that is there twice is repeated as a whole.
2. Content says where the index points: among the grams of ``gram`` words in a window
   the one with the smallest hash (the leftmost on ties) is its anchor.  Equal windows
   have equal anchors in the same place.  Blocks send the hashes of their
   anchors by range of hashes and learn which are held more than once.
3. The words around such an anchor, as far as its windows reach, are a segment.  All
   segments of an anchor are the reference block in which its places are looked up.
   Equal segments of a block are combined and counted first.
4. For every start in a segment, suffix order gives the longest match with another
   segment, word by word.  The parse is greedy: at each start it takes the longest
   factor; one of ``window`` words or more is a duplicate span.  The windows that straddle its end are not
   judged by it, so the parse goes on at the first of these, ``window - 1`` words before the boundary, and
   by single words where no factor is long enough.  So every window is judged
   exactly.
5. Blocks get their factors back and cut the union of the spans.

A task's work is bounded by its block or its range of hashes; a passage that most documents
hold costs one segment per block and different surroundings.  NULL and empty
texts have no words.  Rows without ``doc_id`` and repeated rows are documents
like any other; further columns are ignored.  A very long text is a block of its
own.  An empty table gives an empty result.  Words are compared by 64-bit hashes,
windows by all their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.safe import spread
from lagloom.llm.arrow import lists, mapped
from lagloom.llm.suffixes import block_files, by_range, in_use, listed, read_block, shared_anchors
from lagloom.llm.words import U64, grams, sliding, word_hashes, word_spans
from lagloom.sources.session import ship
from lagloom.sources.writers import cut_lineage, scratch_path

WINDOW, GRAM = 35, 12
RANGE = 1 << 20  # bytes of anchors that meet in a range of hashes
_LOW = U64(0xFFFFFFFF)


class Block:
    """The words of a block file and the anchors of the texts in use.

    Anchor ``i`` has its hash in ``value`` and serves the windows that begin at the
    words ``first[i]`` to ``last[i]``; it begins at the word ``place[i]``.
    """

    def __init__(self, batch: pa.RecordBatch, r: int, window: int, gram: int):
        self.sizes = listed(batch, "size", r)
        self.buf = read_block(batch.column("path")[r].as_py(), self.sizes)
        offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.starts, self.ends, self.first_word = word_spans(self.buf, offsets)
        self.hashes = word_hashes(self.buf, self.starts, self.ends, False)
        use = in_use(batch, r, len(self.sizes))
        value = grams(self.hashes, gram)
        none = np.zeros(0, np.int64)
        self.value, self.place, self.first, self.last, self.owner = np.zeros(0, U64), none, none, none, none
        if len(self.hashes) < window:
            return
        # the upper half of the hash decides, then the place
        key = (value & ~_LOW) | np.arange(len(value), dtype=U64)
        place = (sliding(key, window - gram + 1, np.minimum) & _LOW).astype(np.int64)
        text = np.repeat(np.arange(len(self.sizes)), np.diff(self.first_word))[: len(place)]
        good = np.flatnonzero(use[text] & (np.arange(len(place)) + window <= self.first_word[text + 1]))
        if not len(good):
            return
        at, owner = place[good], text[good]
        head = np.ones(len(good), bool)
        head[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(good)) - 1
        self.value, self.place, self.owner = value[at[heads]], at[heads], owner[heads]
        self.first, self.last = good[heads], good[tails]


class Segments(Block):
    """The segments of a block's shared anchors; equal ones have one number, ascending by hash."""

    def __init__(self, batch: pa.RecordBatch, r: int, ranges: int, window: int, gram: int):
        super().__init__(batch, r, window, gram)
        shared = batch.column("shared")[r].as_py() or []
        known = np.unique(self.value)
        at = by_range(known, ranges)
        again = np.zeros(len(known), bool)
        for x in shared:
            again[at[x["part"]] : at[x["part"] + 1]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]).view(bool)
        take = again[np.searchsorted(known, self.value)]
        value, place, first, last = (x[take] for x in (self.value, self.place, self.first, self.last))
        self.base = place - (window - gram)  # the word in column 0
        begins, closes = self.starts[first], self.ends[last + window - 1]
        data = self.buf.tobytes()
        seen: dict[tuple, int] = {}
        self.number = np.empty(len(value), np.int64)
        for i, (v, c, a, b) in enumerate(zip(value.tolist(), (first - self.base).tolist(), begins.tolist(), closes.tolist())):
            self.number[i] = seen.setdefault((v, c, data[a:b]), len(seen))
        rows = list(seen)
        order = np.argsort(np.array([v for v, _, _ in rows], U64), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.number = rank[self.number]
        self.rows = [rows[i] for i in order.tolist()]
        self.count = np.bincount(self.number, minlength=len(rows))
        self.heads = by_range(np.array([v for v, _, _ in self.rows], U64), ranges)


def sent_anchors(blocks: DataFrame, ranges: int, window: int, gram: int) -> DataFrame:
    """(part, block, n, hashes, twice): a block's anchors in each range, 6 bytes each, and whether it holds them twice."""

    def work(batch):
        out = {"part": [], "block": [], "n": [], "hashes": [], "twice": []}
        for r in range(batch.num_rows):
            known, n = np.unique(Block(batch, r, window, gram).value, return_counts=True)
            at = by_range(known, ranges)
            for part in np.flatnonzero(np.diff(at)).tolist():
                a, b = at[part], at[part + 1]
                out["part"].append(part)
                out["block"].append(batch.column("block")[r].as_py())
                out["n"].append(b - a)
                out["hashes"].append(known[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                out["twice"].append(np.packbits(n[a:b] > 1).tobytes())
        longs = {c: np.array(out[c], np.int64) for c in ("part", "block", "n")}
        return longs | {c: pa.array(out[c], pa.binary()) for c in ("hashes", "twice")}

    one = blocks.select("block", "path", "size", "leaders")
    return mapped(spread(one, "block"), "part long, block long, n long, hashes binary, twice binary", work)


def sent_segments(blocks: DataFrame, ranges: int, window: int, gram: int) -> DataFrame:
    """(part, block, first, value, start, size, count, text): a block's segments in each range, from number ``first`` on."""

    def work(batch):
        out = {c: [] for c in ("part", "block", "first", "value", "start", "size", "count", "text")}
        for r in range(batch.num_rows):
            s = Segments(batch, r, ranges, window, gram)
            for part in np.flatnonzero(np.diff(s.heads)).tolist():
                a, b = s.heads[part], s.heads[part + 1]
                value, start, text = zip(*s.rows[a:b])
                out["part"].append(part)
                out["block"].append(batch.column("block")[r].as_py())
                out["first"].append(a)
                out["value"].append(np.array(value, U64).tobytes())
                out["start"].append(np.array(start, np.uint8).tobytes())
                out["size"].append(np.array([len(t) for t in text], np.int32).tobytes())
                out["count"].append(s.count[a:b].astype(np.int32).tobytes())
                out["text"].append(b"".join(text))
        longs = {c: np.array(out.pop(c), np.int64) for c in ("part", "block", "first")}
        return longs | {c: pa.array(v, pa.binary()) for c, v in out.items()}

    schema = "part long, block long, first long, value binary, start binary, size binary, count binary, text binary"
    return mapped(spread(blocks, "block"), schema, work)


def longest_matches(group: np.ndarray, count: np.ndarray, start: np.ndarray, words: np.ndarray, heads: np.ndarray, width: int, columns: int):
    """``[column, segment]``: words of the longest match, with another place of the segment's group, from each column on.

    ``words[heads[i]:heads[i + 1]]`` are those of segment ``i``, the first in column ``start[i]``;
    ``group`` ascends.  Suffixes are kept in order from the last column to the first; neighbours
    in it have the longest common beginnings.
    """
    m = len(group)
    end = start + np.diff(heads)
    order, common = np.arange(m), np.zeros(m, np.int64)
    border = np.ones(m, bool)
    border[1:] = group[1:] != group[:-1]
    of = np.cumsum(border) - 1
    out = np.zeros((columns, m), np.uint8)
    for c in range(width - 1, -1, -1):
        inside = (start <= c) & (c < end)
        word = np.zeros(m, np.int64)
        word[inside] = words[heads[:-1][inside] + c - start[inside]] + 1
        front = word[order]
        differs = np.zeros(m, bool)
        differs[1:] = (front[1:] != front[:-1]) & ~border[1:]
        mixed = np.zeros(of[-1] + 1, bool)
        mixed[of[differs]] = True
        new = np.where((front > 0) & ~border, common + 1, 0)
        at = np.flatnonzero(mixed[of])
        if len(at):
            moved = np.lexsort((front[at], of[at]))
            same = (of[at][moved][1:] == of[at][moved][:-1]) & (front[at][moved][1:] == front[at][moved][:-1]) & (front[at][moved][1:] > 0)
            pair = np.flatnonzero(same) + 1
            before, after = moved[pair - 1], moved[pair]
            prefix = np.append(common[at], 0)
            low = prefix[after]
            far = np.flatnonzero(after > before + 1)
            if len(far):
                edges = np.stack((before[far] + 1, after[far] + 1), axis=1).ravel()
                low[far] = np.minimum.reduceat(prefix, edges)[::2]
            least = np.zeros(len(at), np.int64)
            least[pair] = low + 1
            new[at] = least
            order[at] = order[at][moved]
        common = new
        if c < columns:
            both = np.maximum(common, np.append(common[1:], 0))
            found = np.zeros(m, np.int64)
            found[order] = both
            out[c] = np.where(count > 1, np.where(inside, end - c, 0), found)
    return out


def greedy(match: np.ndarray, start: np.ndarray, end: np.ndarray, window: int):
    """(segment, column, length) of the factors that are long enough, by greedy parsing of every segment."""
    found = []
    following = start.copy()
    for c in range(len(match)):
        here = np.flatnonzero((following == c) & (c + window <= end))
        length = match[c][here].astype(np.int64)
        long = length >= window
        found.append((here[long], np.full(long.sum(), c), length[long]))
        # the windows across the boundary are judged by factors of their own
        following[here] = np.where(long, c + length - window + 1, c + 1)
    return tuple(np.concatenate(x) for x in zip(*found))


def factored(sent: DataFrame, window: int, gram: int) -> DataFrame:
    """(block, segment, column, length): the factors of all segments, by the blocks they come from."""
    left = window - gram

    def work(table: pa.Table) -> pa.Table:
        def flat(name, kind):
            return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])

        n = [len(x.as_py()) // 8 for x in table.column("value")]
        value, start = flat("value", U64), flat("start", np.uint8).astype(np.int64)
        size, count, buf = flat("size", np.int32).astype(np.int64), flat("count", np.int32), flat("text", np.uint8)
        block = np.repeat(table.column("block").to_numpy(), n)
        number = np.concatenate([np.arange(a, a + k) for a, k in zip(table.column("first").to_pylist(), n)])
        starts, ends, heads = word_spans(buf, np.concatenate(([0], np.cumsum(size))))
        _, words = np.unique(word_hashes(buf, starts, ends, False), return_inverse=True)
        by = np.argsort(value, kind="stable")
        lens = np.diff(heads)[by]
        at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(heads[:-1][by], lens)
        words, heads = words[at], np.concatenate(([0], np.cumsum(lens)))
        start, end = start[by], start[by] + lens
        match = longest_matches(value[by], count[by], start, words, heads, left + window, left + 1)
        segment, column, length = greedy(match, start, end, window)
        own = by[segment]
        order = np.lexsort((number[own], block[own]))
        own, column, length = own[order], column[order], length[order]
        owner, first = np.unique(block[own], return_index=True)
        bounds = np.append(first, len(own))
        return pa.table({"block": owner, "segment": lists(number[own], bounds), "column": lists(column, bounds), "length": lists(length, bounds)})

    ship(sent.sparkSession)
    return sent.groupBy("part").applyInArrow(work, "block long, segment array<long>, column array<long>, length array<long>")


def removed(batch: pa.RecordBatch, r: int, ranges: int, window: int, gram: int) -> tuple[Segments, np.ndarray]:
    """A block and which of its words lie in a factor."""
    s = Segments(batch, r, ranges, window, gram)
    edge = np.zeros(len(s.hashes) + 1, np.int64)
    found = batch.column("found")[r].as_py() or []
    if found:
        segment, column, length = (np.concatenate([np.array(x[c], np.int64) for x in found]) for c in ("segment", "column", "length"))
        by = np.argsort(segment, kind="stable")
        segment, column, length = segment[by], column[by], length[by]
        a, b = np.searchsorted(segment, s.number), np.searchsorted(segment, s.number, side="right")
        n = b - a
        place = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        np.add.at(edge, s.base[place] + column[at], 1)
        np.add.at(edge, s.base[place] + column[at] + length[at], -1)
    return s, np.cumsum(edge[:-1]) > 0


def parsed(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame, int]:
    """(block, at, k1, k2, copies) of every class's first text, the blocks with what was found in them, and the ranges used."""
    folder = scratch_path(docs.sparkSession, "reference")
    blocks = cut_lineage(block_files(docs, folder), "manifest")
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    each = blocks.select("block", F.posexplode(F.arrays_zip("k1", "k2")).alias("at", "doc")).select("block", "at", "doc.*")
    first = F.min(F.struct("block", "at")).alias("first")
    classes = cut_lineage(each.groupBy("k1", "k2").agg(first, F.count("*").alias("copies")), "classes")
    leaders = classes.groupBy("first.block").agg(F.collect_list(F.col("first.at").cast("long")).alias("leaders"))
    blocks = cut_lineage(blocks.join(leaders, "block"), "leaders")
    total = blocks.agg(F.sum(F.expr("aggregate(size, 0L, (a, x) -> a + x)"))).first()[0] or 0
    ranges = 1
    while ranges * RANGE < total * 6 // 64:
        ranges *= 2
    bits = shared_anchors(sent_anchors(blocks, ranges, window, gram))
    bits = bits.groupBy("block").agg(F.collect_list(F.struct("part", "n", "bits")).alias("shared"))
    blocks = cut_lineage(blocks.join(bits, "block", "left"), "shared")
    found = factored(sent_segments(blocks.filter("shared IS NOT NULL"), ranges, window, gram), window, gram)
    found = found.groupBy("block").agg(F.collect_list(F.struct("segment", "column", "length")).alias("found"))
    return classes, blocks.join(cut_lineage(found, "found"), "block", "left"), ranges


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, start, length): the duplicate spans of every different text, in words, by its name."""
    classes, blocks, ranges = parsed(docs, window, gram)

    def work(batch):
        out = []
        for r in range(batch.num_rows):
            s, gone = removed(batch, r, ranges, window, gram)
            k1, k2 = listed(batch, "k1", r), listed(batch, "k2", r)
            for i in listed(batch, "leaders", r).tolist():
                own = np.concatenate(([False], gone[s.first_word[i] : s.first_word[i + 1]], [False]))
                change = np.flatnonzero(own[1:] != own[:-1])
                out += [(k1[i], k2[i], a, b - a, len(own) - 2) for a, b in zip(change[::2], change[1::2])] or [(k1[i], k2[i], 0, 0, len(own) - 2)]
        return {c: np.array([x[j] for x in out], np.int64) for j, c in enumerate(("k1", "k2", "start", "length", "n"))} if out else None

    found = mapped(spread(blocks, "block"), "k1 long, k2 long, start long, length long, n long", work).join(classes, ["k1", "k2"])
    whole = (F.col("copies") > 1) & (F.col("n") >= window)
    start = F.when(whole, F.lit(0)).otherwise(F.col("start")).cast("long").alias("start")
    length = F.when(whole, F.col("n")).otherwise(F.col("length")).alias("length")
    return found.select("k1", "k2", start, length).distinct().filter("length > 0")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    classes, blocks, ranges = parsed(docs, window, gram)

    def work(batch):
        out = {c: [] for c in ("k1", "k2", "n_words", "n_removed", "kept_sha256")}
        for r in range(batch.num_rows):
            s, gone = removed(batch, r, ranges, window, gram)
            k1, k2, data = listed(batch, "k1", r), listed(batch, "k2", r), s.buf.tobytes()
            kept = ~gone
            for i in listed(batch, "leaders", r).tolist():
                a, b = s.first_word[i], s.first_word[i + 1]
                stay = np.flatnonzero(kept[a:b]) + a
                words = [data[x:y] for x, y in zip(s.starts[stay].tolist(), s.ends[stay].tolist())]
                out["k1"].append(k1[i])
                out["k2"].append(k2[i])
                out["n_words"].append(b - a)
                out["n_removed"].append(b - a - len(stay))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
        longs = {c: np.array(out[c], np.int64) for c in ("k1", "k2", "n_words", "n_removed")}
        return longs | {"kept_sha256": pa.array(out["kept_sha256"], pa.string())}

    done = mapped(spread(blocks, "block"), "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string", work)
    done = done.join(classes.select("k1", "k2", "copies"), ["k1", "k2"])
    every = (F.col("copies") > 1) & (F.col("n_words") >= window)
    done = cut_lineage(
        done.select(
            "k1", "k2", "n_words", F.when(every, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(every, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        ),
        "cleaned",
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    return rows.join(done, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")
