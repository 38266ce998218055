"""Ranked search by bit-sliced Bloom signatures: bounds from bitmaps first, exact scores for what they do not exclude.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII;
A-Z is lower-cased.  Every document has a Bloom signature of its terms and, for
a repeated term, of the steps 2, 3, 4, 6, 8, 12, 16, ... that its count reaches.
Documents of like size share a signature width, so that no signature is fuller
than another's.  The signatures of a block of documents are stored slice by
slice: one bitmap over the documents for each bit of the signature.

For a query term the slices of its probes are intersected; the documents left
include all that hold it.  How many steps are left bounds its count from above, the
stored length gives the document's own damping, and the sum over a query's terms
is an upper bound of the score, never below it.  The exact scores of the ten documents
with the highest bounds give a threshold; every document whose bound reaches it
(on equality, one whose id comes no later) is scored exactly.  Nothing else can
be among the first ten, so the result is exact.

Queries go in blocks of bounded size, each against all documents.  NULL and empty texts
have no terms and are in no result; queries without terms have none.  Rows
without ``doc_id`` come last among equals; repeated rows rank one after the
other, as do repeated queries.  Texts are read whole.  Further columns are
ignored.  Empty tables give an empty result.  Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.arrow import lists, map_slices, mapped, slices
from lagloom.llm.words import U64, mix, text_buffer, word_hashes, word_spans
from lagloom.sources.session import ship
from lagloom.sources.writers import cut_lineage

FIRST = 10
PER_KEY, PROBES, LEAST_BITS = 16, 4, 256
BLOCK = 1 << 20  # bytes of a block's bitmaps
BLOCK_DOCS = 8192
TERM_ROW = 1 << 18  # (document, term) pairs counted before their sums are sent
QUERY_TERMS = 1 << 14  # terms of the queries of a block
CELLS = 1 << 21  # query terms times documents bounded at a time
STEPS = np.array(sorted({x for i in range(40) for x in (1 << i, 3 << i)}), np.int64)

TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOW = np.arange(256, dtype=np.uint8)
LOW[ord("A") : ord("Z") + 1] += 32
LOW[~TERM] = 32

BLOCKS = "bits int, ids array<long>, k1 array<long>, k2 array<long>, n array<long>, slices binary, terms array<long>, df array<long>"


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of a batch, and the number of the first term of each text."""
    raw, offsets = text_buffer(texts)
    buf = LOW[raw]
    starts, ends, first = word_spans(buf, offsets)
    return word_hashes(buf, starts, ends, False), first


def counts(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the distinct terms of each text, by text, then hash."""
    value, heads = hashes.copy(), first.tolist()
    for a, b in zip(heads, heads[1:]):
        value[a:b].sort()
    text = np.repeat(np.arange(len(heads) - 1), np.diff(first))
    head = np.ones(len(value), bool)
    head[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(head)
    return text[at], value[at], np.diff(np.append(at, len(value)))


def keys(value: np.ndarray, step: np.ndarray) -> np.ndarray:
    """What a signature holds for a term whose count reaches a step."""
    return mix(value + step.astype(U64) * U64(0x9E3779B97F4A7C15))


def probes(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slices of a key in signatures of ``bits`` (a power of two)."""
    out = []
    for _ in range(PROBES):
        key = mix(key + U64(0xD1B54A32D192ED03))
        out.append((key & U64(bits - 1)).astype(np.int64))
    return out


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text): the 128-bit name of a row's id and text beside it."""
    text, own = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), F.xxhash64(text, own).alias("k1"), F.xxhash64(F.lit(1), text, own).alias("k2"), text.alias("text"))


class Blocks:
    """Documents of one signature width until their bitmaps fill a block."""

    def __init__(self, bits: int):
        self.bits, self.docs, self.rows = bits, [], []
        self.most = max(8, min(BLOCK_DOCS, BLOCK * 8 // bits))

    def add(self, doc: tuple, key: np.ndarray) -> dict | None:
        self.rows.append(np.unique(np.concatenate(probes(key, self.bits))))
        self.docs.append(doc)
        return self.flush() if len(self.docs) == self.most else None

    def flush(self) -> dict:
        of = np.repeat(np.arange(len(self.rows)), [len(r) for r in self.rows])
        filled = np.zeros((self.bits, len(self.rows)), bool)
        filled[np.concatenate(self.rows), of] = True
        ids, k1, k2, n = zip(*self.docs)
        row = {"bits": self.bits, "ids": ids, "k1": k1, "k2": k2, "n": n, "slices": np.packbits(filled, axis=1).tobytes()}
        self.docs, self.rows = [], []
        return row


def index(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: blocks of documents with their bit slices, and counts of documents by term."""
    ship(docs.sparkSession)

    def run(batches):
        schema = pa.schema([(n, t) for n, t in zip(
            ("bits", "ids", "k1", "k2", "n", "slices", "terms", "df"),
            (pa.int32(), *[pa.list_(pa.int64())] * 4, pa.binary(), *[pa.list_(pa.int64())] * 2),
        )])
        open_blocks: dict[int, Blocks] = {}
        met, size = [], 0

        def sent(rows):
            return pa.RecordBatch.from_pylist([{f: r.get(f) for f in schema.names} for r in rows], schema=schema)

        def met_terms():
            term, df = np.unique(np.concatenate(met), return_counts=True)
            arrays = [lists(x, np.array([0, len(x)])) if x is not None else None for x in (term.view(np.int64), df.astype(np.int64))]
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in list(schema)[:6]], *arrays], schema=schema)

        for batch in slices(batches, "text"):
            hashes, first = terms(batch.column("text"))
            text, value, tf = counts(hashes, first)
            steps = np.searchsorted(STEPS, tf, side="right")
            step = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
            key = keys(np.repeat(value, steps), step)
            ends = np.searchsorted(np.repeat(text, steps), np.arange(batch.num_rows + 1))
            ids, k1, k2 = (batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2"))
            full = []
            for i in np.flatnonzero(np.diff(first)).tolist():
                own = key[ends[i] : ends[i + 1]]
                bits = max(LEAST_BITS, 1 << (PER_KEY * len(own) - 1).bit_length())
                if bits not in open_blocks:
                    open_blocks[bits] = Blocks(bits)
                row = open_blocks[bits].add((ids[i], k1[i], k2[i], int(first[i + 1] - first[i])), own)
                if row:
                    full.append(row)
            if full:
                yield sent(full)
            if len(value):
                met.append(value)
                size += len(value)
            if size >= TERM_ROW:
                yield met_terms()
                met, size = [], 0
        for block in open_blocks.values():
            if block.docs:
                yield sent([block.flush()])
        if met:
            yield met_terms()

    return named(docs).mapInArrow(run, BLOCKS)


@dataclass
class Queries:
    """A block of queries: their terms by number, with repeats, the terms' hashes and weights."""

    number: list[int]  # of each query
    at: np.ndarray  # of all queries' terms, one query after the other
    heads: np.ndarray  # where each query begins in ``at``
    hashes: np.ndarray
    docs: int = 0
    terms: int = 0
    weight: np.ndarray | None = None

    def damping(self, n: np.ndarray) -> np.ndarray:
        return 100 - 75 + (75 * n * self.docs) // self.terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """The queries ``(number, text)`` that have terms, in blocks of bounded size."""
    number, found, size = [], [], 0
    for row in items.select("number", "text").toLocalIterator():
        own, _ = terms(pa.array([row.text], pa.string()))
        if not len(own):
            continue
        if found and size + len(own) > QUERY_TERMS:
            yield _block(number, found)
            number, found, size = [], [], 0
        number.append(row.number)
        found.append(own)
        size += len(own)
    if found:
        yield _block(number, found)


def _block(number: list[int], found: list[np.ndarray]) -> Queries:
    hashes, at = np.unique(np.concatenate(found), return_inverse=True)
    return Queries(number, at, np.cumsum([0, *[len(f) for f in found[:-1]]]), hashes)


def weigh(queries: Queries, table: DataFrame) -> None:
    """Weights of a block's terms from the index: the driver gets one number per term at most."""
    total = table.filter("bits IS NOT NULL").agg(F.sum(F.size("n")).alias("d"), F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)")).alias("l"))
    total = total.first()
    queries.docs, queries.terms = total.d or 0, total.l or 0
    sent = table.sparkSession.sparkContext.broadcast(queries.hashes)

    def work(batch):
        want = sent.value
        term = pa.concat_arrays([batch.column("terms")]).flatten().to_numpy(zero_copy_only=False).view(U64)
        df = pa.concat_arrays([batch.column("df")]).flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(want, term)
        at[at == len(want)] = 0
        n = np.bincount(at, weights=np.where(want[at] == term, df, 0), minlength=len(want)).astype(np.int64)
        some = np.flatnonzero(n)
        return {"at": some, "df": n[some]}

    parts = mapped(table.filter("terms IS NOT NULL").select("terms", "df"), "at long, df long", work)
    found = parts.groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(queries.hashes), np.int64)
    df[found.column("at").to_numpy()] = found.column("df").to_numpy()
    queries.weight = np.array([math.floor(1000 * math.log((2 * queries.docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def bounds(queries: Queries, bits: int, slices_: bytes, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, upper bounds [query, document]) of a block, some documents at a time."""
    table = np.frombuffer(slices_, np.uint8).reshape(bits, -1)
    wide = max(1, CELLS // len(queries.at) // 8)  # bytes of a bitmap at a time
    for a in range(0, table.shape[1], wide):
        docs = n[a * 8 : (a + wide) * 8]
        part = table[:, a : a + wide]
        reached = np.zeros((len(queries.hashes), len(docs)), np.uint8)
        rows, left = np.arange(len(queries.hashes)), None
        for step in range(len(STEPS)):
            p = probes(keys(queries.hashes[rows], np.full(len(rows), step)), bits)
            hit = part[p[0]]
            for other in p[1:]:
                hit &= part[other]
            hit = hit if left is None else hit & left
            some = hit.any(axis=1)
            rows, left = rows[some], hit[some]
            if not len(rows):
                break
            reached[rows] += np.unpackbits(left, axis=1, count=len(docs))
        term, doc = np.nonzero(reached)
        most = np.append(STEPS, STEPS[-1] * 2)[reached[term, doc]] - 1
        value = np.zeros(reached.shape, np.int64)
        value[term, doc] = queries.weight[term] * impact(most, queries.damping(docs)[doc])
        yield a * 8, np.add.reduceat(value[queries.at], queries.heads, axis=0)


LAST = np.iinfo(np.int64).max  # stands for a missing doc_id when ids are compared
CANDIDATES = "number long, bound long, doc_id long, k1 long, k2 long"


def search(table: DataFrame, queries: Queries, threshold: np.ndarray | None, first: int) -> DataFrame:
    """Candidates: per task each query's documents of the ``first`` highest bounds, or all that reach the threshold.

    ``threshold [query, 2]`` holds a score and the id up to which an equal bound is enough.
    """
    sent = table.sparkSession.sparkContext.broadcast((queries, threshold))
    ship(table.sparkSession)

    def run(batches):
        queries, threshold = sent.value
        best = [np.zeros((0, 4), np.int64)] * len(queries.number)

        def rows(number, found):
            ids = pa.array(found[:, 1], mask=found[:, 1] == LAST)
            columns = [pa.array(number), pa.array(found[:, 0]), ids, pa.array(found[:, 2]), pa.array(found[:, 3])]
            return pa.RecordBatch.from_arrays(columns, names=["number", "bound", "doc_id", "k1", "k2"])

        for batch in batches:
            for r in range(batch.num_rows):
                own = [batch.column(c)[r].values for c in ("ids", "k1", "k2", "n")]
                ids, k1, k2, n = (x.fill_null(LAST).to_numpy(zero_copy_only=False) for x in own)
                for at, upper in bounds(queries, batch.column("bits")[r].as_py(), batch.column("slices")[r].as_py(), n):
                    here = slice(at, at + upper.shape[1])
                    if threshold is not None:
                        reach, upto = threshold[:, :1], threshold[:, 1:]
                        q, d = np.nonzero((upper > 0) & ((upper > reach) | (upper == reach) & (ids[here] <= upto)))
                        if len(q):
                            found = np.stack((upper[q, d], ids[here][d], k1[here][d], k2[here][d]), axis=1)
                            yield rows(np.array(queries.number)[q], found)
                        continue
                    for q in range(len(upper)):
                        own = upper[q]
                        kept = best[q]
                        least = kept[-1, 0] if len(kept) == first else 1
                        d = np.flatnonzero(own >= least)
                        if len(d):
                            more = np.stack((own[d], ids[here][d], k1[here][d], k2[here][d]), axis=1)
                            more = np.concatenate((kept, more))
                            best[q] = more[np.lexsort((more[:, 1], -more[:, 0]))[:first]]
        if threshold is None:
            for q, found in enumerate(best):
                if len(found):
                    yield rows(np.full(len(found), queries.number[q]), found)

    return table.filter("bits IS NOT NULL").select("bits", "ids", "k1", "k2", "n", "slices").mapInArrow(run, CANDIDATES)


def rescored(docs: DataFrame, candidates: DataFrame, queries: Queries) -> DataFrame:
    """(number, doc_id, score): exact scores above 0 of the candidates, from their whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(queries)
    wanted = candidates.groupBy("k1", "k2").agg(F.collect_set("number").alias("numbers"))
    rows = named(docs).join(wanted, ["k1", "k2"]).select("doc_id", "text", "numbers")

    def make():
        queries = sent.value
        of = {number: q for q, number in enumerate(queries.number)}
        ends = np.append(queries.heads, len(queries.at))

        def work(batch):
            hashes, first = terms(batch.column("text"))
            text, value, tf = counts(hashes, first)
            heads = np.searchsorted(text, np.arange(batch.num_rows + 1))
            number, doc, score = [], [], []
            for i, (own_id, numbers) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("numbers").to_pylist())):
                a, b = heads[i], heads[i + 1]
                at = np.searchsorted(value[a:b], queries.hashes)
                at[at == b - a] = 0
                found = np.where(value[a:b][at] == queries.hashes, tf[a:b][at], 0)
                m = queries.damping(np.array([first[i + 1] - first[i]]))
                each = queries.weight * impact(found, m)
                for x in numbers:
                    q = of[x]
                    number.append(x)
                    doc.append(own_id)
                    score.append(int(each[queries.at[ends[q] : ends[q + 1]]].sum()))
            return {"number": pa.array(number, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())}

        return work

    return map_slices(rows, "number long, doc_id long, score long", "text", make).filter("score > 0")


def ranked(scored: DataFrame, first: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)


def top_documents(docs: DataFrame, items: DataFrame, first: int = FIRST, table: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``first`` documents by score; ``table`` is a stored index of ``docs``."""
    if table is None:
        table = cut_lineage(index(docs), "slices")
    items = items.select(F.col("item_id"), "text").withColumn("number", F.monotonically_increasing_id())
    items = cut_lineage(items, "queries")
    out = None
    for queries in query_blocks(items):
        weigh(queries, table)
        if not queries.terms:
            break
        best = search(table, queries, None, first)
        order = Window.partitionBy("number").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= first)
        known = ranked(rescored(docs, cut_lineage(best, "highest"), queries), first).filter(F.col("rank") == first)
        threshold = np.zeros((len(queries.number), 2), np.int64)
        place = {number: q for q, number in enumerate(queries.number)}
        for row in known.select("number", "score", "doc_id").collect():  # one row per query of the block at most
            threshold[place[row.number]] = row.score, LAST if row.doc_id is None else row.doc_id
        reached = cut_lineage(search(table, queries, threshold, first), "candidates")
        own = cut_lineage(ranked(rescored(docs, reached, queries), first), "ranked")
        out = own if out is None else out.union(own)
    if out is None:
        schema = "number long, doc_id long, score long, rank int"
        out = docs.sparkSession.createDataFrame([], schema)
    return out.join(items.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
