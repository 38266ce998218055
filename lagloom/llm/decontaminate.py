"""Test items found in documents by size-partitioned MinHash containment search.

An item's set holds its distinct five-word shingles of lower-cased words (A-Z
only); a shorter text is one shingle, an empty or NULL one has none and matches
nothing.  A document contains an item when it holds at least ``percent`` of the
item's set, counted over the whole document.

MinHash estimates a union-relative similarity, which vanishes when a short item
lies in a long document.  So items are partitioned by size, and for items of up
to ``u`` shingles a document is cut into passages of ``2 * u`` shingles that
start every ``u``: an occurrence of the item lies whole in one of them, whose
similarity is then bounded from below whatever the document's length.  Passages
and items get one-permutation MinHash values (a slot and a rank from one hash);
one equal slot makes a candidate, which the exact containment confirms or drops.
Items of at most ``SMALL`` shingles are their own sketch: any of them makes a
candidate.  A larger item that is contained shares no slot with the passage with
a probability of at most 3e-7.

Only items are broadcast, in blocks of at most ``BLOCK`` shingles, and every
block is held against all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.arrow import filter_slices, map_slices
from lagloom.llm.words import U64, Words, mix

SLOTS = 128
BLOCK = 1 << 20  # item shingles of one block: 16 MB of sets and signatures
SMALL, LEAST_SIZE = 16, 32  # the first two partitions: items of up to so many shingles
NONE = np.iinfo(np.uint64).max


def one_permutation(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """MinHash values ``[groups, SLOTS]``; an empty slot holds the largest number."""
    drawn = mix(value ^ U64(0x5851F42D4C957F2D))
    sig = np.full(groups * SLOTS, NONE, U64)
    np.minimum.at(sig, group * SLOTS + (drawn & U64(SLOTS - 1)).astype(np.int64), drawn)
    return sig.reshape(groups, SLOTS)


class Lookup:
    """Owners of keys; a table of key bits turns most strangers away before the search."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._bits(keys)] = True

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(40)).astype(np.int64) & 0xFFFFF

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``keys``, owner) of every match."""
        may = np.flatnonzero(self.seen[self._bits(keys)])
        keys = keys[may]
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        many = hi - lo
        at = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(may, many), self.owner[at]


class Items:
    """Shingle sets and signatures of one block of items, by size partition."""

    def __init__(self, ids: list[int], texts: list[str], words: int):
        self.ids = np.array(ids, dtype=np.int64)
        text, value = Words(pa.array(texts, pa.large_string())).distinct_shingles(words)
        self.size = np.bincount(text, minlength=len(ids))
        self.value, self.item = value, text
        self.lookup = Lookup(value, text)
        sig = one_permutation(text, value, len(ids))
        bound = LEAST_SIZE << np.ceil(np.log2(np.maximum(self.size, 1) / LEAST_SIZE)).clip(0).astype(np.int64)
        bound[self.size <= SMALL] = 1
        small = self.size[self.item] <= SMALL
        self.parts = [(1, Lookup(self.value[small], self.item[small]))] if small.any() else []
        for u in np.unique(bound[bound > 1]):
            own = np.flatnonzero(bound == u)
            keys = sig[own].ravel()
            self.parts.append((int(u), Lookup(keys[keys != NONE], np.repeat(own, SLOTS)[keys != NONE])))

    def candidates(self, text: np.ndarray, inner: np.ndarray, value: np.ndarray) -> np.ndarray:
        """(text, item) pairs with an equal slot in some passage."""
        found = [np.zeros((0, 2), np.int64)]
        for u, lookup in self.parts:
            if u == 1:
                at, item = lookup(value)
                found.append(np.stack((text[at], item), axis=1))
                continue
            step = inner // u
            head = np.ones(len(text), bool)
            head[1:] = (text[1:] != text[:-1]) | (step[1:] != step[:-1])
            of = text[head]
            sig = one_permutation(np.cumsum(head) - 1, value, len(of))
            same = of[1:] == of[:-1]  # a passage is a stretch of u shingles and the next one of its text
            sig[:-1][same] = np.minimum(sig[:-1][same], sig[1:][same])
            at, item = lookup(sig.ravel())
            found.append(np.stack((of[at // SLOTS], item), axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def common(self, value: np.ndarray) -> np.ndarray:
        """Shingles of every item that are in the set ``value``."""
        return np.bincount(self.lookup(value)[1], minlength=len(self.ids))


def contained(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_common) of every document that contains an item.

    Rows are whole: repeated documents and items give repeated pairs, a NULL
    id stays NULL.  Further columns are ignored.
    """
    schema = "doc_id long, item_id long, n_item long, n_common long"
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for ids, texts in _blocks(items):
        block = docs.sparkSession.sparkContext.broadcast((ids, texts))
        part = map_slices(docs, schema, "text", _search(block, words, percent))
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def uncontaminated(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    for ids, texts in _blocks(items):
        block = docs.sparkSession.sparkContext.broadcast((ids, texts))
        search = _search(block, words, percent)

        def make(search=search):
            find = search()

            def work(batch):
                found = find(batch.select(["text"]).append_column("doc_id", pa.array(range(batch.num_rows), pa.int64())))
                clean = np.ones(batch.num_rows, bool)
                if found is not None:
                    clean[found["doc_id"].to_numpy()] = False
                return clean

            return work

        docs = filter_slices(docs, "text", make)
    return docs


def _blocks(items: DataFrame):
    """Items in blocks of bounded size; rows pass the driver one block at a time."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").toLocalIterator():
        if size and size + len(row.text) // 2 > BLOCK:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text) // 2 + 1
    if ids:
        yield ids, texts


def _search(block, words: int, percent: int):
    def make():
        ids, texts = block.value
        items = Items([-1 if i is None else i for i in ids], texts, words)
        nulls = np.array([i is None for i in ids])

        def work(batch):
            w = Words(batch.column("text"))
            text, value = w.shingles(words)
            heads = np.searchsorted(text, np.arange(batch.num_rows + 1))
            pairs = items.candidates(text, np.arange(len(text)) - heads[text], value)
            if not len(pairs):
                return None
            rows, item, common = [], [], []
            for t in np.unique(pairs[:, 0]):
                own = pairs[pairs[:, 0] == t, 1]
                have = items.common(np.unique(value[heads[t] : heads[t + 1]]))[own]
                keep = have * 100 >= items.size[own] * percent
                rows += [t] * int(keep.sum())
                item.append(own[keep])
                common.append(have[keep])
            item, common = np.concatenate(item), np.concatenate(common)
            return {
                "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                "item_id": pa.array(items.ids[item], mask=nulls[item]),
                "n_item": items.size[item], "n_common": common,
            }

        return work

    return make
