"""Near duplicates by SuperMinHash signatures, banding, exact verification and grouping.

A document's set holds its distinct ``words``-word shingles of the lower-cased
text (A-Z only); a shorter text is one shingle, an empty or NULL text has none
and is linked with nothing.  Two documents are linked when ``100 * intersection
>= percent * union`` of the full sets.  Rows with equal sets are one class and
travel as one row.  Each row stands for itself: a repeated ``doc_id`` gives
repeated rows.  A row without ``doc_id`` is linked with nothing, its component
is NULL and it is kept.  Texts of one ``doc_id`` are classes of their own.
Further columns of the input are ignored.  An empty table gives an empty one.
Of equally small ids there is nothing to choose: a component is named by its
smallest ``doc_id``.  A very long text is hashed in pieces; its set is held
whole by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.arrow import lists, map_slices
from lagloom.llm.graph import components
from lagloom.llm.words import U64, Words, mix
from lagloom.sources.writers import cut_lineage

#: 24 bands of 6 slots: a pair at similarity 0.85 shares no band with probability
#: (1 - 0.85 ** 6) ** 24 = 1e-5, at 0.8 with 7e-4, at 0.9 with 7e-9.
SLOTS, ROWS = 144, 6
ELEMENTS = 1 << 17  # shingles whose permutations are held at a time


def super_minhash(text: np.ndarray, value: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures ``[n, slots]`` of the sets ``value`` by ``text`` number (ascending).

    An element draws a permutation of the slots by Fisher-Yates, one position a
    round, and offers ``round + uniform`` to the slot drawn.  The rounds run
    over all elements at once; a text stops after the first round in which
    every slot has an offer, since later offers are larger.
    """
    sig = np.full(n * slots, np.iinfo(np.uint64).max, U64)
    heads = np.searchsorted(text, np.arange(n + 1))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(heads, heads[at] + ELEMENTS, side="right")) - 1)
        _rounds(sig, text[heads[at] : heads[to]], value[heads[at] : heads[to]], slots)
        at = to
    return sig.reshape(n, slots)


def _rounds(sig: np.ndarray, text: np.ndarray, value: np.ndarray, slots: int) -> None:
    order, rows = None, None
    for j in range(slots):
        if not len(text):
            return
        drawn = mix(value + U64((j + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        pick = (drawn & U64(0xFFFFFFFF)).astype(np.int64) % (slots - j) + j
        if j == 0:
            slot = pick
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(text), 1))
                rows = np.arange(len(text))
                order[rows, first] = 0  # the swap of round 0
                order[rows, 0] = first
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, j]
            order[rows, j] = slot
        np.minimum.at(sig, text * slots + slot, U64(j << 56) | (drawn >> U64(8)))
        open_texts = np.unique(text)
        own = sig.reshape(-1, slots)[open_texts]
        done = open_texts[own.max(axis=1) < U64((j + 1) << 56)]
        first = pick if j == 0 else None
        if len(done):
            stay = ~np.isin(text, done)
            text, value = text[stay], value[stay]
            if j == 0:
                first = first[stay]
            else:
                order = order[stay]
                rows = np.arange(len(text))


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots; keys of different bands differ."""
    bands = sig.shape[1] // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (sig.shape[0], bands))
    for r in range(rows):
        key = mix(key + sig[:, r : bands * rows : rows])
    return key


def set_digest(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit digest of each set."""
    size = np.bincount(text, minlength=n)
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(value ^ U64(seed)), dtype=U64)))
        ends = np.cumsum(size)
        out.append(total[ends] - total[ends - size])
    return size, out[0].view(np.int64), out[1].view(np.int64)


def signatures(docs: DataFrame, words: int, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, d1, d2, bands) of every row."""

    def make():
        def work(batch):
            w = Words(batch.column("text"))
            n = batch.num_rows
            text, value = w.distinct_shingles(words)
            size, d1, d2 = set_digest(text, value, n)
            keys = band_keys(super_minhash(text, value, n, slots), rows).view(np.int64)
            return {
                "doc_id": batch.column("doc_id"), "k1": batch.column("k1"), "k2": batch.column("k2"), "n_shingles": size.astype(np.int64), "d1": d1, "d2": d2,
                "bands": lists(keys.ravel(), np.arange(n + 1) * keys.shape[1]),
            }

        return work

    schema = "doc_id long, k1 long, k2 long, n_shingles long, d1 long, d2 long, bands array<long>"
    return map_slices(docs.select(F.col("doc_id").cast("long"), "text", *text_name()), schema, "text", make)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the full sets, as sorted 64-bit hashes."""

    def make():
        def work(batch):
            text, value = Words(batch.column("text")).distinct_shingles(words)
            starts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            return {"id": batch.column("id"), "shingles": lists(value.view(np.int64), starts)}

        return work

    return map_slices(docs, "id long, shingles array<long>", "text", make)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return both.filter(common * 100 >= union * percent).select("a", "b")


def open_pairs(place: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that may reach the threshold, of members of open buckets.

    Only shingles that sets of two components hold count towards an
    intersection, and a set with ``n`` shingles needs ``least = ceil(percent %
    of n)`` of them.  In one order for all, the rarest first, linked sets have a
    shingle in common among the first ``shared - least + 1`` of both, so only
    these are indexed; what follows the first common one in either bounds the
    intersection.
    """
    split = place.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    place = place.join(split.select("key"), "key", "left_semi")
    members = cut_lineage(place.select("id", "component", "n_shingles").distinct(), "open")
    each = members.join(sets, "id").select("id", "component", "n_shingles", F.explode("shingles").alias("shingle"))
    spread = [F.count("*").alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi")]
    abroad = each.groupBy("shingle").agg(*spread).filter("lo < hi").select("shingle", "held")
    order = F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("order")
    own = each.join(abroad, "shingle").groupBy("id", "component", "n_shingles").agg(order)
    own = own.withColumn("shared", F.size("order")).withColumn("least", F.expr(f"(n_shingles * {percent} + 99) DIV 100"))
    first = F.expr("slice(order.shingle, 1, CAST(shared - least + 1 AS INT))")
    rows = own.filter("shared >= least").select("id", "component", "n_shingles", "shared", F.posexplode(first).alias("at", "shingle"))
    rows = rows.select("shingle", "id", "component", "n_shingles", (F.col("shared") - F.col("at")).alias("rest"))
    rows = cut_lineage(rows, "prefixes")
    other = rows.toDF("shingle", "id2", "with", "size2", "rest2")
    met = (F.col("id") < F.col("id2")) & (F.col("component") != F.col("with"))
    both = rows.alias("l").join(other.alias("r"), (F.col("l.shingle") == F.col("r.shingle")) & met & fits("rest", "rest2", percent))
    return both.select("id", "id2").distinct().toDF("a", "b")


def fits(mine: str, other: str, percent: int):
    """Whether sets of ``n_shingles`` and ``size2`` may be linked when they share at most ``mine`` and ``other``."""
    most = F.least(mine, other)
    return (F.col("n_shingles") + F.col("size2") - most) * percent <= most * 100


def text_name() -> list:
    """The 128-bit name of a row's text as ``k1`` and ``k2``; NULL and empty texts share theirs."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, star_rounds: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and the name (k1, k2) of its text.

    Buckets are never expanded into all pairs.  In a star round each bucket
    compares its members with one hub; members that reach it need no
    comparison among themselves.  What remains after the rounds, pairs of one
    bucket in different components, is compared wherever a bound on the
    intersection allows a link (``open_pairs``), so none is lost.
    """
    sign = cut_lineage(signatures(docs, words), "signatures")
    least = -(-percent // (100 - percent)) if percent < 100 else 1  # smaller sets are linked with equal ones only
    classes = sign.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("d1", "d2", "n_shingles")
    first = F.min(F.struct("doc_id", "k1", "k2")).alias("first")
    classes = classes.agg(first, F.any_value("bands").alias("bands")).select("d1", "d2", "n_shingles", "first.*", "bands")
    # numbered and stored: one doc_id may have several texts, so it does not name a class
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = classes.filter(F.col("n_shingles") >= least).select("id", "n_shingles", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    full = cut_lineage(full, "full")  # joins with a stored side can split a large bucket
    buckets = cut_lineage(rows.join(full, "key", "left_semi").select("key", "id", "n_shingles"), "buckets")
    texts = docs.select(F.col("doc_id").cast("long"), "text", *text_name())
    members = classes.select("id", "doc_id", "k1", "k2").join(buckets.select("id").distinct(), "id", "left_semi")
    # the ids grow with the corpus: one way to join them at every size
    texts = texts.join(members.hint("merge"), ["doc_id", "k1", "k2"]).select("id", "text")
    sets = cut_lineage(shingle_sets(texts, words), "sets")
    if not sets.groupBy("id").count().filter("count > 1").isEmpty():
        sets = cut_lineage(sets.dropDuplicates(["id"]), "sets")  # of rows that are there twice

    edges = tested = found = None
    for turn in range(star_rounds + 1):
        if found is None:
            place = buckets.withColumn("component", F.col("id"))
        else:
            place = buckets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if turn < star_rounds:
            hub = F.min_by(F.struct("id", "component", "n_shingles"), F.xxhash64("id", F.lit(turn))).alias("hub")
            spread = (F.min("component") < F.max("component")).alias("open")
            hubs = place.groupBy("key").agg(hub, spread).filter("open").select("key", "hub.*")
            hubs = cut_lineage(hubs, "hubs")
            pairs = place.join(hubs.toDF("key", "other", "with", "size"), "key").filter("component <> with")
            pairs = pairs.filter(F.least("n_shingles", "size") * 100 >= F.greatest("n_shingles", "size") * percent)
            pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        else:
            pairs = open_pairs(place, sets, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs, "pairs")
        if pairs.isEmpty():
            continue  # a hub may reach nobody while others of its bucket are still to be compared
        tested = pairs if tested is None else tested.union(pairs)
        more = cut_lineage(linked(pairs, sets, percent), "linked")
        edges = more if edges is None else edges.union(more)
        found = components(edges)

    named = classes.select("id", "d1", "d2", "n_shingles", "doc_id")
    if found is None:
        named = named.withColumn("component_id", F.col("doc_id"))
    else:
        least = found.join(named.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = named.join(found.join(least, "component").select("id", "component_id"), "id", "left")
        named = named.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    named = named.select("d1", "d2", "n_shingles", "component_id")
    out = sign.select("doc_id", "n_shingles", "d1", "d2", "k1", "k2").join(named, ["d1", "d2", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "k1", "k2").select("doc_id", "n_shingles", "component_id", kept, "k1", "k2")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, but one of each group of near duplicates: the one with the smallest doc_id.

    A row goes by its id and text together, so a text stays when only another
    text of the same id goes.  Of repeated rows (same id and text) one stays.
    """
    found = cut_lineage(near_duplicates(docs, words, percent), "near")
    name = F.struct(F.col("doc_id").cast("long"), *text_name())
    own = next(n for n in ("_row", "_row_", "_row__") if n not in docs.columns)
    rows = docs.withColumn(own, name)
    gone = found.filter("NOT kept").select(F.struct("doc_id", "k1", "k2").alias(own)).distinct()
    kept = rows.join(gone, own, "left_anti")
    twice = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("n")).filter("n > 1")
    twice = cut_lineage(twice.select(F.struct("doc_id", "k1", "k2").alias(own)), "twice")
    if not twice.isEmpty():
        once = kept.join(twice, own, "left_semi").dropDuplicates([own])
        kept = kept.join(twice, own, "left_anti").union(once.select(kept.columns))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
