"""Phrase collocations by the stripes pattern: a prefix keys an associative counter of its next words.

Texts are lower-cased (A-Z only) and cut into pieces at ``.,;:!?`` and
``\\x0A-\\x0D``; a word is a run of characters other than space and tab.  All
counts are per language, NULL being ``und``.

Level by level, a task counts the words that follow each prefix of ``k - 1``
words in its slice of texts and sends one stripe per prefix; stripes of a prefix
are merged element by element.  The merged stripe gives three things at once:
its entries count the phrases of ``k`` words, its total (entries plus the
occurrences without a counted next word) counts the prefix, and its largest
entry tells whether an extension to the right subsumes the prefix.  Only prefixes and
next words that can make a phrase of ``least`` occurrences are counted: both the
first and the last ``k - 1`` words must have reached it, which a Bloom filter of
fixed size tells; what it lets through by mistake is counted and dropped.

Stripes travel in bundles by a hash of their prefix, and the number of bundles grows
with the words.  A stripe of a prefix that makes a thousandth of all words is split by next word
over several, so no task merges a hot prefix alone; there are at most a thousand
such prefixes.  Words travel as 64-bit hashes; the table of distinct words
proves that no two of them share one, otherwise another hash function is taken.
Scores are exact (38 digits).

NULL and empty texts have no words.  ``doc_id`` is not used, repeated rows count
as often as they are there, further columns are ignored.  A long text is one
slice of its own.  Ties go by count, then by the phrase's bytes.  An empty table has
no phrases.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.arrow import lists, map_slices
from lagloom.llm.bits import bloom, held
from lagloom.llm.words import U64, grams, mix, text_buffer, word_hashes, word_spans
from lagloom.sources.writers import cut_lineage

LEAST, MOST_WORDS, FIRST = 100, 5, 2000
SLICE = 1 << 22  # text bytes whose stripes are merged before they move
HOT, PARTS = 1000, 64
BUNDLE = 1 << 24  # bytes of entries that meet in a part, at most about

CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", 10, 11, 12, 13]] = True
LOW = np.arange(256, dtype=np.uint8)
LOW[ord("A") : ord("Z") + 1] += 32


class Split:
    """The words of a batch: hashes, language number, and whether the next word follows in the same piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        raw, offsets = text_buffer(batch.column("text"))
        self.buf = LOW[raw]
        cut = CUT[raw]
        self.starts, self.ends, first = word_spans(np.where(cut, np.uint8(32), self.buf), offsets)
        self.hashes = word_hashes(self.buf, self.starts, self.ends, False, seed)
        piece = np.cumsum(cut, dtype=np.int32)[self.starts] if len(raw) else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.follows = (owner[1:] == owner[:-1]) & (piece[1:] == piece[:-1])
        coded = pa.concat_arrays([batch.column("lang").cast(pa.string())]).dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy()[owner].astype(np.int64) if len(owner) else np.zeros(0, np.int64)
        self.of_lang = np.array([lang_hash(x) for x in self.names], U64)

    def phrases(self, k: int) -> np.ndarray:
        """Hash of language and the ``k`` words from each word on."""
        own = grams(self.hashes, k)
        return mix(own + self.of_lang[self.lang[: len(own)]]) if len(own) else own

    def within(self, k: int) -> np.ndarray:
        """Whether the ``k`` words from each word on lie in one piece."""
        n = max(len(self.hashes) - k + 1, 0)
        out = np.ones(n, bool)
        for j in range(k - 1):
            out &= self.follows[j : j + n]
        return out


def lang_hash(lang: str) -> int:
    return zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, word, hash, n): the stripes of the empty prefix, merged."""

    def make():
        def work(batch):
            s = Split(batch, seed)
            if not len(s.hashes):
                return None
            known, local = np.unique(s.hashes, return_inverse=True)
            key, index, n = np.unique(s.lang * len(known) + local, return_index=True, return_counts=True)
            data = s.buf.tobytes()
            spans = zip(s.starts[index].tolist(), s.ends[index].tolist())
            names = pa.array(s.names).take(pa.array(s.lang[index]))
            return {"lang": names, "word": [data[a:b].decode() for a, b in spans], "hash": s.hashes[index].view(np.int64), "n": n}

        return work

    parts = map_slices(texts, "lang string, word string, hash long, n long", "text", make, SLICE)
    return parts.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def stripes(texts: DataFrame, k: int, seed: int, filled: np.ndarray, hot: np.ndarray, parts: int) -> DataFrame:
    """A slice's stripes of prefixes of ``k - 1`` words, in bundles by ``part``, a hash of language and prefix.

    A bundle holds its languages, and as numbers the language and words of each prefix, how
    many entries its stripe has, and the entries (next word, count).  An entry that is marked counts the
    occurrences without a counted next word.
    """
    sent = texts.sparkSession.sparkContext.broadcast((filled, hot))

    def make():
        filled, hot = sent.value

        def work(batch):
            s = Split(batch, seed)
            if len(s.hashes) < k - 1:
                return None
            phrase = s.phrases(k - 1)
            known = s.within(k - 1)
            known[known] = held(filled, phrase[known])
            longer = np.zeros(len(known), bool)
            m = len(known) - 1
            longer[:m] = known[:m] & known[1:] & s.follows[k - 2 : k - 2 + m]
            at = np.flatnonzero(known)
            if not len(at):
                return None
            words, local = np.unique(s.hashes, return_inverse=True)
            size = len(words) + 1
            key = s.lang[at]
            for j in range(k - 1):
                key = np.unique(key * size + local[at + j], return_inverse=True)[1]
            more = longer[at]
            following = np.zeros(len(at), np.int64)
            following[more] = local[at[more] + k - 1] + 1
            # a hot prefix is dealt out by its next words as well
            salt = np.zeros(len(at), U64)
            split = np.isin(phrase[at], hot) & more
            salt[split] = s.hashes[at[split] + k - 1] % U64(PARTS) + U64(1)
            part = (mix(phrase[at] + salt) % U64(parts)).astype(np.int64)
            both, index, n = np.unique((part * (key.max() + 1) + key) * size + following, return_index=True, return_counts=True)
            stripe = both // size
            heads = np.flatnonzero(np.concatenate(([True], stripe[1:] != stripe[:-1])))
            owner = part[index[heads]]
            none = following[index] == 0
            follower = np.where(none, U64(0), s.hashes[np.where(none, 0, at[index] + k - 1)])
            first = at[index[heads]]
            prefix = s.hashes[first[:, None] + np.arange(k - 1)]
            ends = np.append(heads, len(both))
            out = {c: [] for c in ("langs", "lang", "prefix", "size", "next", "none", "n")}
            bundles, begins = np.unique(owner, return_index=True)
            for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(heads)]):
                e = slice(ends[x], ends[y])
                used, lang = np.unique(s.lang[first[x:y]], return_inverse=True)
                out["langs"].append([s.names[i] for i in used.tolist()])
                out["lang"].append(lang.astype(np.int32).tobytes())
                out["prefix"].append(prefix[x:y].tobytes())
                out["size"].append(np.diff(ends[x : y + 1]).astype(np.int32).tobytes())
                out["next"].append(follower[e].tobytes())
                out["none"].append(np.packbits(none[e]).tobytes())
                out["n"].append(n[e].astype(np.int32).tobytes())
            return {"part": bundles, "langs": pa.array(out.pop("langs"), pa.list_(pa.string()))} | {c: pa.array(v, pa.binary()) for c, v in out.items()}

        return work

    schema = "part long, langs array<string>, lang binary, prefix binary, size binary, next binary, none binary, n binary"
    return map_slices(texts, schema, "text", make, SLICE)


def merged(bundles: DataFrame, k: int, least: int) -> DataFrame:
    """Stripes added up element by element: (lang, prefix, total, best, next as (word, n) of those that reach ``least``).

    Stripes without such an entry make no phrase and are left out.
    """

    def work(table: pa.Table) -> pa.Table:
        def flat(name, kind):
            return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])

        size, n = flat("size", np.int32), flat("n", np.int32).astype(np.int64)
        names = sorted({x for own in table.column("langs").to_pylist() for x in own})
        place = {x: i for i, x in enumerate(names)}
        lang = np.concatenate([
            np.array([place[x] for x in own], np.int64)[np.frombuffer(coded.as_py(), np.int32)]
            for own, coded in zip(table.column("langs").to_pylist(), table.column("lang"))
        ])
        prefix = flat("prefix", U64).reshape(-1, k - 1)
        sizes = [len(x.as_py()) // 4 for x in table.column("n")]
        none = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=c) for x, c in zip(table.column("none"), sizes)]).view(bool)
        follower = flat("next", U64)
        # stripes get numbers by their whole prefix, entries then by (stripe, next word)
        order = np.lexsort((*prefix.T, lang))
        new = np.ones(len(order), bool)
        new[1:] = (lang[order][1:] != lang[order][:-1]) | (prefix[order][1:] != prefix[order][:-1]).any(axis=1)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        lead = order[new]
        owner = np.repeat(number, size)
        by = np.lexsort((follower, none, owner))
        head = np.ones(len(by), bool)
        o, f, w = owner[by], follower[by], none[by]
        head[1:] = (o[1:] != o[:-1]) | (f[1:] != f[:-1]) | (w[1:] != w[:-1])
        heads = np.flatnonzero(head)
        count = np.add.reduceat(n[by], heads)
        o, f, w = o[heads], f[heads], w[heads]
        total = np.bincount(owner, weights=n, minlength=len(lead)).astype(np.int64)
        keep = np.flatnonzero(~w & (count >= least))
        kept, begins = np.unique(o[keep], return_index=True)
        ends = np.append(begins, len(keep)).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(f[keep].view(np.int64)), pa.array(count[keep])], names=["word", "n"])
        best = np.maximum.reduceat(count[keep], begins) if len(keep) else np.zeros(0, np.int64)
        rows = prefix[lead[kept]]
        return pa.table({
            "lang": pa.array(names, pa.string()).take(pa.array(lang[lead[kept]])),
            "prefix": lists(rows.ravel().view(np.int64), np.arange(len(kept) + 1) * (k - 1)), "total": total[kept], "best": best,
            "next": pa.ListArray.from_arrays(pa.array(ends), entries),
        })

    schema = "lang string, prefix array<long>, total long, best long, next array<struct<word:long,n:long>>"
    return bundles.groupBy("part").applyInArrow(work, schema)


def phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """What ``Split.phrases`` gives for the phrases ``(lang, words)`` of a batch of one length."""
    words = pa.concat_arrays([batch.column("words")])
    k = len(words[0])
    flat = words.flatten().to_numpy(zero_copy_only=False).view(U64)
    of_lang = np.array([lang_hash(x) for x in batch.column("lang").to_pylist()], U64)
    return mix(grams(flat, k)[:: k] + of_lang)


def counted_phrases(docs: DataFrame, least: int, most_words: int):
    """Totals (lang, n), words (hash, word), phrases (lang, words, n) from ``least`` on, and the stripes they come from."""
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    seed = 0
    while True:
        words = cut_lineage(word_counts(texts, seed), "words")
        if words.groupBy("hash").agg(F.min("word").alias("a"), F.max("word").alias("b")).filter("a <> b").isEmpty():
            break
        seed += 1
    totals = cut_lineage(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    every = totals.agg(F.sum("n")).first()[0] or 0
    level = words.filter(F.col("n") >= least).select("lang", F.array("hash").alias("words"), "n")
    found, structure = level, None
    for k in range(2, most_words + 1):
        if level.isEmpty():
            break
        rare_bound = max(least, every // HOT)
        hot = level.filter(F.col("n") > rare_bound).toArrow()  # a thousand phrases at most
        hot = np.concatenate([phrase_hashes(b) for b in hot.to_batches() if b.num_rows] or [np.zeros(0, U64)])
        bundles = stripes(texts, k, seed, bloom(level, phrase_hashes), hot, 1 + every * 12 // BUNDLE)
        table = cut_lineage(merged(bundles, k, least), f"stripes{k}")
        structure = table if structure is None else structure.union(table)
        level = table.select("lang", "prefix", F.inline("next"))
        level = level.select("lang", F.concat("prefix", F.array("word")).alias("words"), "n")
        found = found.union(level)
    return totals, words.select("hash", "word").distinct(), found, structure


def collocations(
    docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, first: int | None = FIRST, subsume_percent: int = 100
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of two words and more by their weakest cut.

    ``score = floor(1000 * a * n / (l * r))`` of the cut where it is lowest, the
    first such cut on ties.  A phrase inside a longer counted one with ``100 * f(longer) >=
    subsume_percent * a`` is dropped.  ``first`` bounds the rows per language; None gives all.
    """
    totals, words, found, structure = counted_phrases(docs, least, most_words)
    size = F.size("words")
    candidates = found.filter(size >= 2)
    if structure is not None:
        right = structure.groupBy("lang", F.col("prefix").alias("words")).agg(F.max("best").alias("longest"))
        left = found.filter(size >= 3).groupBy("lang", F.expr("slice(words, 2, size(words) - 1)").alias("words"))
        longer = right.union(left.agg(F.max("n").alias("longest"))).filter(F.col("longest") >= least)
        longer = longer.groupBy("lang", "words").agg(F.max("longest").alias("longest"))
        candidates = candidates.join(longer, ["lang", "words"], "left")
        candidates = candidates.filter(f"longest IS NULL OR longest * 100 < n * {subsume_percent}").drop("longest")
    candidates = cut_lineage(candidates.withColumnRenamed("n", "a").withColumn("id", F.monotonically_increasing_id()), "candidates")
    cuts = candidates.select("id", "lang", "words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("cut"))
    parts = found.select("lang", "words", "n")
    cuts = cuts.withColumn("head", F.expr("slice(words, 1, cut)")).withColumn("tail", F.expr("slice(words, cut + 1, size(words) - cut)"))
    cuts = cuts.join(parts.toDF("lang", "head", "l"), ["lang", "head"]).join(parts.toDF("lang", "tail", "r"), ["lang", "tail"])
    wide = "decimal(20,0)"
    cuts = cuts.join(totals, "lang").select(
        "id", "lang", "a", "n", "cut", "l", "r",
        F.expr(f"CAST(CAST(a * 1000 AS {wide}) * CAST(n AS {wide}) DIV (CAST(l AS {wide}) * CAST(r AS {wide})) AS BIGINT)").alias("score"),
    )
    weakest = F.min(F.struct("score", "cut", "l", "r")).alias("w")
    scored = cuts.groupBy("id", "lang", "a", "n").agg(weakest)
    spelled = candidates.select("id", F.posexplode("words").alias("at", "hash")).join(words, "hash")
    spelled = spelled.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelled = spelled.select("id", F.expr("array_join(w.word, ' ')").alias("phrase"))
    out = scored.join(spelled, "id").select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if first is not None:
        # the first rows of shares of a language before those of all of it
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*best)
        out = out.withColumn("in_share", F.row_number().over(share)).filter(F.col("in_share") <= first)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    if first is not None:
        out = out.filter(F.col("rank") <= first)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
