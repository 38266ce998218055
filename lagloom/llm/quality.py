"""Document quality: a Gaussian-kernel ridge on document statistics, calibrated to a probability.

Statistics come from the text alone.  They are standardised, mapped by random
Fourier features, whose inner products approximate a Gaussian kernel, and a
ridge regression on the labels is solved from normal equations that every
partition sums for itself.  Isotonic regression on labelled rows that the ridge
has not seen turns its output into a probability.

Everything sent to the driver has a fixed size: the sums of ``FEATURES`` features
and ``BINS`` bins of ridge outputs, whatever the number of labelled rows.  A NULL or
empty text has all its statistics 0 and is scored like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.arrow import filter_slices, lists, map_slices
from lagloom.llm.words import U64, Words, grams
from lagloom.sources.writers import cut_lineage

FEATURES, SEED, RIDGE, WIDTH, BINS = 256, 7, 1e-3, 4.0, 512

STATISTICS = (
    "log_words", "log_chars", "mean_word", "sd_word", "long_words", "upper", "digits", "punctuation", "symbols",
    "bangs", "pipes", "spaces", "lines", "words_a_line", "short_lines", "capital_words", "upper_words",
    "marked_words", "distinct_words", "distinct_pairs", "top_word", "stops", "commas", "non_ascii",
)


KINDS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ";:'\"()-?", "#$%&*+/<=>@[\\]^_`{}~", "!", "|", " \t", "\n", ".", ",",
)


def _kind_table() -> np.ndarray:
    """The kind of each byte: 0 lower-case letters and the rest, then ``KINDS``, then bytes beyond ASCII."""
    table = np.zeros(256, np.uint8)
    for kind, chars in enumerate(KINDS, 1):
        for c in chars:
            table[ord(c)] = kind
    table[128:] = len(KINDS) + 1
    return table


KIND_OF = _kind_table()


def _repeats(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values of each text, and how often its most frequent one occurs (by 44 bits of the hash)."""
    if not len(text):
        return np.zeros(n), np.zeros(n)
    key = np.sort((text.astype(U64) << U64(44)) | (value >> U64(20)))
    runs = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    owner = (key[runs] >> U64(44)).astype(np.int64)
    top = np.zeros(n)
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    top[owner[heads]] = np.maximum.reduceat(np.diff(np.append(runs, len(key))), heads)
    return np.bincount(owner, minlength=n).astype(float), top


def text_statistics(texts: pa.Array) -> np.ndarray:
    """``[texts, STATISTICS]``, all finite."""
    w = Words(texts)
    n, kinds = len(texts), len(KINDS) + 2
    chars, words = np.diff(w.offsets).astype(float), w.counts.astype(float)
    per_char, per_word = 1 / np.maximum(chars, 1), 1 / np.maximum(words, 1)
    kind = KIND_OF[w.buf]
    place = np.repeat(np.arange(n, dtype=np.int64) * kinds, np.diff(w.offsets)) + kind
    share = (np.bincount(place, minlength=n * kinds).reshape(n, kinds) * per_char[:, None]).T
    text = np.repeat(np.arange(n), w.counts)
    size = w.ends - w.starts
    total = lambda x: np.bincount(text, weights=x, minlength=n) * per_word
    mean = total(size)
    spread = np.sqrt(np.maximum(total(size * size) - mean * mean, 0))
    upper = np.concatenate((np.zeros(1, np.int32), np.cumsum(kind == 1, dtype=np.int32)))
    in_word = upper[w.ends] - upper[w.starts]
    last = kind[w.ends - 1] if len(w.ends) else kind[:0]
    different, top = _repeats(text, w.hashes, n)
    same = text[1:] == text[:-1]
    pairs, _ = _repeats(text[1:][same], grams(w.hashes, 2)[same] if len(text) > 1 else w.hashes[:0], n)
    lines = share[8] * chars + (chars > 0)
    columns = [
        np.log1p(words), np.log1p(chars), mean, spread, total(size > 12), share[1], share[2], share[3] + share[9] + share[10],
        share[4], share[5], share[6], share[7], np.log1p(lines), np.log1p(words / np.maximum(lines, 1)), lines * per_word,
        total(in_word == 1), total((in_word > 1) & (2 * in_word >= size)), total((last >= 4) & (last <= 6)),
        different * per_word, pairs / np.maximum(words - 1, 1), top * per_word, share[9] * chars * per_word,
        share[10] * chars * per_word, share[11],
    ]
    return np.stack(columns, axis=1)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def make():
        def work(batch):
            x = text_statistics(batch.column("text"))
            return {"doc_id": batch.column("doc_id"), "x": lists(x.ravel(), np.arange(len(x) + 1) * x.shape[1])}

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, x array<double>", "text", make)


def matrix(column: pa.Array, width: int = len(STATISTICS)) -> np.ndarray:
    flat = pa.concat_arrays([column]).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


class Kernel:
    """Standardised statistics as cosines of random projections, and a constant."""

    def __init__(self, mean, scale, features: int = FEATURES, seed: int = SEED, width: float = WIDTH):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.w = rng.standard_normal((len(self.mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate((z, np.ones((len(z), 1))), axis=1)


def fit(labelled: DataFrame, ridge: float = RIDGE) -> dict:
    """The model from ``labelled (x, label, fold)``: fold 0 fits the ridge, fold 1 the calibration.

    All labelled rows take part.  Rows with another label than 0 or 1 are left
    out.  Without labelled rows every score is 0.5.
    """
    labelled = labelled.filter("label IN (0, 1) AND x IS NOT NULL")
    d = len(STATISTICS)
    sums = [F.sum(F.get("x", F.lit(i))) for i in range(d)] + [F.sum(F.get("x", F.lit(i)) ** 2) for i in range(d)]
    row = labelled.agg(F.count("*"), *sums).first()
    n = row[0]
    if not n:
        return {"kernel": None}
    mean = np.array(row[1 : d + 1]) / n
    scale = np.sqrt(np.maximum(np.array(row[d + 1 :]) / n - mean**2, 0))
    kernel = Kernel(mean, np.where(scale > 1e-9, scale, 1.0))
    gram = _normal_equations(labelled.filter("fold = 0"), kernel)
    a, y = gram[:, :-1], gram[:, -1]
    weights = np.linalg.solve(a + ridge * max(a[-1, -1], 1.0) * np.eye(len(a)), y)
    raw = _scored(labelled.filter("fold = 1").select("x", "label"), kernel, weights)
    place = F.floor(F.least(F.greatest((F.col("raw") + 0.5) / 2, F.lit(0.0)), F.lit(1.0)) * (BINS - 1)).cast("int")
    bins = raw.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    bins = bins.orderBy("bin").collect()
    return {"kernel": kernel, "weights": weights, "steps": isotonic([(r.bin, r.n, r.ones) for r in bins])}


def _normal_equations(labelled: DataFrame, kernel: Kernel) -> np.ndarray:
    """Rows of Z'[Z y]: each partition sends one array per row, and the arrays of a row are added in one place."""
    width = len(kernel.b) + 1

    def partial(batches):
        total = np.zeros((width, width + 1))
        for batch in batches:
            z = kernel(matrix(batch.column("x")))
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.concatenate((z, y[:, None]), axis=1)
        if total[-1, -2]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), lists(total.ravel(), np.arange(width + 1) * (width + 1))],
                names=["i", "v"],
            )

    parts = labelled.select("x", F.col("label").cast("double")).mapInArrow(partial, "i int, v array<double>")
    each = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    table = each.toPandas()  # width * (width + 1) numbers
    out = np.zeros((width, width + 1))
    out[table["i"], table["j"]] = table["v"]
    return out


def _scored(rows: DataFrame, kernel: Kernel, weights: np.ndarray) -> DataFrame:
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name != "x"]

    def run(batches):
        for batch in batches:
            raw = kernel(matrix(batch.column("x"))) @ weights
            kept = [batch.column(name) for name, _ in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(raw)], names=[*[n for n, _ in fields], "raw"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields) + ", raw double")


def isotonic(bins: list[tuple[int, int, float]]) -> list[tuple[int, float]]:
    """Pool adjacent violators: (first bin, share of ones), rising; shares are smoothed by half a row each way."""
    blocks: list[list[float]] = []
    for start, n, ones in bins:
        blocks.append([start, n + 1.0, ones + 0.5])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, m, k = blocks.pop()
            blocks[-1][1] += m
            blocks[-1][2] += k
    return [(int(b[0]), b[2] / b[1]) for b in blocks]


def predicted(x: np.ndarray, model: dict) -> np.ndarray:
    """Calibrated scores of rows of statistics."""
    if model["kernel"] is None or not model["steps"]:
        return np.full(len(x), 0.5)
    at, share = (np.array(c) for c in zip(*model["steps"]))
    place = np.floor(np.clip((model["kernel"](x) @ model["weights"] + 0.5) / 2, 0, 1) * (BINS - 1))
    return share[np.clip(np.searchsorted(at, place, side="right") - 1, 0, len(at) - 1)]


def score(stats: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted) of ``stats (doc_id, x)``."""

    def run(batches):
        for batch in batches:
            value = pa.array(predicted(matrix(batch.column("x")), model))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), value], names=["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, fold) of documents that are not held out; of several labels of one the largest."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).dropna()
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.withColumn("fold", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 2).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Labels of rows that are held out are never read.  Rows without ``doc_id``
    are scored, and count as not held out.
    """
    stats = cut_lineage(statistics(docs), "statistics")
    model = fit(stats.join(known_labels(labels, label), "doc_id").select("x", "label", "fold"))
    flag = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return score(stats, model).select("doc_id", flag, "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, that are scored 0.5 or more."""
    # statistics are cheaper to compute twice than texts are to move to their labels
    x = statistics(docs).join(known_labels(labels, label).hint("merge"), "doc_id").select("x", "label", "fold")
    model = fit(cut_lineage(x, "labelled"))

    def make():
        def work(batch):
            return predicted(text_statistics(batch.column("text")), model) >= 0.5

        return work

    return filter_slices(docs, "text", make)
