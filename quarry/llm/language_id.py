"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is trained from a bounded sample of labelled rows (``TRAIN_ROWS`` for each label, chosen by
hash, whole texts); everything else covers all rows. The sample is cut and counted in Spark: what reaches the driver is a row for each label, and for each bucket
that a label has, whatever the texts' lengths and however often a row is repeated. Labels are languages, a small closed set; each takes 128 KB of the matrix.
Log-probabilities are fixed-point integers, so a score doesn't depend on the order of summing or on how rows fall into batches. The matrix is a broadcast variable.

A text is accepted if its best label leads the next one and fits it: the mean log-probability of its n-grams isn't far below the mean that the
label's training rows have when each is scored without itself. The allowance widens for short texts, whose means scatter.

Defined cases. A null or empty text, and one without a letter, has language ``und`` and is rejected. Ties go
to the label that sorts first. A label that is null or blank trains nothing; without any label everything is ``und``, and rejected. Texts are
scored whole, at any length. A null ``doc_id`` is kept as null, and such a row doesn't train. Repeated rows give repeated results. An empty table gives an empty
result. Other columns pass through ``keep_identified`` as they are, whatever their names; where there is no column ``lang``, it is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import textkit
from quarry.llm.common import materialize

SIZES = (2, 3)
BUCKETS = 1 << 15
#: At most so many rows of each label train the model.
TRAIN_ROWS = 400
#: Nats by which the best label must lead the next one.
MIN_MARGIN = 0.5
#: Nats an n-gram by which a text may lie below its label's level, and what is added to it, divided by the square root of the n-grams.
FIT, FIT_SHORT = 2.0, 8.0
SCALE = 1 << 16
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray  # [labels, BUCKETS] fixed-point log-probabilities
    levels: np.ndarray | None = None  # [labels] mean log-probability of an n-gram of a row that didn't train; None accepts any fit


def _code_points(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets in characters, code points) with each character that can't be a letter turned into a blank."""
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    letter = (points >= 192) | ((points >= 97) & (points <= 122)) | ((points >= 65) & (points <= 90)) | (points == 39)
    return lead[offsets], np.where(letter, points, np.uint32(32))


def grams(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram with a letter in it, rows ascending for each size."""
    at, points = _code_points(offsets, raw)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    buckets, rows = [], []
    for n in SIZES:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.full(m, n * 0x9E3779B1, dtype=np.uint64)
        some = np.zeros(m, dtype=bool)
        for j in range(n):
            part = points[j : j + m]
            h = (h ^ part) * np.uint64(0x100000001B3)
            some |= part != 32
        some &= row[:m] == row[n - 1 :]
        buckets.append(((h ^ (h >> np.uint64(29))) & np.uint64(BUCKETS - 1)).astype(np.int64)[some])
        rows.append(row[:m][some])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(rows)


def _level_sums(texts: pa.Array, total: np.ndarray) -> tuple[int, int]:
    """(sum of fixed-point log-probabilities, n-grams) of ``texts``, each scored by the counts ``total`` without its own."""
    found = n = 0
    for a, b, offsets, raw in textkit.blocks(texts, lower=True):
        bucket, row = grams(offsets, raw)
        key, own = np.unique(row * BUCKETS + bucket, return_counts=True)
        rest = total.sum() - np.bincount(row, minlength=b - a)
        found += int(np.round(own * np.log((total[key % BUCKETS] - own + 0.5) / (rest[key // BUCKETS] + 0.5 * BUCKETS)) * SCALE).astype(np.int64).sum())
        n += len(bucket)
    return found, n


def _by_label(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    labels = batch.column(0)
    for label in sorted(set(labels.to_pylist())):
        yield label, batch.column(1).filter(pc.equal(labels, label))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of the n-grams of (lang, text)."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, texts in _by_label(batch):
            total = totals.setdefault(label, np.zeros(BUCKETS, dtype=np.int64))
            for _, _, offsets, raw in textkit.blocks(texts, lower=True):
                total += np.bincount(grams(offsets, raw)[0], minlength=BUCKETS)
    for label, total in totals.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], ["lang", "bucket", "n"])


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, text) of at most ``rows`` rows of each value of ``lang``, those with the least hash of ``doc_id``.

    A threshold on the hash, from a count of each label's rows, leaves about twice as many; the order of (hash, doc_id, text) then decides, in Spark.
    """
    labelled = docs.where("lang is not null and trim(lang) <> '' and text is not null and doc_id is not null").select("lang", "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    # the least hash is always in, so that a label whose rows share a doc_id has some
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()
    pick = F.lit(False)
    for r in counts:
        pick = pick | ((F.col("lang") == r["lang"]) & (F.col("h") <= max(r["least"], int(min(1.0, 2.0 * rows / r["n"]) * (1 << 30)))))
    order = W.partitionBy("lang").orderBy("h", "doc_id", "text")
    return labelled.where(pick).withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).select("lang", "text")


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on ``training_rows``."""
    sample = materialize(training_rows(docs, rows), "language-sample")
    totals: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        totals.setdefault(r["lang"], np.zeros(BUCKETS, dtype=np.int64))[r["bucket"]] = r["n"]
    labels = sorted(totals)
    if not labels:
        return Model((), np.zeros((0, BUCKETS), dtype=np.int32), np.zeros(0))
    sent = docs.sparkSession.sparkContext.broadcast(totals)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(label, *_level_sums(texts, sent.value[label])) for label, texts in _by_label(batch) if label in sent.value]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["lang", "s", "n"])

    means = {r["lang"]: r["s"] / SCALE / r["n"] for r in sample.mapInArrow(levels, "lang string, s long, n long").groupBy("lang").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    weights = [np.round(np.log((totals[x] + 0.5) / (totals[x].sum() + 0.5 * BUCKETS)) * SCALE).astype(np.int32) for x in labels]
    return Model(tuple(labels), np.array(weights), np.array([means[x] for x in labels]))


def classify(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(label, margin in nats, n-grams) of each text."""
    return _judge(model, texts)[:3]


def _judge(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(label, margin in nats, n-grams, whether they fit the label) of each text."""
    names, margins, sizes, fits = [], [], [], []
    for a, b, offsets, raw in textkit.blocks(texts, lower=True):
        bucket, row = grams(offsets, raw)
        n = np.bincount(row, minlength=b - a)
        if not len(model.labels):
            names += [UNKNOWN] * (b - a)
            margins.append(np.zeros(b - a))
            sizes.append(n)
            fits.append(np.zeros(b - a, dtype=bool))
            continue
        # exact: sums of integers below 2**53
        scores = np.stack([np.bincount(row, weights=w[bucket], minlength=b - a) for w in model.weights])
        best = np.argmax(scores, axis=0)
        top = np.sort(scores, axis=0)
        margin = (top[-1] - top[-2]) / SCALE if len(scores) > 1 else -top[-1] / SCALE
        names += [model.labels[k] if m else UNKNOWN for k, m in zip(best, n)]
        margins.append(np.where(n > 0, margin, 0.0))
        sizes.append(n)
        some = np.maximum(n, 1)
        fits.append((model.levels is None) | (top[-1] / SCALE / some >= (0.0 if model.levels is None else model.levels[best]) - FIT - FIT_SHORT / np.sqrt(some)))
    empty = np.zeros(0)
    return names, np.concatenate(margins or [empty]), np.concatenate(sizes or [empty]).astype(np.int64), np.concatenate(fits or [empty]).astype(bool)


def identify(docs: DataFrame, model: Model | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, language, margin, grams, accepted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, margin, n, fits = _judge(sent.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.round(margin, 6)), pa.array(n), pa.array((n > 0) & (margin >= min_margin) & fits)], ["doc_id", "language", "margin", "grams", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(textkit.releasing(run), "doc_id long, language string, margin double, grams long, accepted boolean")


def keep_identified(docs: DataFrame, model: Model | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with ``lang`` set to it; other columns as they were."""
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, margin, n, fits = _judge(sent.value, batch.column(text))
            arrays = list(batch.columns)
            arrays[lang] = pa.array(names, pa.string()).cast(batch.schema.field(lang).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array((n > 0) & (margin >= min_margin) & fits))

    return docs.mapInArrow(textkit.releasing(run), docs.schema)
