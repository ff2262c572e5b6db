"""Toxicity scores of restored text.

Disguised words are restored first (see deobfuscate) under a character model counted over all
training text; the restored words stand beside the text's own. The score is a logistic regression on
the presence of character five-grams, after runs of one letter are drawn together and everything but
letters and digits is one blank. Its grams are those whose presence goes most significantly with the
label, in a bounded sample of labelled training rows; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, durable, text_of
from .deobfuscate import SYMBOLS, Channel, ends_open, restored, suspicious, trigrams
from .svm import logistic
from .words import mix, slices, spaced

#: Labelled rows learned from, of each label; grams kept.
TOXIC, CLEAN, GRAMS = 3000, 6000, 1024
SPAN, BUCKETS = 5, 1 << 20
CUTOFF = 0.3

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every five-gram; a gram may come more than once, none spans two rows."""
    raw, blanks = spaced(column)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(blanks)), np.diff(np.r_[-1, blanks]))
    code = _FOLD[raw]
    keep = np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]) | (code[1:] >= 128)]
    code, row = np.r_[np.uint8(32), code[keep]].astype(np.uint64), np.r_[-1, row[keep]]
    n = len(code) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = np.zeros(n, np.uint64)
    for k in range(SPAN):
        packed = packed << np.uint64(8) | code[k : k + n]
    # The blank before a row's first word is the end of the row before: take the row from the second character.
    inside = row[1 : 1 + n] == row[SPAN - 1 :]
    return row[1 : 1 + n][inside], (mix(packed[inside]) % np.uint64(BUCKETS)).astype(np.int64)


class Scorer:
    """Applies channel, grams and weights to Arrow text columns."""

    def __init__(self, channel: np.ndarray, buckets: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.channel, self.buckets, self.weights = Channel(channel), buckets, weights
        self.place = np.full(BUCKETS, -1, np.int32)
        if buckets is not None:
            self.place[buckets] = np.arange(len(buckets))

    def restore(self, column: pa.Array) -> pa.Array:
        """Each text with its restored words after it."""
        column = column.fill_null("")
        rows = np.flatnonzero(suspicious(column) | ends_open(column))
        if not len(rows):
            return column
        texts = column.to_pylist()
        for k in rows.tolist():
            texts[k] = f"{texts[k]} \n {restored(texts[k], self.channel)}"
        return pa.array(texts, column.type)

    def present(self, column: pa.Array) -> np.ndarray:
        """0/1 matrix of the kept grams."""
        row, bucket = grams(self.restore(column))
        at = self.place[bucket]
        out = np.zeros((len(column), len(self.buckets)), np.float32)
        out[row[at >= 0], at[at >= 0]] = 1
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weights is None or not len(column):
            return np.zeros(len(column))
        z = self.present(column) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def _channel_counts(training: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for whole in batches:
            for part in slices(whole, "text"):
                total += trigrams(part.column("text"))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in training.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # SYMBOLS ** 3 rows at most
        counts[r["at"]] = r["n"]
    return counts


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, n_toxic: int = TOXIC, n_clean: int = CLEAN) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(channel counts, kept grams' buckets, weights) from the rows not held out.

    The channel's counts cover all of them; labels are taken from at most ``n_toxic`` and ``n_clean``
    rows, those with the smallest hashes of doc_id. An id labelled more than once is toxic if any label
    is; an id with several texts is learned from by one of them.
    """
    docs = docs.select(F.col("doc_id"), text_of().alias("text")).where(crc_mod(F.col("doc_id"), folds) != held)
    channel = _channel_counts(docs)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc_mod(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda label, n: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    taken = durable(first(1, n_toxic).unionByName(first(0, n_clean)).select("doc_id", (F.col("toxic") == 1).alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in taken.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return channel, None, None
    # n_toxic + n_clean rows are broadcast; of an id's different texts the first by its hash stands for it.
    texts = docs.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    some = durable(texts.select("text", "toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(channel)
        for whole in batches:
            for part in slices(whole, "text"):
                row, bucket = grams(scorer.restore(part.column("text")))
                once = np.unique(row * BUCKETS + bucket)
                label = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)[once // BUCKETS]
                found, at = np.unique(once % BUCKETS, return_inverse=True)
                with_label = np.bincount(at, label, len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(with_label), pa.array(np.bincount(at, minlength=len(found)) - with_label)], ["bucket", "t", "c"])

    # A gram's worth: the signed root of its likelihood ratio, near enough (t - expected) / sqrt(expected).
    a, b = float(sizes[True]), float(sizes[False])
    n = F.col("t") + F.col("c")
    worth = (F.col("t") - n * (a / (a + b))) / F.sqrt(n * (a * b / (a + b) ** 2) + 1.0)
    sums = some.mapInArrow(count, "bucket long, t long, c long").groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    kept = sums.where(n >= 3).withColumn("worth", F.abs(worth)).where("worth > 3").orderBy(F.desc("worth"), "bucket").limit(GRAMS).collect()
    buckets = np.array(sorted(r["bucket"] for r in kept), np.int64)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(channel, buckets)
        for whole in batches:
            for part in slices(whole, "text"):
                bits = np.packbits(scorer.present(part.column("text")) > 0, axis=1)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([v.tobytes() for v in bits], pa.binary())], ["toxic", "v"])

    rows = some.mapInArrow(present, "toxic boolean, v binary").collect()  # n_toxic + n_clean rows at most
    if not rows or not len(buckets):
        return channel, None, None
    rows.sort(key=lambda r: (r["toxic"], r["v"]))
    x = np.unpackbits(np.stack([np.frombuffer(r["v"], np.uint8) for r in rows]), axis=1)[:, : len(buckets)].astype(np.float32)
    return channel, buckets, logistic(x, np.array([r["toxic"] for r in rows], np.float32), 1e-5, 1000)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` has doc_id and toxic (0/1); rows whose crc32(doc_id as text) modulo ``folds`` is
    ``held`` are never learned from. Null and empty texts have the score of a text without any known
    gram. Without labels of both kinds every score is 0. Repeated rows are scored alike. An empty table
    gives an empty result; columns besides doc_id and text are not read.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = learn(docs, labels, folds, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for whole in batches:
            for part in slices(whole, "text"):
                score = scorer.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= cutoff).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id"), text_of().alias("text"), (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` whose score is below the cutoff, with all their columns."""
    arrow_batches(docs.sparkSession)
    model = learn(docs, labels, folds, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for whole in batches:
            for part in slices(whole, "text"):
                yield part.filter(pa.array(scorer.scores(part.column("text")) < cutoff))

    return docs.mapInArrow(run, docs.schema)
