"""Language identification in two steps: family, then language.

A text is a vector of hashed counts of its letters' bigrams and trigrams (bytes, A-Z lower-cased).
Linear support vector machines, one for each pair, tell the families apart; within the winning
family others, again one for each pair, tell its languages apart. Training takes a bounded number of
documents of each language, those with the smallest hashes of id and text; every text is predicted
from all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, text_of
from .svm import linear_svm
from .words import slices, spaced

#: Hashed dimensions; documents learned from, for each language and in all.
DIMENSIONS, EACH, ALL = 2048, 800, 12_000
#: Families of languages by ISO 639-1 code. A language not listed is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi ur bn mr gu pa ne",
    "semitic": "ar he mt am",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def counted(column: pa.Array) -> np.ndarray:
    """Hashed counts of bigrams and trigrams within runs of letters (a run's two ends count as letters)."""
    raw, blanks = spaced(column)
    n = len(blanks)
    if not n:
        return np.zeros((0, DIMENSIONS), np.float32)
    letters = np.where(_LETTER[raw], _FOLD[raw], 32).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(np.r_[-1, blanks]))
    a, b, c = np.r_[np.uint32(32), letters[:-1]], letters, np.r_[letters[1:], np.uint32(32)]
    c[blanks] = 32  # what follows a row's end is another row
    out = np.zeros(n * DIMENSIONS)
    hashed = lambda code: ((code * np.uint32(2654435761)) >> np.uint32(15)) % np.uint32(DIMENSIONS)
    three, two = b != 32, (b != 32) | (c != 32)
    out += np.bincount(row[three] * DIMENSIONS + hashed(a[three] << np.uint32(16) | b[three] << np.uint32(8) | c[three]), minlength=len(out))
    out += np.bincount(row[two] * DIMENSIONS + hashed(np.uint32(0x9000000) | b[two] << np.uint32(8) | c[two]), minlength=len(out))
    return out.reshape(n, DIMENSIONS).astype(np.float32)


def scaled(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts)
    return root / np.maximum(np.linalg.norm(root, axis=1, keepdims=True), 1e-6)


class Pairwise:
    """One machine for each pair of classes; the class that wins most, then by the widest margins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.names = sorted(set(y.tolist()))
        self.pairs = list(combinations(range(len(self.names)), 2))
        weights = []
        for i, j in self.pairs:
            some = (y == self.names[i]) | (y == self.names[j])
            weights.append(linear_svm(x[some], np.where(y[some] == self.names[i], 1, -1).astype(np.float32)))
        self.weights = np.stack(weights).astype(np.float32) if weights else np.zeros((0, x.shape[1] + 1), np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner, and its mean chance over its pairs."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        chance = 1 / (1 + np.exp(-3 * np.clip(x @ self.weights[:, :-1].T + self.weights[:, -1], -10, 10)))
        wins, mean = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (i, j) in enumerate(self.pairs):
            for c, p in ((i, chance[:, k]), (j, 1 - chance[:, k])):
                wins[:, c] += p > 0.5
                mean[:, c] += p / (n - 1)
        best = np.argmax(wins + 0.5 * mean, axis=1)
        return best, mean[np.arange(len(x)), best]


class Hierarchy:
    """Families first, then the languages of the family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = np.array([_FAMILY.get(lang, lang) for lang in langs])
        self.families = Pairwise(x, family)
        self.within = {f: Pairwise(x[family == f], langs[family == f]) for f in self.families.names}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        at, chance = self.families.predict(x)
        names = np.empty(len(x), object)
        for k, f in enumerate(self.families.names):
            rows = np.flatnonzero(at == k)
            if len(rows):
                inner, p = self.within[f].predict(x[rows])
                names[rows] = np.array(self.within[f].names, object)[inner]
                chance[rows] *= p
        return names.tolist(), chance


def learn(docs: DataFrame, each: int = EACH, most: int = ALL) -> Hierarchy | None:
    """Learns from at most ``each`` rows of a language and ``most`` in all; None without any.

    ``docs`` has doc_id, text and lang; the rows taken are those with the smallest hashes of doc_id and
    text, repeated rows once. Languages beyond ``most`` have one row each.
    """
    hashed = F.xxhash64("doc_id", "text").alias("h")
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", "text", hashed)
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    n_langs = sizes.count()
    if not n_langs:
        return None
    each = max(1, min(each, most // n_langs))
    # Rows whose hash lies in the lower share that holds about four times the rows wanted; all of them where there are no more.
    low = F.shiftrightunsigned("h", 11).cast("double") / 2.0**53 * F.col("n") < 4.0 * each + 64
    few = known.join(F.broadcast(sizes), "lang").where(low).groupBy("lang", "h").agg(F.min("text").alias("text"))  # repeated rows once; n_langs rows broadcast
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    some = few.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 1 << 20):
                values = np.minimum(255, np.rint(scaled(counted(part.column("text"))) * 255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([v.tobytes() for v in values], pa.binary())], ["lang", "v"])

    rows = some.mapInArrow(count, "lang string, v binary").collect()  # ``each`` rows of each language
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["v"]))
    x = np.stack([np.frombuffer(r["v"], np.uint8) for r in rows]).astype(np.float32) / 255
    return Hierarchy(x, np.array([r["lang"] for r in rows]))


def language_id(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32(doc_id as text) modulo ``folds`` is not ``held`` and whose lang is
    not null. A null text, or one without a letter, is 'und' with score 0; so is every text if there
    is nothing to learn from. Repeated rows are predicted alike. An empty table gives an empty result;
    columns besides doc_id, text and lang are not read.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"), (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"))
    model = learn(docs.where("NOT held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 1 << 20):
                letters = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                names, chance = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if model is not None and part.num_rows:
                    names, chance = model.predict(scaled(counted(part.column("text"))))
                    names, chance = [n if ok else "und" for n, ok in zip(names, letters, strict=True)], np.where(letters, chance, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(chance, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", text_of().alias("text"), "held_out", letters).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
