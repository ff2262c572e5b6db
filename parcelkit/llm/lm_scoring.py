"""Language-model scores from a log-bilinear model with a large, class-factored vocabulary.

Every word belongs to one unit of the model. The most frequent words are units of their own; all
others belong to the unit of their ending (last three bytes before a closing mark, and that mark), the
most frequent endings again by themselves. A token's probability is that of its unit given the
context, by the neural model, times the word's share of its unit, from counts with absolute
discounting. What the discount leaves in a unit is shared among as many unknown words as are estimated
not to have been seen yet (Chao's estimate from the words seen once and twice), so an unknown word is
about as likely as a rare one. Unit and share are normalised.

A text is cut into words twice: once to count them, over the whole training text, and once to keep its
units, two bytes a token, from which the model is trained and the text scored. The counts of the most
frequent words (a fixed number) go to the workers; all other words of a text meet their counts in a
shuffled join.

Training reads every training document. Documents are dealt to trainers by a hash of their id and
units, and ordered by it, so the model doesn't depend on how the table is partitioned. The trainers'
weights are averaged by tokens, first over a sixteenth of the documents, for a common start, then over
the others, then, where the corpus is small, over all of them again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, durable, text_of
from .neural import LogBilinear, Trainer
from .words import Numbering, buffers, of_bytes, slices, spaced

#: The model has side * side units; side grows with the training text, a power of two from LEAST_SIDE to MOST_SIDE.
LEAST_SIDE, MOST_SIDE, TOKENS_A_UNIT = 16, 64, 512
#: Most frequent words whose counts the workers hold (28 bytes each).
HELD = 1 << 18
#: The end's number among words.
END = 1
#: Tokens of a trainer, at least; trainers, at most; tokens of one call; tokens to be seen in all passes over a small corpus.
TOKENS_EACH, TRAINERS, CHUNK, SEEN = 2_000_000, 4096, 1 << 17, 2_000_000
#: Different words a task keeps while it counts.
COUNTED = 1 << 20
#: Base model: added to every count.
ADDED = 0.1

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word numbers, row offsets (n + 1), and what endings() needs: the bytes, where words begin and end."""
    raw, blanks = spaced(column)
    numbers, begin, end = of_bytes(raw)
    return numbers.view(np.int64), np.r_[0, np.searchsorted(end, blanks, side="right")], (raw, begin, end)


def endings(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of the endings of these words."""
    last = end - 1
    marked = ~_IN_WORD[raw[last]] & (end - begin > 1)
    code = np.where(marked, raw[last], 0).astype(np.uint32)
    last = last - marked
    for k in range(3):
        at = last - k
        code = (code << np.uint32(8)) | np.where(at >= begin, _FOLD[raw[np.maximum(at, 0)]], 0).astype(np.uint32)
    return code.astype(np.int64)


class Units:
    """Numbers the words' units: 0 the end, then words, endings, and units that the other endings share."""

    def __init__(self, side: int, words: np.ndarray, codes: np.ndarray):
        self.n_words, self.n_shared = self.words_for(side), side // 2
        self.first_shared = side * side - self.n_shared
        self.words, self.codes = Numbering(words[: self.n_words]), Numbering(codes[: self.endings_for(side)])

    @staticmethod
    def endings_for(side: int) -> int:
        return side * 3 // 2

    @classmethod
    def words_for(cls, side: int) -> int:
        return side * side - 1 - cls.endings_for(side) - side // 2

    def of_endings(self, codes: np.ndarray) -> np.ndarray:
        """Units of words without one of their own, by their endings."""
        at = self.codes.find(codes)
        return np.where(at >= 0, 1 + self.n_words + at, self.first_shared + codes % self.n_shared)

    def of(self, words: np.ndarray, codes: np.ndarray) -> np.ndarray:
        at = self.words.find(words)
        return np.where(at >= 0, 1 + at, self.of_endings(codes))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words with their codes and summed counts."""
    words, codes, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(words)
    words = words[order]
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    return words[first], codes[order[first]], np.add.reduceat(n[order], first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, code, n) of every word, and of the end; a word comes again where a task has met more than COUNTED."""
    parts, size, rows = [], 0, 0

    def sent(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["word", "code", "n"])

    for whole in batches:
        for part in slices(whole, "text"):
            words, _, (raw, begin, end) = words_of(part.column("text"))
            rows += part.num_rows
            if not len(words):
                continue
            order = np.argsort(words)
            ordered = words[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            at = order[first]
            parts.append((ordered[first], endings(raw, begin[at], end[at]), np.diff(np.r_[first, len(words)])))
            size += len(first)
            if size > COUNTED:
                parts = [_merged(parts)]
                size = len(parts[0][0])
                if size > COUNTED // 2:
                    yield sent(parts[0])
                    parts, size = [], 0
    if parts:
        yield sent(_merged(parts))
    if rows:
        yield sent((np.array([END]), np.array([0]), np.array([rows])))


def _most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words, ``most`` of them at most, with codes and counts, the most frequent first.

    Counts fall into steps of a few per cent, of which there are some hundreds. The words of the upper
    steps that together fit are taken, so no task sends more of them than there are.
    """
    step = F.floor(F.log2(F.col("n")) * 32).cast("int")
    lowest, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        total += r["n"]
        if total > most:
            break
        lowest = r["step"]
    if lowest is None:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    table = counts.where(step >= lowest).select("word", "code", "n").toArrow()
    words, codes, n = (table.column(c).to_numpy() for c in ("word", "code", "n"))
    order = np.lexsort((words, -n))
    return words[order], codes[order], n[order]


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of all rows one after another, and the rows' offsets (n + 1)."""
    raw, at = buffers(column)
    return np.frombuffer(raw.tobytes(), "<u2").astype(np.int64), at // 2


def _train(rows: DataFrame, tokens: float, share: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights after a pass over ``rows`` (h, doc_id, units), averaged over the trainers by tokens."""
    side, size = int(len(share) ** 0.5), 1024  # values in a row of what trainers send
    trainers = int(min(TRAINERS, max(1, -(-tokens // TOKENS_EACH))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, trainer, waiting, n = None, None, [], 0

        def learn() -> None:
            begins = np.cumsum([0, *(len(u) for u in waiting)])
            trainer.train(np.concatenate(waiting), np.repeat(begins[:-1], np.diff(begins)))

        def sent() -> pa.RecordBatch:
            values = trainer.model.flat()
            values = np.r_[values, np.zeros(-len(values) % size, np.float32)].reshape(-1, size)
            k = len(values)
            columns = [pa.array(range(k), pa.int32()), pa.array([number] * k, pa.int32()), pa.array([trainer.tokens] * k, pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "t", "tokens", "v"])

        for batch in batches:
            units, at = _rows_of(batch.column("units"))
            for k, t in enumerate(batch.column("t").to_pylist()):
                if t != number:
                    if trainer is not None:
                        if waiting:
                            learn()
                        yield sent()
                    number, trainer, waiting, n = t, Trainer(LogBilinear.of_flat(start, side), share, seed=t), [], 0
                waiting.append(units[at[k] : at[k + 1]])
                n += at[k + 1] - at[k]
                if n >= CHUNK:
                    learn()
                    waiting, n = [], 0
        if trainer is not None:
            if waiting:
                learn()
            yield sent()

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        weight, total = np.array(table.column("tokens").to_numpy(), float), np.zeros(size)
        for w, v in zip(weight, table.column("v"), strict=True):
            total += w * np.frombuffer(v.as_py(), np.float32)
        return pa.table({"part": table.column("part").slice(0, 1), "v": pa.array([(total / weight.sum()).astype(np.float32).tobytes()], pa.binary())})

    dealt = rows.withColumn("t", F.pmod(F.shiftrightunsigned("h", 8), F.lit(trainers)).cast("int")).repartitionById(trainers, "t").sortWithinPartitions("t", "h", "doc_id", "units")
    weights = dealt.select("t", "units").mapInArrow(run, "part int, t int, tokens long, v binary").groupBy("part").applyInArrow(mean, "part int, v binary").collect()
    if not weights:
        return start
    return np.concatenate([np.frombuffer(r["v"], np.float32) for r in sorted(weights, key=lambda r: r["part"])])[: len(start)]


def lm_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The training rows are those whose crc32(doc_id as text) modulo ``folds`` is not 0; a null doc_id
    counts as the empty text. Null and empty texts are their end alone. Repeated rows are counted,
    learned and scored as often as they stand there; rows equal in doc_id and text go to one trainer.
    Without training rows every word is unknown. An empty table gives an empty result; other columns are
    not read. Words are told apart by 64-bit numbers: where two words share one, which among a billion
    words happens with a chance of 3 %, they are counted and scored as one.
    """
    arrow_batches(docs.sparkSession)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id"), text_of().alias("text"), (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"))

    sums = docs.where("NOT held_out").select("text").mapInArrow(_count, "word long, code long, n long").groupBy("word").agg(F.min("code").alias("code"), F.sum("n").alias("n"))
    counts = durable(sums)
    n_all, n_words, n_end = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    counts = counts.where(F.col("word") != END)
    side = LEAST_SIDE
    while side < MOST_SIDE and (2 * side) ** 2 * TOKENS_A_UNIT <= n_all:
        side *= 2

    held_words, held_codes, held_n = _most_frequent(counts, HELD)
    own = held_words[: Units.words_for(side)]
    named = spark.createDataFrame(pa.table({"word": pa.array(own, pa.int64())}))
    codes = counts.join(F.broadcast(named), "word", "left_anti").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(Units.endings_for(side)).select("code").collect()
    codes = np.array([r["code"] for r in codes], np.int64)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(side, own, codes)
        for b in batches:
            found = units.of(b.column("word").to_numpy(), b.column("code").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), b.column("n")], ["unit", "n"])

    once, twice = (F.sum((F.col("n") == k).cast("long")) for k in (1, 2))
    stats = counts.select("word", "code", "n").mapInArrow(classify, "unit int, n long").groupBy("unit").agg(F.sum("n"), F.count("*"), once, twice).collect()  # side * side rows at most
    total, types, single, double = (np.zeros(side * side) for _ in range(4))
    for k, *values in stats:
        total[k], types[k], single[k], double[k] = values
    total[0], shared = n_end, np.arange(side * side) > Units.words_for(side)
    discount = np.where(shared, np.clip((single + 0.5) / (single + 2 * double + 1), 0.1, 0.95), 0.0)  # units of one word keep all
    unseen = np.maximum(single * (single - 1) / (2 * (double + 1)), 1)
    left = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
    log_left = np.log10(np.maximum(left, 1e-12) / unseen)
    share = total + np.where(shared | (total > 0), 0.5, 1e-3)
    share /= share.sum()
    below, end_base = float(np.log10(n_all + ADDED * (n_words + 1))), float(np.log10(n_end + ADDED))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, held = Units(side, own, codes), Numbering(held_words)
        # By a held word's place, and at last for a word that is not held: unit, base score and share of the unit.
        unit_of = np.r_[1 + np.arange(len(own)), units.of_endings(held_codes[len(own) :]), 0].astype(np.uint16)
        base_of = np.r_[np.log10(held_n + ADDED) - below, 0.0]
        share_of = np.r_[np.zeros(len(own)), np.log10((held_n - discount[unit_of[:-1]])[len(own) :] / total[unit_of[:-1]][len(own) :]), 0.0]
        for whole in batches:
            for part in slices(whole, "text"):
                words, at, (raw, begin, end) = words_of(part.column("text"))
                n, place = part.num_rows, held.find(words)
                row, rest = np.repeat(np.arange(n), np.diff(at)), np.flatnonzero(place < 0)
                seq, rare = unit_of.take(place), units.of_endings(endings(raw, begin[rest], end[rest]))
                seq[rest] = rare
                known = np.diff(at) - np.bincount(row[rest], minlength=n) + (n_end > 0)
                base = np.bincount(row, base_of.take(place), n) + (end_base - below)
                own_share = np.bincount(row, share_of.take(place), n)
                order = np.lexsort((words[rest], row[rest]))
                rest, rare = rest[order], rare[order]
                first = np.flatnonzero(np.r_[True, (words[rest][1:] != words[rest][:-1]) | (row[rest][1:] != row[rest][:-1])]) if len(rest) else np.zeros(0, int)
                offsets = pa.array(np.searchsorted(row[rest][first], np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (words[rest][first], np.diff(np.r_[first, len(rest)]), rare[first])]
                kept = np.insert(seq, at[1:], 0).astype("<u2")
                binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * (at + np.arange(n + 1))).astype(np.int32)), pa.py_buffer(kept)])
                columns = [pa.array(np.diff(at) + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(own_share), binary, *lists]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *columns], ["doc_id", "held_out", "n_tokens", "known", "base", "own", "units", "words", "times", "classes"])

    shape = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, own double, units binary, words array<long>, times array<long>, classes array<long>"
    kept = durable(docs.mapInArrow(keep, shape).withColumn("row", F.monotonically_increasing_id()))

    weights = LogBilinear.new(share).flat()
    training = kept.where("NOT held_out").select(F.xxhash64("doc_id", "units").alias("h"), "doc_id", "units")
    first = F.pmod("h", F.lit(16)) == 0
    passes = int(min(4, max(1, -(-SEEN // max(1, n_all)))))
    for rows, part in [(training.where(first), 1 / 16), (training.where(~first), 15 / 16)] + [(training, 1.0)] * (passes - 1):
        weights = _train(rows, n_all * part, share, weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LogBilinear.of_flat(weights, side)
        for whole in batches:
            for part in slices(whole, "units"):
                seq, at = _rows_of(part.column("units"))
                sums = np.add.reduceat(model.log10(seq, np.repeat(at[:-1], np.diff(at))), at[:-1])  # a row has its end at least
                own = pa.array(part.column("own").to_numpy() + sums)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "known", "base")), own], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "own"])

    scored = kept.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "own", "units").mapInArrow(score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, own double")
    rare = kept.select("row", F.explode(F.arrays_zip("words", "times", "classes")).alias("z")).select("row", F.col("z.words").alias("word"), F.col("z.times").alias("times"), F.col("z.classes").cast("int").alias("unit"))
    met = rare.join(counts.select("word", "n"), "word", "left")
    by_unit = spark.createDataFrame(pa.table({"unit": pa.array(np.arange(side * side), pa.int32()), "d": pa.array(discount), "total": pa.array(np.maximum(total, 1)), "left": pa.array(log_left)}))
    met = met.join(F.broadcast(by_unit), "unit")  # side * side rows
    share_of = F.when(F.col("n").isNotNull(), F.log10((F.col("n") - F.col("d")) / F.col("total"))).otherwise(F.col("left"))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("k"),
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + ADDED) - below)).alias("b"),
        F.sum(F.col("times") * share_of).alias("s"),
    )
    plus = lambda column, part: F.col(column) + F.coalesce(part, F.lit(0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("known", "k").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        plus("base", "b").alias("base_score"), plus("own", "s").alias("score"),
    )
