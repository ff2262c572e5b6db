"""Packing along a space-filling curve.

A document's words are hashed into a vector; a fixed projection takes it to three dimensions, and the
cell it falls in has a place on a Hilbert curve. The curve is cut into ranges of about equal bytes, by
a histogram of the bytes along it; a step of the histogram that is heavier than a range, where a
document has very many copies or likes, is dealt to several ranges by a hash of the id. Ranges are
sorted by place, and each is packed as it streams by: documents are cut where a sequence is full. What
is left at the end of a range is cut into sequences whose lengths are powers of two, which need no
padding; so none is padded.

A task holds one open sequence and one document at a time, and the number of ranges follows the input,
so tasks don't grow with it. Text moves once, to its range, and is encoded once, after that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, text_of
from .tokenizer import byte_codec, vocabulary
from .words import buffers, of_column, slices

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 1024
END = 0
#: Hashed dimensions, projected dimensions, bits of each on the curve.
HASHED, DIMENSIONS, BITS = 256, 3, 16
#: Sequence ids are the range's number times this, plus a count.
STRIDE = 1 << 40
#: Bytes of a range, steps of the histogram (as bits), and bytes that a row counts beside its text's.
RANGE_BYTES, STEP_BITS, ROW_BYTES = 1 << 24, 18, 64


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of cells (n x d, each 0 .. 2 ** bits - 1).

    The cells' coordinates are turned into the curve's transposed index by undoing, from the highest
    bit down, the exchanges and inversions of the sub-cubes, then Gray decoding; the index's bits are
    those of the coordinates in turn.
    """
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for k in range(len(x)):
            is_set = (x[k] >> np.uint64(b)) & one == 1
            swap = (x[0] ^ x[k]) & low
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = np.where(is_set, x[k], x[k] ^ swap)
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> np.uint64(b)) & one == 1, flip ^ np.uint64((1 << b) - 1), flip)
    x ^= flip
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for k in range(len(x)):
            place = (place << one) | ((x[k] >> np.uint64(b)) & one)
    return place.astype(np.int64)


def curve_places(column: pa.Array) -> np.ndarray:
    """Each text's place on the curve; texts without words lie in the middle cell."""
    numbers, at = of_column(column)
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    sign = 1.0 - 2.0 * ((numbers >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    vector = np.bincount(row * HASHED + (numbers % np.uint64(HASHED)).astype(np.int64), sign, n * HASHED).astype(float).reshape(n, HASHED)
    vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)
    point = vector @ np.random.default_rng(11).normal(size=(HASHED, DIMENSIONS))  # about standard normal in each dimension
    return hilbert(np.clip((1 / (1 + np.exp(-1.7 * point)) * 2**BITS).astype(np.int64), 0, 2**BITS - 1))


class Packer:
    """Packs documents in the order given; ``piece`` rows come out of add() and close()."""

    def __init__(self, first_id: int, length: int = LENGTH):
        self.id, self.length, self.held, self.open = first_id, length, 0, []

    def _emit(self, pieces: list[tuple], size: int) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.id, offset))
            offset += len(ids)
        assert offset == size
        self.id += 1
        return rows

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        rows, at = [], 0
        while at < len(ids):
            take = ids[at : at + self.length - self.held]
            self.open.append((doc, at, take, len(ids)))
            self.held += len(take)
            at += len(take)
            if self.held == self.length:
                rows += self._emit(self.open, self.length)
                self.held, self.open = 0, []
        return rows

    def close(self) -> list[tuple]:
        """Cuts the rest into sequences whose lengths are powers of two, the longest first."""
        rows = []
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            now, left = [], size
            while left:
                doc, start, ids, total = self.open.pop(0)
                now.append((doc, start, ids[:left], total))
                if len(ids) > left:
                    self.open.insert(0, (doc, start + left, ids[left:], total))
                left -= len(now[-1][2])
            rows += self._emit(now, size)
            self.held -= size
        return rows


def ranges(weights: np.ndarray, most: int = RANGE_BYTES) -> tuple[np.ndarray, np.ndarray, int]:
    """For each step of the histogram its first range and the number of ranges it is dealt to, and the number of all.

    Light steps fill a range one after another; a step of more than ``most`` bytes has ranges of its own.
    """
    first, parts = np.zeros(len(weights), np.int64), np.ones(len(weights), np.int64)
    now, held = 0, 0
    for step in np.flatnonzero(weights).tolist():
        w = int(weights[step])
        if held and held + w > most:
            now, held = now + 1, 0
        first[step] = now
        if w > most:
            parts[step] = -(-w // most)
            now += int(parts[step])
        else:
            held += w
    return first, parts, now + 1


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, vocabulary_name: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text); one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts
    are documents of one id, the end. Repeated rows are documents of their own; a null doc_id is a
    value like any other. An empty table gives an empty result; other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id"), text_of().alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << STEP_BITS, np.int64)
        for whole in batches:
            for part in slices(whole, "text"):
                np.add.at(total, curve_places(part.column("text")) >> (DIMENSIONS * BITS - STEP_BITS), np.diff(buffers(part.column("text"))[1]) + ROW_BYTES)
        step = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(step, pa.int64()), pa.array(total[step])], ["step", "bytes"])

    weights = np.zeros(1 << STEP_BITS, np.int64)
    for r in docs.select("text").mapInArrow(weigh, "step long, bytes long").groupBy("step").agg(F.sum("bytes").alias("bytes")).collect():  # 2 ** STEP_BITS rows at most
        weights[r["step"]] = r["bytes"]
    first, parts, n_ranges = ranges(weights)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                places = curve_places(part.column("text"))
                step = places >> (DIMENSIONS * BITS - STEP_BITS)
                of = first[step] + part.column("tie").to_numpy() % parts[step]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(of, pa.int32()), pa.array(places, pa.int64()), part.column("tie")], ["doc_id", "text", "range", "place", "tie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, packer, now, kind = byte_codec(vocabulary(vocabulary_name)), None, None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([kind, *[pa.int64()] * 6])], _NAMES)

        for batch in batches:
            kind, rows = batch.schema.field("doc_id").type, []
            for part in slices(batch, "text"):
                for of, doc, text in zip(*(part.column(c).to_pylist() for c in ("range", "doc_id", "text")), strict=True):
                    if of != now:
                        rows += packer.close() if packer else []
                        now, packer = of, Packer(of * STRIDE, length)
                    rows += packer.add(doc, np.append(codec.encode(text), np.uint32(END)))
            yield batch_of(rows)
        if packer:
            yield batch_of(packer.close())

    tied = docs.withColumn("tie", F.pmod(F.xxhash64("doc_id"), F.lit(2**31)))
    placed = tied.mapInArrow(place, f"doc_id {kind}, text string, range int, place long, tie long")
    ordered = placed.repartitionById(n_ranges, "range").sortWithinPartitions("range", "place", "tie", "doc_id", "text")
    return ordered.select("range", "doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
