"""Byte-level BPE encoding and decoding, with long texts encoded as a tree.

A long text is halved until its pieces are short; the pieces are encoded as rows of their own, in
parallel, and joined pairwise. Around each join a window is encoded again and grows until both sides
agree exactly:

- A position is *sure* if the text is split there whatever surrounds it: after a letter before
  anything but a letter, after a digit likewise, or after a mark (other than an apostrophe) before a
  letter, digit or white space. If a sure position lies near on each side, what stands between them
  is encoded again, and the rest of both sides is final.
- Otherwise the join lies in a long run of one class, which is one unit to the merges. A window of a
  few tokens on each side is encoded; if its first tokens are the left side's and its last the right
  side's, the sides are spliced there. This is exact: a sequence of tokens is the encoding of a unit
  if and only if every two neighbours are the encoding of their concatenation, and each two
  neighbours of the result stand side by side in one of the three encodings. If they disagree the
  window doubles, up to the whole run.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, text_of
from .tokenizer import ByteCodec, byte_codec, vocabulary
from .words import slices

VOCABULARY = "byte_bpe_50k.json"
#: Characters of the longest text, or piece, that is encoded at once.
LEAF = 16384
#: Characters looked through for a sure position, first tokens of a window, tokens that must agree.
NEAR, FIRST, AGREE = 256, 8, 2


def char_class(c: str) -> str:
    """L, N, S (white space), O or, for characters that this Unicode version doesn't know, ?."""
    kind = unicodedata.category(c)
    return "S" if c.isspace() and not "\x1c" <= c <= "\x1f" else kind[0] if kind[0] in "LN" else "?" if kind == "Cn" else "O"


def sure(before: str, after: str) -> bool:
    """Whether a text is split between these two characters in every surrounding."""
    a, b = char_class(before), char_class(after)
    return "?" not in (a, b) and (a in "LN" and b != a or a == "O" and before != "'" and b != "O")


def pieces_of(text: str, special: list[str], leaf: int = LEAF) -> list[tuple[bool, str]]:
    """(whether the text is split before it for sure, piece) of halves of at most ``leaf`` characters.

    Special strings are pieces of their own; the library splits a text at them before all else.
    """
    out: list[tuple[bool, str]] = []

    def halve(part: str, hard: bool) -> None:
        n = 1
        while len(part) > n * leaf:
            n *= 2
        for k in range(n):
            out.append((hard or k > 0 and sure(part[len(part) * k // n - 1], part[len(part) * k // n]), part[len(part) * k // n : len(part) * (k + 1) // n]))
            hard = False

    at = 0
    while True:
        found = min(((i, s) for s in special if (i := text.find(s, at)) >= 0), default=None)
        if (to := found[0] if found else len(text)) > at:
            halve(text[at:to], True)
        if not found:
            return out
        out.append((True, found[1]))
        at = found[0] + len(found[1])


def join(codec: ByteCodec, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The encoding of two texts' concatenation, from their encodings; neither holds a special token
    near the join, and the concatenation is not split there for sure."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    found = _between_sure(codec, left, right)
    return found if found is not None else _by_tokens(codec, left, right)


def _tail(codec: ByteCodec, ids: np.ndarray, most: int) -> bytes:
    """Bytes of the last tokens, at least ``most`` bytes or all."""
    k = FIRST
    while k < len(ids) and codec.lengths[ids[-k:]].sum() < most:
        k *= 2
    return codec.raw(ids[-k:])


def _head(codec: ByteCodec, ids: np.ndarray, most: int) -> bytes:
    k = FIRST
    while k < len(ids) and codec.lengths[ids[:k]].sum() < most:
        k *= 2
    return codec.raw(ids[:k])


def _between_sure(codec: ByteCodec, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """Encodes again what stands between sure positions; None if there is none near on one side."""
    a, b = _tail(codec, left, 4 * NEAR), _head(codec, right, 4 * NEAR)
    whole_left, whole_right = len(a) == codec.lengths[left].sum(), len(b) == codec.lengths[right].sum()
    while a and a[0] & 0xC0 == 0x80:
        a = a[1:]
    if not whole_right:
        while b and (b[-1] & 0x80):
            b = b[:-1]
    x, y = a.decode("utf-8", "surrogateescape"), b.decode("utf-8", "surrogateescape")
    begin = next((i for i in range(len(x) - 1, 0, -1) if sure(x[i - 1], x[i])), 0 if whole_left else None)
    end = next((i for i in range(1, len(y)) if sure(y[i - 1], y[i])), len(y) if whole_right else None)
    if begin is None or end is None:
        return None
    before, after = x[begin:], y[:end]
    n_left, n_right = _cut(codec, left[::-1], len(before.encode("utf-8", "surrogateescape"))), _cut(codec, right, len(after.encode("utf-8", "surrogateescape")))
    if n_left is None or n_right is None:
        return None
    return np.concatenate([left[: len(left) - n_left], codec.encode(before + after), right[n_right:]])


def _cut(codec: ByteCodec, ids: np.ndarray, n_bytes: int) -> int | None:
    """How many tokens make up just so many bytes."""
    sums = np.cumsum(codec.lengths[ids[: n_bytes + 1]])
    if n_bytes == 0:
        return 0
    k = int(np.searchsorted(sums, n_bytes))
    return k + 1 if k < len(sums) and sums[k] == n_bytes else None


def _by_tokens(codec: ByteCodec, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Windows of tokens inside a run of one class, growing; all of both sides at last."""
    k = FIRST
    while k + AGREE < len(left) and k + AGREE < len(right):
        i, j = len(left) - k, k
        while i > AGREE and codec.tokens[left[i]][0] & 0xC0 == 0x80:
            i -= 1
        while j < len(right) - AGREE and codec.tokens[right[j]][0] & 0xC0 == 0x80:
            j += 1
        before, after = codec.raw(left[max(0, i - 4) : i]).decode("utf-8", "ignore")[-3:], codec.raw(right[j : j + 4]).decode("utf-8", "ignore")[:3]
        try:
            text = codec.raw(np.concatenate([left[i:], right[:j]])).decode("utf-8")
        except UnicodeDecodeError:
            text = ""
        if len(before) == len(after) == 3 and text and len(kinds := {char_class(c) for c in before + text + after}) == 1 and "?" not in kinds:
            ids = codec.encode(text)
            if len(ids) >= 2 * AGREE and (ids[:AGREE] == left[i : i + AGREE]).all() and (ids[-AGREE:] == right[j - AGREE : j]).all():
                return np.concatenate([left[:i], ids, right[j:]])
        k *= 2
    return codec.encode(codec.raw(np.concatenate([left, right])).decode("utf-8"))


def join_all(codec: ByteCodec, parts: list[tuple[bool, np.ndarray]]) -> np.ndarray:
    """Joins neighbours pairwise, level by level, until one is left."""
    while len(parts) > 1:
        level = []
        for k in range(0, len(parts), 2):
            if k + 1 == len(parts):
                level.append(parts[k])
            elif parts[k + 1][0]:
                level.append((parts[k][0], np.concatenate([parts[k][1], parts[k + 1][1]])))
            else:
                level.append((parts[k][0], join(codec, parts[k][1], parts[k + 1][1])))
        parts = level
    return parts[0][1] if parts else np.zeros(0, np.uint32)


def _digests(codec: ByteCodec, decimals: list[str], ids: np.ndarray) -> tuple[int, str, str]:
    text = ",".join(map(decimals.__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def _mapped(kind: str, vocabulary_name: str, rows: Callable) -> tuple[Callable, str]:
    """An Arrow function whose ``rows(codec, decimals, batch)`` gives (doc_id, ids) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(vocabulary(vocabulary_name))
        decimals = [str(n) for n in range(len(codec.tokens))]
        for whole in batches:
            found = [(d, *_digests(codec, decimals, ids)) for d, ids in rows(codec, whole)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate([whole.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"


def codec_digests(docs: DataFrame, vocabulary_name: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Encodes and decodes every row of ``docs``; returns doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens. Special strings inside texts are their tokens. Rows repeated
    with the same doc_id and text give as many rows, but long ones are encoded once. An empty table gives an empty result; other
    columns are not read.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id"), text_of().alias("text"))

    def whole(codec: ByteCodec, batch: pa.RecordBatch) -> Iterator[tuple]:
        for part in slices(batch, "text"):
            for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                yield d, codec.encode(text)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(vocabulary(vocabulary_name))
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for d, n, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "copies", "text")), strict=True):
                    key = hashlib.sha256(text.encode()).digest()
                    rows += [(d, n, key, no, hard, piece) for no, (hard, piece) in enumerate(pieces_of(text, list(codec.special), leaf))]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate([part.schema.field("doc_id").type, pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.string()])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copies", "key", "no", "hard", "piece"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(vocabulary(vocabulary_name))
        for batch in batches:
            ids = [codec.encode(p).astype("<u4").tobytes() for p in batch.column("piece").to_pylist()]
            kept = ["doc_id", "copies", "key", "no", "hard"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(ids, pa.binary())], [*kept, "ids"])

    def joined(codec: ByteCodec, batch: pa.RecordBatch) -> Iterator[tuple]:
        for d, parts in zip(batch.column("doc_id").to_pylist(), batch.column("parts"), strict=True):
            in_order = sorted(parts.as_py(), key=lambda p: p["no"])
            yield d, join_all(codec, [(p["hard"], np.frombuffer(p["ids"], "<u4")) for p in in_order])

    short = docs.where(F.length("text") <= leaf).mapInArrow(*_mapped(kind, vocabulary_name, whole))
    long = docs.where(F.length("text") > leaf).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    shape = f"doc_id {kind}, copies long, key binary, no int, hard boolean"
    encoded = long.mapInArrow(split, f"{shape}, piece string").repartition("key", "no").mapInArrow(encode, f"{shape}, ids binary")
    lists = encoded.groupBy("doc_id", "key").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("no", "hard", "ids")).alias("parts"))
    # A struct of id and copies goes through the codec in the id's place; the copies come back as rows.
    texts = lists.select(F.struct("doc_id", "copies").alias("doc_id"), "parts").mapInArrow(*_mapped(f"struct<doc_id:{kind},copies:bigint>", vocabulary_name, joined))
    again = texts.select("doc_id.*", "n_tokens", "ids_sha256", "decoded_sha256", F.explode(F.sequence(F.lit(1), F.col("doc_id.copies"))))
    return short.unionByName(again.select(short.columns))
