"""Token counts: lengths only, from batches balanced by bytes.

Blanks and line ends are never part of a token of the vocabulary and no rule looks across them, so a
text may be cut there: long texts are cut into parts of bounded size, and a part's count is the sum
over what stands between blanks. Parts are gathered into batches of equal bytes, whole texts and parts
of texts alike. A bounded memory keeps the counts of strings; those of a batch's strings that it lacks
are encoded by the tokenizers library in one call.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .tokenizer import library, vocabulary
from .words import slices

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Characters of a part, UTF-8 bytes of a batch, and strings remembered (two generations of half as many).
PART, BATCH, REMEMBERED = 1 << 16, 1 << 19, 600_000

_BREAK = re.compile("[ \n]")
_TAIL = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)\Z")


class Lengths:
    """Counts tokens of whole texts; ``path`` is a vocabulary that drops white space."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.encoder, self.most = library(path), remembered // 2
        self.young: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART:
            cut = _BREAK.search(text, at + PART)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:] if at else text

    def _learn(self, strings: list[str]) -> None:
        new, split = [], []
        for s in dict.fromkeys(strings):
            if (n := self.old.get(s)) is not None:
                self.young[s] = n
            elif (m := _TAIL.match(s)) and m[1].isalpha() and max(m[1]) < "\u0100":
                split.append((s, m[1].lower(), m[2]))  # letters, then marks: two separate strings to the encoder
            else:
                new.append(s)
        heads = [x for _, a, b in split for x in (a, b) if x not in self.young]
        new = list(dict.fromkeys(new + heads))
        for s, e in zip(new, self.encoder.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.young[s] = len(e)
        for s, a, b in split:
            self.young[s] = self.young[a] + self.young[b]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, in byte-balanced batches."""
        totals, batch, size = [0] * len(texts), [], 0
        for k, text in enumerate(texts):
            for part in self._parts(text):
                batch.append((k, part))
                size += len(part) if part.isascii() else len(part.encode())
                if size >= BATCH:
                    self._batch(batch, totals)
                    batch, size = [], 0
        self._batch(batch, totals)
        return totals

    def _batch(self, batch: list[tuple[int, str]], totals: list[int]) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {"": 0}
        waiting, unseen = [], []
        for k, part in batch:
            strings = part.replace("\n", " ").split(" ")
            counts = list(map(self.young.get, strings))
            try:
                totals[k] += sum(counts)
            except TypeError:  # a string without a count
                waiting.append((k, strings))
                unseen += [s for s, n in zip(strings, counts, strict=True) if n is None]
        if waiting:
            self._learn(unseen)
            for k, strings in waiting:
                totals[k] += sum(map(self.young.__getitem__, strings))


def token_counts(docs: DataFrame, vocabulary_name: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids are rows like any
    other. An empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(vocabulary(vocabulary_name))
        for whole in batches:
            for part in slices(whole, "text"):
                text = part.column("text").fill_null("")
                n = pa.array(lengths.count(text.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
