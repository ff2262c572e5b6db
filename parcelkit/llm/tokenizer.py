"""Encoders for the public vocabularies; one of each per Python worker."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: How a byte-level vocabulary splits a text before its merges (a fixed value, as published with it).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def library(path: str):
    """The tokenizers library's own encoder, without truncation and padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: a byte that prints stands for
    itself, the others take the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteCodec:
    """Byte-level BPE as the tokenizers library has it for ``path``.

    A byte-level vocabulary lists its merges in the order of its ids, so ids serve as ranks, and a
    rank encoder gives the library's ids several times faster. The two may know different versions
    of Unicode's character classes, so only texts of Latin-1 characters, whose classes never
    change, go to the rank encoder; all others go to the library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of = byte_alphabet()
        ranks = {bytes(bytes_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in self.special}
        self.tokens: list[bytes] = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, n in ranks.items():
            self.tokens[n] = token
        for token, n in self.special.items():
            self.tokens[n] = token.encode()
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self._fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self._allowed = set(self.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids (uint32) of the whole text; a special token's string is that token, as the library has it."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(library(self.path).encode(text, add_special_tokens=False).ids, np.uint32)
        return self._fast.encode_to_numpy(text, allowed_special=self._allowed, disallowed_special=()).astype(np.uint32, copy=False)

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that are no UTF-8 become replacement characters."""
        return self.raw(ids).decode("utf-8", "replace")


@lru_cache(2)
def byte_codec(path: str) -> ByteCodec:
    return ByteCodec(path)
