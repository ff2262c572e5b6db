"""Restores disguised words: look-alike characters, letters set apart, repeated letters.

The observed characters are the output of a noisy channel: a letter may be written as a look-alike, or
more than once, and a gap (a blank or a mark) may stand between any two letters. A lattice has, for
each character, the letters it may stand for, for a run of one letter the choice of one or two, and for
a gap between spelt letters the choice of nothing or the end of a word; Viterbi's algorithm finds the
likeliest letters and words under a character trigram model. Words that the channel leaves no choice
are what they seem.
"""

from __future__ import annotations

import re
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa

from .words import spaced

#: What a character may stand for besides itself.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
#: log10 chances in the channel: a letter written as a look-alike, a letter repeated, a gap that is nothing, a gap that ends a word.
DISGUISED, REPEATED, NOTHING, ENDS = -1.0, -1.0, -0.1, -0.7
#: A gap in what is decoded, and the most letters between two gaps.
GAP, PART = "\0", 4
#: Words up to SHORT characters are remembered; longer ones are decoded in pieces of about PIECE letters.
SHORT, PIECE = 64, 128
#: Letters a-z are 1 to 26; 0 is a word's edge, 27 any other character.
SYMBOLS = 28

_CODE = np.zeros(256, np.int64)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CODE[128:] = 27
_ALPHA = (_CODE > 0) & (_CODE < 27)
_LOOK = np.zeros(256, bool)
_LOOK[[ord(c) for c in LOOKALIKES]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in LOOKALIKES if not c.isdigit()]] = True
_WIDE = np.arange(256) >= 128
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in " .-_*/\n\t"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".-_*"]] = True


def trigrams(column: pa.Array) -> np.ndarray:
    """Counts of character trigrams (SYMBOLS ** 3) over the words of all rows."""
    raw, _ = spaced(column)
    code = np.r_[0, 0, _CODE[raw], 0]
    triple = (code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
    return np.bincount(triple[code[1:-1] + code[2:] > 0], minlength=SYMBOLS**3)


class Channel:
    """Decodes words; ``counts`` are trigram counts of running text."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        one = c.sum(axis=(0, 1)) + 1
        two = c.sum(axis=0)
        back = (two + 5 * one / one.sum()) / (two.sum(axis=1, keepdims=True) + 5)
        self.log = np.log10((c + 20 * back) / (c.sum(axis=2, keepdims=True) + 20)).tolist()
        self._short = lru_cache(1 << 15)(self._decode)

    def decode(self, word: str) -> str:
        """The likeliest letters of ``word`` (lower case), of any length; short words are remembered.

        Symbols at the end may be marks or letters. Both readings are given, with a blank between: the
        word without them, and the likeliest one in which the first of them, at least, is a letter.
        """
        return self._short(word) if len(word) <= SHORT else self._decode(word)

    def _decode(self, word: str) -> str:
        settled: list[str] = []
        marks = _MARKS.search(word).start()
        bare, likeliest, made_of = [], -np.inf, ""
        # A state's text begins where all states' texts last agreed, so no step copies more than a piece.
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for m in re.finditer(r"(.)\1*", word, re.S):
            char, times = m[0][0], len(m[0])
            if char == GAP:
                now = {}
                for (a, b), (score, text) in best.items():
                    ended = ((b, 0), score + ENDS + self.log[a][b][0], text + " ")
                    for at, got, made in (((a, b), score + NOTHING, text), ended) if b else (((a, b), score, text),):
                        if got > now.get(at, (-1e9, ""))[0]:
                            now[at] = (got, made)
                best = now
                continue
            if 0 < m.start() == marks:
                bare = ["".join(settled) + self._ended(best)[1]]
            choices = [(char, 0.0)] if char not in LOOKALIKES else [(c, DISGUISED) for c in LOOKALIKES[char]]
            now: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in best.items():
                for letter, cost in choices:
                    k = ord(letter) - 96 if "a" <= letter <= "z" else 27
                    total, x, y, made = score, a, b, text
                    for n in (1, 2):
                        if n > times:
                            break
                        total += self.log[x][y][k] + cost
                        x, y, made = y, k, made + letter
                        got = total + REPEATED * (times > n) * min(times - n, 2)
                        if got > now.get((x, y), (-1e9, ""))[0]:
                            now[x, y] = (got, made)
            best = _settle(now, settled)
            if m.end() > marks or m.end() == len(word):
                score, text = self._ended(best)
                if score > likeliest:
                    likeliest, made_of = score, "".join(settled) + text
        return " ".join([*bare, made_of])

    def _ended(self, states: dict[tuple[int, int], tuple[float, str]]) -> tuple[float, str]:
        """Score and text of the likeliest state where the word ends."""
        return max((score + self.log[a][b][0], text) for (a, b), (score, text) in states.items())


def _settle(states: dict[tuple[int, int], tuple[float, str]], settled: list[str]) -> dict[tuple[int, int], tuple[float, str]]:
    """Moves the beginning that all states share to ``settled`` once a text is longer than PIECE.

    Texts that still differ PIECE letters back follow the likeliest one there; the states of the others end.
    """
    longest = max(len(text) for _, text in states.values())
    if longest <= PIECE:
        return states
    n = len(commonprefix([text for _, text in states.values()]))
    if longest - n > PIECE:
        lead = max(states.values())[1]
        n = len(lead) - PIECE // 2
        states = {at: (score, text) for at, (score, text) in states.items() if text[:n] == lead[:n]}
    settled.append(next(iter(states.values()))[1][:n])
    return {at: (score, text[n:]) for at, (score, text) in states.items()}


_LETTERS = r"(?:[^\W_]|[@$!|+])"
_SPACED = re.compile(rf"(?<![^\W\d_]){_LETTERS}(?:[ .\-_*/]{_LETTERS}){{2,}}(?![^\W\d_])")
_PARTED = re.compile(rf"(?<![^\W_@$!|+]){_LETTERS}{{1,{PART}}}(?:[.\-_*]{_LETTERS}{{1,{PART}}})+(?![^\W_@$!|+])")
_BETWEEN = re.compile(r"[ .\-_*/]")
_WORD = re.compile(r"[A-Za-z0-9@$!|+\u0080-\U0010ffff]+")
_LETTER = re.compile(r"[^\W\d_]")
_DISGUISED = re.compile(r"[0-9@$!|+][^\W\d_]|[^\W\d_][0-9@$!|+]|([^\W\d_])\1\1")
_MARKS = re.compile(r"(?:(?<![!|+$@])[!|+$@]+)?\Z")


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and whether it is a letter, of every character below 2 ** 16."""
    chars = [chr(k) for k in range(1 << 16)]
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.int32)
    letter = np.array([c.isalnum() and not "0" <= c <= "9" for c in chars])
    letter[-1] = True  # stands for all characters beyond, too
    return lower, letter


def _decoded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins."""
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    code = raw[begins].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    lead, more = code[wide], [np.r_[raw, np.zeros(3, np.uint8)][begins[wide] + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    two, three = (lead & 0x1F) << 6 | more[0], (lead & 0x0F) << 12 | more[0] << 6 | more[1]
    code[wide] = np.select([lead < 0xE0, lead < 0xF0], [two, three], (lead & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2])
    return code, begins


def _rows(at: np.ndarray, blanks: np.ndarray) -> np.ndarray:
    """Which rows these places are in."""
    out = np.zeros(len(blanks), bool)
    out[np.searchsorted(blanks, at)] = True
    return out


def suspicious(column: pa.Array) -> np.ndarray:
    """Whether each row surely holds a word to decode: a look-alike before a letter, a digit after one,
    a letter three times in a row, three single letters or look-alikes with gaps between them, or short
    parts of a word with marks between them."""
    raw, blanks = spaced(column)
    if not len(raw):
        return np.zeros(len(blanks), bool)
    lower, letter = _characters()
    code, begins = _decoded(raw) if (raw >= 128).any() else (raw, None)
    n = len(code)
    code, letter = (np.where(code < 1 << 16, lower[np.minimum(code, 0xFFFF)], code), letter[np.minimum(code, 0xFFFF)]) if begins is not None else (lower[code], letter[code])
    code, letter = np.r_[code, np.full(5, 32, code.dtype)], np.r_[letter, np.zeros(5, bool)]
    byte = np.minimum(code, 128)
    look, gap = _LOOK[byte], _GAP[byte]
    hit = look[:n] & letter[1 : n + 1]
    hit |= letter[:n] & look[1 : n + 1] & (code[1 : n + 1] >= 48) & (code[1 : n + 1] <= 57)
    hit |= letter[:n] & (code[:n] == code[1 : n + 1]) & (code[:n] == code[2 : n + 2])
    some = letter | look
    spelt = some[:n] & gap[1 : n + 1] & some[2 : n + 2] & gap[3 : n + 3] & some[4 : n + 4] & ~letter[5 : n + 5]
    hit |= spelt & ~np.r_[False, letter[: n - 1]]
    parted = np.flatnonzero(letter[:n] & _MARK[byte[1 : n + 1]] & some[2 : n + 2]) + 1  # marks between letters: short parts on either side
    if len(parted):
        short = [np.logical_or.reduce([~some[np.clip(parted + k * step, 0, n)] | (parted + k * step < 0) for k in range(2, PART + 2)]) for step in (-1, 1)]
        hit[parted[short[0] & short[1] & (some[np.maximum(parted - 2, 0)] & (parted > 1) | some[np.minimum(parted + 2, n)])]] = True  # three letters at least
    at = np.flatnonzero(hit)
    return _rows(at if begins is None else begins[at], blanks)


def ends_open(column: pa.Array) -> np.ndarray:
    """Whether each row holds a letter with a symbol after it that is a mark or a look-alike, as in "stop!"."""
    raw, blanks = spaced(column)
    return _rows(np.flatnonzero((_ALPHA | _WIDE)[raw[:-1]] & _SYMBOL[raw[1:]]), blanks)


def restored(text: str, channel: Channel) -> str:
    """The disguised words of a text as they are meant, with blanks between."""
    apart = (_BETWEEN.sub(GAP, m[0]).lower() for pattern in (_SPACED, _PARTED) for m in pattern.finditer(text))
    words = (m[0].lower() for m in _WORD.finditer(text))
    return " ".join([channel.decode(w) for w in apart if _LETTER.search(w) and len(w) - w.count(GAP) > 2] + [channel.decode(w) for w in words if _DISGUISED.search(w)])
