"""Word shingles of whole texts as hash arrays."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from hostpulse.llm.common import SpanHash, code_points, flat, mix

WORDS = 5
_UNSEEN, _OUTSIDE, _INSIDE, _ALONE = range(4)


class Characters:
    """Per code point: whether it belongs to a word, is a word of its own (ideographs and kana), and its lower case."""

    def __init__(self) -> None:
        self.kind = np.full(0x110000, _UNSEEN, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)

    def learn(self, points: np.ndarray) -> None:
        new = points[self.kind[points] == _UNSEEN]
        for c in np.unique(new).tolist() if len(new) else ():
            low = chr(c).lower()
            if len(low) == 1:
                self.lower[c] = ord(low)
            category, name = unicodedata.category(chr(c)), unicodedata.name(chr(c), "")
            alone = category in ("Lo", "Lm") and any(n in name for n in ("IDEOGRAPH", "HIRAGANA", "KATAKANA"))
            self.kind[c] = _ALONE if alone else _INSIDE if category[0] in "LMN" else _OUTSIDE


class Shingler:
    """Cuts texts into lower-case words and hashes every ``width`` in a row.

    Words are runs of letters, marks and digits; an ideograph or kana is one alone.
    A text of fewer words has one shingle of all its words; a text without words has its whole content as one
    element, so that only equal texts share it; an empty or null text has none.
    """

    def __init__(self, width: int = WORDS):
        self.width = width
        self.characters = Characters()
        self.factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts and each word's text."""
        points, offsets = code_points(texts)
        n = len(points)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.characters.learn(points)
        low, kind = self.characters.lower[points], self.characters.kind[points]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        joint = (kind[1:] == _INSIDE) & (kind[:-1] == _INSIDE) & ~edge[1:n]
        begin, end = kind != _OUTSIDE, kind != _OUTSIDE
        begin[1:] &= ~joint
        end[:-1] &= ~joint
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        hashes = SpanHash(mix(low.astype(np.uint64) + np.uint64(1)))(starts, ends)
        return hashes, np.searchsorted(offsets, starts, side="right") - 1

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all texts and each shingle's text, in text order."""
        hashes, text = self.words(texts)
        count = np.bincount(text, minlength=len(texts)).astype(np.int64)
        last = np.cumsum(count)
        first = last - count
        n = len(hashes)
        place = np.arange(n)
        made = np.zeros(n, np.uint64)
        for k in range(self.width):
            part = np.zeros(n, np.uint64)
            if k < n:
                part[: n - k] = hashes[k:] * self.factors[k]
            made += np.where(place + k < last[text], part, np.uint64(0)) if n else part
        keep = (place + self.width <= last[text]) | ((place == first[text]) & (count[text] < self.width))
        values, owner = mix(made[keep]), text[keep]
        body, offsets = flat(texts)
        bare = np.flatnonzero((count == 0) & (np.diff(offsets) > 0))
        if len(bare):
            whole = SpanHash(mix(body.astype(np.uint64) + np.uint64(7)))(offsets[bare], offsets[bare + 1])
            values, owner = np.append(values, whole), np.append(owner, bare)
            order = np.argsort(owner, kind="stable")
            values, owner = values[order], owner[order]
        return values, owner
