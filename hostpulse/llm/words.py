"""Texts as tokenizer words: vectorised splitting, and token ids looked up per distinct word.

A word tokenizer's work on a text is the work on its words.  Words are cut by array operations over a
whole batch, hashed, and only words that a task has not seen yet are encoded.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from tokenizers import Tokenizer

from hostpulse.llm.common import SpanHash, code_points, mix, spans_to_index

#: The normaliser and the word pattern for which the array path is written.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}

SPACE, LETTER, NUMBER, OTHER, RARE = range(5)
#: Code points from here on, and those whose form depends on their neighbours, are left to the library.
LIMIT = 0x2E00
#: Distinct words that a task remembers.
MOST_WORDS = 1_000_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.full(LIMIT + 1, RARE, np.uint8)
    lower = np.arange(LIMIT + 1, dtype=np.uint32)
    for c in range(LIMIT):
        s = chr(c)
        category = unicodedata.category(s)
        low = s.lower()
        jamo = 0x1100 <= c < 0x1200
        alone = len(low) == 1 and ord(low) < LIMIT and unicodedata.normalize("NFC", s) == s
        if category[0] == "M" or category in ("Cn", "Cs") or jamo or not alone:
            continue
        lower[c] = ord(low)
        kinds[c] = SPACE if c in SPACES else {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
    return kinds, lower


@dataclass
class Words:
    """Words of a batch in text order: hash, text number, and their code points."""

    hashes: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    points: np.ndarray

    def strings(self, chosen: np.ndarray) -> list[str]:
        """Words as strings; they hold no white space, so they are decoded at once with line ends between."""
        if not len(chosen):
            return []
        lengths = self.ends[chosen] - self.starts[chosen]
        joined = np.full(int(lengths.sum()) + len(chosen) - 1, 10, np.uint32)
        places = np.cumsum(lengths + 1) - lengths - 1
        joined[spans_to_index(places, lengths)] = self.points[spans_to_index(self.starts[chosen], lengths)]
        return joined.tobytes().decode("utf-32-le").split("\n")

    def differ(self, other: np.ndarray) -> np.ndarray:
        """Whether each word is another string than the word of number ``other``, code point by code point."""
        lengths = self.ends - self.starts
        out = lengths != lengths[other]
        lengths = np.where(out | (other == np.arange(len(other))), 0, lengths)
        unequal = self.points[spans_to_index(self.starts, lengths)] != self.points[spans_to_index(self.starts[other], lengths)]
        if unequal.any():
            out[np.repeat(np.arange(len(lengths)), lengths)[unequal]] = True
        return out


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class Splitter:
    """Cuts texts into the words that a tokenizer file's normaliser and pre-tokenizer make of them.

    Texts with rare code points or with an added token's string go through the library's own normaliser
    and pre-tokenizer, as do all texts where the file names other rules than the array path knows.
    """

    def __init__(self, path: str):
        self.path = path
        self.config = read_config(path)
        self.kinds, self.lower = _tables()
        self.mixed = mix(np.arange(LIMIT + 1, dtype=np.uint64) + np.uint64(1))
        steps = [n["type"] for n in (self.config.get("normalizer") or {}).get("normalizers", [])]
        cut = ((self.config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.known = steps == NORMALIZER and cut.get("pattern") == {"Regex": PATTERN} and cut.get("invert") is True
        added = [t["content"] for t in self.config.get("added_tokens", [])]
        self.added = set(added)
        self.marks = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.bytes_of = {v: k for k, v in byte_alphabet().items()}

    @cached_property
    def library(self) -> Tokenizer:
        """Loaded by the first text that needs it."""
        return Tokenizer.from_file(self.path)

    def __call__(self, texts: pa.Array) -> Words:
        points, offsets = code_points(texts)
        at = np.minimum(points, LIMIT)
        kinds, low = self.kinds[at], self.lower[at]
        if self.known:
            strange = kinds == RARE
            for mark in self.added:
                first, second = ord(mark[0]), ord(mark[1]) if len(mark) > 1 else None
                found = points == first
                if second is not None and len(found):
                    found[:-1] &= points[1:] == second
                    found[-1] = False
                strange |= found
        else:
            strange = np.ones(len(points), bool)
        slow = np.zeros(0, np.int64)
        if strange.any():
            seen = np.zeros(len(points) + 1, np.int64)
            np.cumsum(strange, out=seen[1:])
            slow = np.flatnonzero(np.diff(seen[offsets]) > 0)
            for t in slow:
                kinds[offsets[t] : offsets[t + 1]] = SPACE
        starts, ends = self._cut(kinds, low, offsets)
        words = Words(
            SpanHash(self.mixed[low])(starts, ends),
            np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets))),
            starts,
            ends,
            low,
        )
        return self._with_slow(words, texts, slow) if len(slow) else words

    @staticmethod
    def _cut(kinds: np.ndarray, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(kinds)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh = np.zeros(n + 4, bool)
        fresh[offsets[:-1][offsets[:-1] < n]] = True
        fresh[n:] = True
        new = fresh[:n] | (kinds == NUMBER)
        new[1:] |= kinds[1:] != kinds[:-1]
        new &= kinds != SPACE
        # a contraction: an apostrophe that starts a word takes one or two letters with it
        kind = np.append(kinds, [SPACE] * 4)
        point = np.append(low, np.zeros(4, np.uint32))
        a = np.flatnonzero((low == 39) & new)
        a = a[~fresh[a + 1] & (kind[a + 1] == LETTER)]
        one = np.isin(point[a + 1], [ord(c) for c in "stmd"])
        pair = [(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))]
        two = np.zeros(len(a), bool)
        for x, y in pair:
            two |= (point[a + 1] == x) & (point[a + 2] == y) & ~fresh[a + 2]
        new[a[one | two] + 1] = False
        for chosen, step in ((one, 2), (two, 3)):
            after = a[chosen] + step
            after = after[(kind[after] == LETTER) & ~fresh[after]]
            new[after] = True
        stop = np.flatnonzero(new | fresh[:n] | (kinds == SPACE))
        is_start = new[stop]
        return stop[is_start], np.append(stop[1:], n)[is_start]

    def _with_slow(self, words: Words, texts: pa.Array, slow: np.ndarray) -> Words:
        strings, owner = [], []
        for t in slow.tolist():
            found = self.library_words(texts[t].as_py() or "")
            strings += found
            owner += [t] * len(found)
        points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(s) for s in strings], dtype=np.int64) if strings else np.zeros(0, np.int64)
        starts = np.append(0, ends)[:-1].astype(np.int64) if strings else ends
        hashes = SpanHash(mix(points.astype(np.uint64) + np.uint64(1)))(starts, ends)
        text = np.append(words.text, np.array(owner, np.int64))
        order = np.argsort(text, kind="stable")
        base = len(words.points)
        return Words(
            np.append(words.hashes, hashes)[order],
            text[order],
            np.append(words.starts, starts + base)[order],
            np.append(words.ends, ends + base)[order],
            np.append(words.points, points),
        )

    def library_words(self, text: str) -> list[str]:
        """Words and added tokens of one text by the library's normaliser and pre-tokenizer."""
        out = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.added:
                out.append(part)
            elif part:
                plain = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(plain):
                    raw = bytes(self.bytes_of[c] for c in piece)
                    # a run is cut at characters, so its bytes are whole characters
                    out.append(raw.decode("utf-8"))
        return out


def byte_alphabet() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, others for 256, 257, ..."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Growing:
    """An array that more values are added to."""

    def __init__(self, kind: type):
        self.room, self.used = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.room):
            room = np.zeros(end + (end >> 2), self.room.dtype)
            room[: self.used] = self.values
            self.room = room
        self.room[self.used : end] = values
        self.used = end

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.used]


class WordIds:
    """Token ids per distinct word, remembered within a task in arrays: found by its hash, compared by its code points.

    ``encode`` gets the strings of new words and returns their ids, one array for all, and their counts.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.size = 0  # distinct words
        self.hashes = np.zeros(0, np.uint64)  # sorted, with the number of the word of each
        self.entries = np.zeros(0, np.int64)
        self.spelled, self.points = Growing(np.int64), Growing(np.uint32)
        self.ends, self.ids = Growing(np.int64), Growing(np.uint32)
        self.spelled.add(np.zeros(1, np.int64))
        self.ends.add(np.zeros(1, np.int64))

    def _find(self, words: Words, chosen: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, -1 where its hash is new; and whether another word has its hash."""
        found = np.full(len(chosen), -1, np.int64)
        if not self.size:
            return found, np.zeros(len(chosen), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        found[hit] = self.entries[at[hit]]
        first, known = words.starts[chosen[hit]], self.spelled.values[found[hit]]
        lengths = words.ends[chosen[hit]] - first
        other = lengths != self.spelled.values[found[hit] + 1] - known
        lengths[other] = 0
        unequal = words.points[spans_to_index(first, lengths)] != self.points.values[spans_to_index(known, lengths)]
        if unequal.any():
            other[np.repeat(np.arange(len(hit)), lengths)[unequal]] = True
        alien = np.zeros(len(chosen), bool)
        alien[hit[other]] = True
        return found, alien

    def _learn(self, words: Words, chosen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Encode words with new hashes and return their numbers."""
        ids, counts = self.encode(words.strings(chosen))
        lengths = words.ends[chosen] - words.starts[chosen]
        self.points.add(words.points[spans_to_index(words.starts[chosen], lengths)])
        self.spelled.add(self.spelled.values[-1] + np.cumsum(lengths))
        self.ids.add(ids)
        self.ends.add(self.ends.values[-1] + np.cumsum(counts))
        made = np.arange(self.size, self.size + len(chosen))
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.entries = np.insert(self.hashes, at, hashes[order]), np.insert(self.entries, at, made[order])
        self.size += len(chosen)
        return made

    def __call__(self, words: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        if self.size > MOST_WORDS:
            self.forget()
        codes, distinct = pd.factorize(words.hashes)
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        entry, alien = self._find(words, first, distinct)
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = self._learn(words, first[new], distinct[new])
        source, ends = self.ids.values, self.ends.values
        starts, lengths = ends[entry][codes], np.diff(ends)[entry][codes] if len(entry) else np.zeros(0, np.int64)
        strangers = np.flatnonzero(words.differ(first[codes]) | alien[codes])
        if len(strangers):  # other words with the hash of one met before are encoded by themselves
            single, number = np.unique(np.array(words.strings(strangers), object), return_inverse=True)
            ids, counts = self.encode(single.tolist())
            starts[strangers] = (len(source) + np.cumsum(counts) - counts)[number]
            lengths[strangers] = counts[number]
            source = np.append(source, ids.astype(np.uint32))
        flat = source[spans_to_index(starts, lengths)]
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        edges = np.searchsorted(words.text, np.arange(texts + 1))
        return flat, np.diff(total[edges])


def library_encoder(library: Tokenizer) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encode words, already normalised, with the library's model."""
    model = library.model
    added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    letters = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})

    def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spelled = "\n".join(strings).encode().decode("latin-1").translate(letters).split(letters[10]) if strings else []
        found = [
            [added[s]] if s in added else [t.id for t in model.tokenize(p)] for s, p in zip(strings, spelled)
        ]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        return ids, counts

    return encode


assert sys.byteorder == "little"  # ids and code points are read as little-endian arrays
