"""Byte-pair encoding and decoding of whole texts, with batched numpy merge rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from hostpulse.llm.common import pieces
from hostpulse.llm.words import Splitter, WordIds, byte_alphabet, read_config

_NONE = np.int64(1 << 40)


class Merges:
    """A merge table as sorted arrays, applied to many words at once."""

    def __init__(self, config: dict):
        model = config["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[alphabet[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        # where every merge comes after those that make its parts, equal pairs of a word merge together
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made] = np.arange(len(made))
        self.ordered = len(np.unique(made)) == len(made) and bool(
            (np.maximum(born[left], born[right]) < np.arange(len(made))).all()
        )
        self.added = {t["content"]: t["id"] for t in config.get("added_tokens", [])}

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        marks = [i for i, s in enumerate(strings) if s in self.added] if self.added else []
        raw = [s.encode("utf-8") for s in strings]
        for i in marks:
            raw[i] = b"."
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        body = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[body]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.final[body[ends - 1]]
        word = np.repeat(np.arange(len(raw)), lengths)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            symbols, word, done = self._round(symbols, word)
            finished.append(done)
        ids = np.concatenate([f[0] for f in finished]) if finished else np.zeros(0, np.int64)
        owner = np.concatenate([f[1] for f in finished]) if finished else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        counts = np.bincount(owner, minlength=len(raw)).astype(np.int64)
        if marks:
            first = np.cumsum(counts) - counts
            for i in marks:
                ids[first[i]] = self.added[strings[i]]
        return ids.astype(np.uint32), counts

    def _round(self, symbols: np.ndarray, word: np.ndarray):
        """Merge each word's lowest-ranked pair; words without one are finished."""
        n = len(symbols)
        same = np.zeros(n, bool)
        same[:-1] = word[1:] == word[:-1]
        pair = symbols.copy()
        pair[:-1] = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        rank = np.where(same & (self.keys[at] == pair), self.rank[at], _NONE)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(first, n))
        lowest = np.minimum.reduceat(rank, first)
        alive = lowest < _NONE
        dead = np.repeat(~alive, size)
        done = symbols[dead], word[dead]
        hit = (rank == np.repeat(lowest, size)) & ~dead
        hit = self._apart(hit, np.repeat(first, size))
        symbols = symbols.copy()
        symbols[hit] = self.made[at[hit]]
        gone = np.append(False, hit[:-1])
        keep = ~gone & ~dead
        return symbols[keep], word[keep], done

    def _apart(self, hit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of hits that overlap, every second one from the left; only the leftmost if merges are unordered."""
        at = np.flatnonzero(hit)
        if not self.ordered:
            out = np.zeros_like(hit)
            out[at[np.append(True, first[at][1:] != first[at][:-1])]] = True
            return out
        start = np.append(True, (np.diff(at) != 1) | (first[at][1:] != first[at][:-1])) if len(at) else hit[:0]
        begin = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        out = np.zeros_like(hit)
        out[at[(np.arange(len(at)) - begin) % 2 == 0]] = True
        return out


def _appended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode_bpe(df: DataFrame, tokenizer: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of a text column as binary: unsigned 32-bit, little-endian.

    ``tokenizer`` is a file of the tokenizers library with a byte-level BPE model; truncation, padding and
    special tokens are not applied, strings of added tokens in a text become their ids.  A null text is
    encoded as an empty one: no ids.  An input column named ``ids_col`` is replaced.  All other columns
    stay.  Rows are independent; repeated rows give repeated results.
    """
    schema = _appended(df, ids_col, T.BinaryType())
    kept = [f.name for f in schema.fields if f.name != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(tokenizer)
        encode = WordIds(Merges(split.config))
        del split.config  # tens of MB in every worker
        for batch in batches:
            for piece in pieces(batch, text_col):
                words = split(piece.column(text_col))
                ids, counts = encode(words, piece.num_rows)
                offsets = np.append(0, np.cumsum(counts * 4))
                column = pa.Array.from_buffers(
                    pa.large_binary(), piece.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), column], names=[*kept, ids_col])

    return df.mapInArrow(run, schema)


def id_strings(tokenizer: str) -> dict[int, str]:
    """The string of every id, added tokens included; nothing for a file that names a decoder.

    Read from the file alone: the library's own tables take several times as much memory, in every worker.
    """
    config = read_config(tokenizer)
    if config.get("decoder") is not None:
        return {}
    return {i: s for s, i in config["model"]["vocab"].items()} | {t["id"]: t["content"] for t in config.get("added_tokens", [])}


def decode_bpe(df: DataFrame, tokenizer: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text that the tokenizer file's decoder gives for a column of ids.

    For files without a decoder that is the ids' strings with blanks between, special tokens included; ids
    that the vocabulary lacks are left out.  Files with a decoder are decoded by the library.  Null
    ids decode to an empty text.  An input column named ``text_col`` is replaced.
    """
    schema = _appended(df, text_col, T.StringType())
    kept = [f.name for f in schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = id_strings(tokenizer)
        library = None if strings else Tokenizer.from_file(tokenizer)

        def text(raw: bytes) -> str:
            ids = np.frombuffer(raw, "<u4").tolist()
            if library:
                return library.decode(ids, skip_special_tokens=False)
            try:
                return " ".join([strings[i] for i in ids])
            except KeyError:
                return " ".join([strings[i] for i in ids if i in strings])

        for batch in batches:
            for piece in pieces(batch, ids_col):
                found = pa.array([text(v.as_buffer() or b"") if v.is_valid else "" for v in piece.column(ids_col)], pa.string())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), found], names=[*kept, text_col])

    return df.mapInArrow(run, schema)
