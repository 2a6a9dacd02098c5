"""Word splitting and hashing of whole texts, batch by batch, with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, after lower-casing A-Z only. Every function
takes UTF-8 bytes (None counts as empty) and handles any length; a window never crosses two texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_bounds(text: bytes) -> np.ndarray:
    """Where each word of a text starts and ends, in bytes, one row a word."""
    b = np.frombuffer(text, np.uint8)
    word = np.zeros(len(b) + 2, bool)
    word[1:-1] = (b != 0x20) & ((b < 0x09) | (b > 0x0D))
    return np.flatnonzero(word[1:] != word[:-1]).reshape(-1, 2)


def hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text starts (one more than texts)."""
    words, seq, lens = indexed(pa.array(texts, pa.binary()))
    return hashes(words.to_numpy(zero_copy_only=False))[seq], np.concatenate([[0], np.cumsum(lens)])


def indexed(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of all texts, each word's place among them, and how many words each text has."""
    texts = pa.compute.fill_null(texts, b"")
    # Split as strings without a look at what they hold: both functions know single bytes only.
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)))
    words, cut = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pa.compute.binary_length(words).to_numpy(zero_copy_only=False) > 0  # space at an end leaves an empty word
    if not full.all():
        words, cut = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[cut]
    found = words.dictionary_encode()
    return found.dictionary.view(pa.binary()), found.indices.to_numpy().astype(np.int64), np.diff(cut).astype(np.int64)


class Windows:
    """Hashes of word windows of any width, each in constant time from one prefix sum."""

    def __init__(self, x: np.ndarray, ends: np.ndarray):
        self.ends, self.n = ends, len(x)
        with np.errstate(over="ignore"):
            self.inv = np.cumprod(np.full(self.n + 1, _BASE_INV, dtype=np.uint64))
            power = np.cumprod(np.full(self.n, _BASE, dtype=np.uint64)) if self.n else x
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x) * power, dtype=np.uint64)])
        self.doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        self.stop = ends[1:][self.doc] if self.n else np.zeros(0, np.int64)

    def at(self, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[starts + width] - self.prefix[starts]) * self.inv[starts] + _U(0) + np.asarray(width).astype(np.uint64))

    def starts(self, width: int) -> np.ndarray:
        """All places at which a window of this width ends inside its text."""
        return np.flatnonzero(np.arange(self.n) + width <= self.stop)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text's whole sequence is one shingle."""
    x, ends = word_hashes(texts)
    win = Windows(x, ends)
    at = win.starts(width)
    h = win.at(at, width)
    cut = np.searchsorted(at, ends)
    out = []
    for i in range(len(texts)):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif ends[i + 1] > ends[i]:
            out.append(win.at(ends[i : i + 1], ends[i + 1] - ends[i]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches that hold about ``limit`` bytes of text at most (one row at least)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        size = np.array([0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()], dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            room = np.searchsorted(np.cumsum(size[start:]), limit, side="right")
            n = max(1, int(room))
            part = batch.slice(start, n)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()
            start += n


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
