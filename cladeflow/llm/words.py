"""Words of a text as bytes: ASCII letters in lower case, ASCII digits, and everything above 0x7F."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _table() -> bytes:
    table = bytearray(range(256))
    for code in range(128):
        char = chr(code)
        table[code] = ord(char.lower()) if char.isalnum() else 0x20
    return bytes(table)


WORD_TABLE = _table()


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A factor for each byte and for each of the first places in a word; those of later places are made when met.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = mix64(np.arange(1000, 1064, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def hash_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes, and where each begins. A word's hash depends on the word alone."""
    raw = np.frombuffer(data.translate(WORD_TABLE), np.uint8)
    letter = raw != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    factor = _PLACE[np.minimum(place, len(_PLACE) - 1)]
    far = np.flatnonzero(place >= len(_PLACE))
    if len(far):
        factor[far] = mix64((place[far] + 1000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    factor *= _BYTE[raw[letter]]
    return mix64(np.add.reduceat(factor, first)), starts


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, and how many each text has."""
    data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    hashed, starts = hash_bytes(b" ".join([*data, b""]))
    begins = np.append(0, np.cumsum([len(d) + 1 for d in data]))
    return hashed, np.diff(np.searchsorted(starts, begins))


def shingle_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words; a shorter, non-empty text is one shingle."""
    n = len(word_hash)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += word_hash[k : n - width + 1 + k]
    return mix64(out)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts with about ``most`` bytes of a text column together."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)])
    group = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
