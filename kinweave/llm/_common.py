"""Storage and byte helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..storage import fresh_path, storage_root, write_table

__all__ = ["BLANKS", "LOWER_CODE", "U64", "digest128", "fresh_path", "hash_words", "mix64", "shuffle_parts", "slices", "storage_root", "tidied", "unused", "word_hash", "word_spans", "write_table"]

#: The bytes that separate words and are stripped from lines: space and 0x09 to 0x0D.
BLANKS = b" \t\n\x0b\x0c\r"

U64 = np.uint64


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, where its library can."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back to the system at its end: Python workers are reused, and what one task has freed would count against the next."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind where df has columns of these names (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def digest128(keys: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two int64 arrays with the 128-bit hashes of the keys."""
    raw = b"".join(map(xxhash.xxh3_128_digest, keys))
    two = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
    return np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1])


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _table(values: Iterable[int]) -> np.ndarray:
    return np.array(list(values), dtype=U64)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True
#: The code of a byte with A-Z lowered, plus 1.
_CODE = LOWER_CODE = _table((c + 32 if 65 <= c <= 90 else c) + 1 for c in range(256))
#: An odd factor for each place in a word; beyond, it is computed.
_PLACES = 1024
_FACTOR = mix64(np.arange(1, _PLACES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
#: Bytes that are hashed at once; a single longer word is taken whole.
_PIECE = 1 << 18


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start, their sizes, and the places of all their bytes, in a piece that ends with a blank."""
    inside = ~_BLANK[raw]
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(before & ~inside) - starts, np.flatnonzero(inside)


def _hash_piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a piece that ends with a blank."""
    starts, sizes, at = word_spans(raw)
    if not len(starts):
        return np.empty(0, dtype=U64), starts
    return word_hash(raw, starts, sizes, at, _CODE), starts


def word_hash(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of the words by the codes of their bytes; bytes of code 0 don't count."""
    place = at - np.repeat(starts, sizes)
    factor = _FACTOR[np.minimum(place, _PLACES - 1)]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        factor[far] = mix64((place[far] + 1).astype(U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    code = codes[raw[at]]
    counted = np.add.reduceat((code > 0).astype(np.int64), first).astype(U64)
    return mix64(np.add.reduceat(code * factor, first) ^ (counted * U64(0xD6E8FEB86659FD93)))


def hash_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, A-Z lowered, and the number of words of each text.

    A hash is a sum of the word's bytes times random factors of their places, spread over all bits.
    """
    sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", dtype=np.uint8)
    hashes, starts, lo = [], [], 0
    while lo < len(raw):
        hi = min(len(raw), lo + _PIECE)
        if hi < len(raw):
            blanks = np.flatnonzero(_BLANK[raw[lo:hi]])
            while not len(blanks):  # a word longer than a piece
                more = np.flatnonzero(_BLANK[raw[hi : hi + _PIECE]])
                blanks = more[:1] + (hi - lo)
                hi += _PIECE
            hi = lo + int(blanks[-1]) + 1
        h, s = _hash_piece(raw[lo:hi])
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    ends = np.cumsum(sizes + 1)
    counts = np.bincount(np.searchsorted(ends, np.concatenate(starts), side="right"), minlength=len(texts)) if len(texts) else np.empty(0, dtype=np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, dtype=U64), counts


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the byte column of each piece stays near most_bytes; a single row may exceed it."""
    col = batch.column(column)
    sizes = np.fromiter((0 if n is None else n for n in pc.binary_length(col).to_pylist()), dtype=np.int64, count=len(col))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
