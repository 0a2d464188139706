"""Helpers shared by the operators of this subpackage: shared storage, Arrow buffers and 64-bit rolling hashes.

Everything here works on whole Arrow batches: texts stay in the one contiguous UTF-8 buffer that Arrow hands over, and
numpy runs over that buffer instead of over Python strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tephra.sources.scratch import discard as discard
from tephra.sources.scratch import materialized
from tephra.sources.scratch import temporary as temporary

MASK64 = (1 << 64) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_LOWER_ASCII = np.arange(256, dtype=np.uint8)
_LOWER_ASCII[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    return materialized(df, name)


#: Partitions up to which they stay small, and bytes of each beyond that.
SMALL_PARTS, LARGE_PART = 512, 512 << 20


def parts_for(n_bytes: float, per_part: int = 16 << 20, least: int = 1) -> int:
    """Number of partitions for so many bytes: small ones for a small table, large ones that stream for a large table.

    It grows with the table once all of ``SMALL_PARTS`` are large, so that 100 TB make some 200,000 partitions.
    """
    small = int(n_bytes // per_part) + 1
    return max(least, small if small <= SMALL_PARTS else max(SMALL_PARTS, int(n_bytes // LARGE_PART) + 1))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty. Offsets start at 0 and have len + 1 entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(
        column.buffers()[1], np.int64 if wide else np.int32
    )[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(offs: np.ndarray, most: int = 1 << 19) -> list[tuple[int, int]]:
    """Row ranges [i, j) of at most ``most`` bytes and 4096 rows (one row at least), so that scratch arrays stay small."""
    out, i, n = [], 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        out.append((i, min(j, n, i + 4096)))
        i = out[-1][1]
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all input bits (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_BYTE_CODES_LOWER = _BYTE_CODES[_LOWER_ASCII]
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0..n modulo 2**64; grown on demand and kept in the worker."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n < 4 << 20:
            _powers[int(base)] = have
    return have[: n + 1]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of codes[i] * BASE**i; :func:`span_hash` turns differences of them into hashes of spans."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes), BASE)[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], equal for equal spans wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), BASE_INV)[start] + (end - start).astype(np.uint64))


def byte_codes(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    return (_BYTE_CODES_LOWER if lower else _BYTE_CODES)[raw]


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[raw]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, A-Z in lower case."""
    start, end, row = words(raw, offs)
    return span_hash(prefix_hash(byte_codes(raw, lower=True)), start, end), row


def shingles(raw: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(52-bit hash, row) of the distinct ``size``-word shingles of each of up to 4096 rows, sorted by row, then hash.

    Rows with fewer words give their whole sequence as one shingle; rows without words give none.
    """
    word, row = word_hashes(raw, offs)
    n, rows = len(word), len(offs) - 1
    prefix = prefix_hash(word)
    first = np.arange(max(0, n - size + 1))
    first = first[row[first] == row[first + size - 1]] if len(first) else first
    hashes, owner = span_hash(prefix, first, first + size), row[first]
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = np.searchsorted(row, short)
        hashes = np.concatenate([hashes, span_hash(prefix, at, at + count[short])])
        owner = np.concatenate([owner, short])
    # 52 bits of hash and 12 bits of row sort as one number.
    order = (owner.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12))
    order.sort()
    if len(order):
        order = order[np.append(True, order[1:] != order[:-1])]
    return order & np.uint64((1 << 52) - 1), (order >> np.uint64(52)).astype(np.int64)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    """A list column with so many of the values in each row."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values)
