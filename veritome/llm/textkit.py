"""Whole-batch text primitives on Arrow buffers and numpy.

Operators read documents through ``mapInArrow``; the functions here view an
Arrow string column as one byte buffer with offsets and work on it without a
Python loop over words.  Hashes are 64-bit polynomial prefix hashes (random
byte values, odd base, modulo 2**64) with a final mix: equal bytes give equal
hashes everywhere, and two different strings collide with probability of about
2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text worked on at once; arrays of 8 bytes a byte stay small.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"n": 0, "up": np.ones(1, U64), "down": np.ones(1, U64)}

#: \x20 and \x09-\x0D separate words.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _grow(n: int) -> None:
    if _powers["n"] < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=U64)
        _powers["n"] = n


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Prefix:
    """Prefix hashes of a byte buffer; ``of(starts, ends)`` hashes substrings."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        _grow(n + 1)
        self.sums = np.empty(n + 1, U64)
        self.sums[0] = 0
        np.cumsum(_BYTE[data] * _powers["up"][:n], dtype=U64, out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * _powers["down"][starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most ``most`` bytes (one longer row stays whole): first row, end row, bytes, offsets."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a row's end also ends a word.  ``table`` tells word bytes."""
    is_word = table[data]
    cut = offs[(offs > 0) & (offs < len(data))]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    first[cut] = is_word[cut]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    last[cut - 1] = is_word[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n consecutive words of a row, and the index of its first word."""
    if len(hashes) < n:
        return np.empty(0, U64), np.empty(0, np.int64)
    m = len(hashes) - n + 1
    h = np.full(m, n, U64)
    for k in range(n):
        h = (h ^ hashes[k : k + m]) * U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
    at = np.flatnonzero(rows[: m] == rows[n - 1 :])
    return mix(h[at]), at


def per_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's range of bytes."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def map_documents(
    df: DataFrame,
    compute: Callable[[np.ndarray, np.ndarray], dict],
    fields: list[tuple[str, T.DataType]],
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The id and one computed value a field for every row, in one pass without a shuffle.

    ``compute(bytes, offsets)`` returns an array a field for a run of rows.  All
    other input columns are pruned before Python sees a row.
    """
    narrow = df.select(df[id_col], df[text_col].cast("string").alias("__text"))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(k, t) for k, t in fields)])
    names = [k for k, _ in fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t) for _, t in fields]
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for lo, hi, part, at in slices(data, offs, slice_bytes):
                got = compute(part, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(got[k], type=t) for k, t in zip(names, kinds))],
                    names=[id_col, *names],
                )

    return narrow.mapInArrow(run, schema)
