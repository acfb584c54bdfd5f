"""Numpy kernels over the Arrow batches that Spark hands to Python.

Words are runs of bytes other than the six ASCII blanks (0x20, 0x09-0x0D), which is what
``bytes.split()`` yields; UTF-8 continuation bytes never collide with those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_MULT), -1, 1 << 64))
_SIGN = _U(1 << 63)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def raw(column: pa.Array) -> list:
    """The column's texts as UTF-8 bytes; None where null."""
    return column.cast(pa.large_binary()).to_pylist()


def word_hashes(words: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64), so that low and high bits are equally good."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_MULT, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``width`` values, modulo 2**64, in O(len(h)).

    Prefix sums of h[i] * M**i; the difference of two prefixes is shifted back by the
    inverse power, so that equal runs hash alike wherever they start.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    up, down = _power_tables(len(h))
    total = np.concatenate((np.zeros(1, _U), np.cumsum(h * up, dtype=_U)))
    return mix((total[width:] - total[:n]) * down[:n] + _U(width))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    m, step = x, 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[:n], m[width - step : width - step + n])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs in the same order."""
    return (x ^ _SIGN).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(_U) ^ _SIGN


def long_lists(arrays: list) -> pa.Array:
    """A list<long> column from int64 arrays."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def list_rows(column: pa.Array) -> list:
    """A list<long> column as int64 arrays (None where null)."""
    if pa.types.is_large_list(column.type) or pa.types.is_list(column.type):
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        return [values[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]
    raise TypeError(str(column.type))
