"""Arrays of numbers as matrices, and exact products of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(column: pa.Array) -> np.ndarray:
    """Number of entries of each vector; -1 for null."""
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows whose vector has ``size`` finite entries, and these entries as doubles."""
    rows = np.flatnonzero(lengths(column) == size)
    taken = column.take(pa.array(rows))
    flat = pc.cast(taken.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    finite = np.isfinite(flat).all(1)
    return rows[finite], flat[finite]


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole numbers as sums of doubles below 2**bits, times 2**(bits * place), lowest place first."""
    sign, rest, out = np.sign(values), np.abs(values), []
    while not out or rest.any():
        out.append((sign * (rest & ((1 << bits) - 1))).astype(np.float64))
        rest = rest >> bits
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact where the results fit in 64 bits.

    Both are split into limbs so short that each double product of limbs sums up to less
    than 2**53; these products are put together in 64-bit whole numbers.
    """
    bits = (53 - max(0, a.shape[1] - 1).bit_length()) // 2
    total = np.zeros((a.shape[0], b.shape[0]), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            total += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return total
