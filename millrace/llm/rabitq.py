"""One-bit codes of randomly rotated vectors, and what they estimate.

A unit vector o is rotated by a fixed random orthogonal matrix and kept as the signs x of its components, packed into bits, with the
factor f = <x / sqrt(D), rotated o>. For a unit query q, <x / sqrt(D), rotated q> / f estimates <o, q> without bias; its error is below
EPSILON * sqrt((1 - f^2) / f^2 / (D - 1)) but for rare cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

EPSILON = 1.9

_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int = 1) -> np.ndarray:
    """An orthogonal matrix, the same in every process."""
    if (dim, seed) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
        _ROTATIONS[dim, seed] = (q * np.sign(np.diag(r))).astype(np.float32)
    return _ROTATIONS[dim, seed]


def encode(unit: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (n, ceil(D / 8)) and factors (n,) of unit vectors (n, D)."""
    turned = unit.astype(np.float32) @ rotation(unit.shape[1], seed).T
    return np.packbits(turned > 0, axis=1), np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1]), 1e-6)


def signs(bits: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1


def estimate(queries: np.ndarray, bits: np.ndarray, factors: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit queries with the coded vectors (q, n), and the bound of each vector's error (n,)."""
    dim = queries.shape[1]
    turned = queries.astype(np.float32) @ rotation(dim, seed).T
    bound = EPSILON * np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / max(1, dim - 1))
    return turned @ signs(bits, dim).T / (np.sqrt(dim) * factors), bound


def binary(bits: np.ndarray) -> pa.Array:
    """Packed bits as an Arrow column, one value for each row."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())


def packed(codes) -> np.ndarray:
    """The matrix of bytes of such a column's values, which are equally long."""
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def by_dim(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Slices of the batches with one `dim` each, that dim, and their `v` as unit vectors."""
    for batch in slices(batches, rows):
        for dim in np.unique(batch.column("dim").to_numpy()):
            some = batch.filter(pc.equal(batch.column("dim"), pa.scalar(dim, pa.int32())))
            v = vectors(some.column("v"))
            yield some, int(dim), v / np.linalg.norm(v, axis=1)[:, None]


def vectors(column) -> np.ndarray:
    """Arrow list column of equally long lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
