"""Vectors of floating-point numbers as integers, floor(scale * x), and exact products of them in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Components beyond this would let a product of two vectors leave 64 bits.
LARGEST = 1 << 26
#: Numbers below this are exact as doubles.
EXACT = 1 << 53


def usable_rows(column: pa.Array, components: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (their numbers) without a null or a non-finite component, of ``components`` components if that is given; their lengths; and all their components one after another.

    ``column``: list<double>.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lengths)), lengths)
    good = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    good[of[~np.isfinite(flat)]] = False
    if components is not None:
        good &= lengths == components
    rows = np.flatnonzero(good)
    return rows, lengths[rows], flat[good[of]]


def scaled(values: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    with np.errstate(over="ignore"):
        whole = np.floor(values * float(scale))
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component of {np.abs(values).max()} is too large: at scale {scale}, products would leave 64 bits")
    return whole.astype(np.int64)


def padded(lengths: np.ndarray, flat: np.ndarray, width: int | None = None) -> np.ndarray:
    """One row for each vector; missing components are 0."""
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def packed(vectors: np.ndarray) -> tuple[str, bytes]:
    """The vectors in as few bytes as hold them, and the type of those."""
    most = int(np.abs(vectors).max(initial=0))
    kind = "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4"
    return kind, np.ascontiguousarray(vectors).astype(kind).tobytes()


def unpacked(kind: str, raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(rows, -1).astype(np.int64)


def arithmetic(*tables: np.ndarray, factor: int = 1) -> type:
    """The type in which products of the tables' rows, times ``factor``, are exact: doubles (faster) where they suffice."""
    most = max((int(np.abs(x).max(initial=0)) for x in tables), default=0)
    width = max(x.shape[1] for x in tables)
    return np.float64 if most * most * max(width, 1) * factor < EXACT else np.int64
