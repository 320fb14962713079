"""Texts of an Arrow batch as one run of bytes, moved about by displacement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text begins (one entry more than texts); null counts as empty."""
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    begins = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if texts.null_count:  # a null may lie over bytes
        return flat(pa.array([x or b"" for x in texts.cast(pa.binary()).to_pylist()], pa.binary()))
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[begins[0]:begins[-1]], begins - begins[0]


def unflat(data: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The inverse of :func:`flat`, as a binary array."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def displacement(size: int, borders: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """For each of ``size`` bytes how far it moves: stretch k begins at ``borders[k]`` and moves by ``shifts[k]``.

    Every border adds the change of shift to a difference array, whose running sum is the shift.  Borders
    ascend and may repeat (empty stretches): the changes of one place add up to the last of them.
    """
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, borders, np.diff(shifts, prepend=0))
    return np.cumsum(change[:-1])


def stretches(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``begins[k] .. begins[k] + lengths[k] - 1`` of all stretches in a row."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)
