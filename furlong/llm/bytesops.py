"""Array operations on the UTF-8 bytes of text columns, inside Arrow tasks.

A batch is cut at row boundaries into slices of about ``SLICE`` bytes, so the
scratch arrays stay small whatever the batch; a longer text is a slice alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(array: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice."""
    data, offs = buffers(array)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of the class, none across a row, and
    each row's first run."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = table[data]
    edge = np.empty(len(m), bool)
    edge[0] = True
    np.logical_not(m[:-1], out=edge[1:])
    edge[offs[:-1][offs[:-1] < len(m)]] = True
    starts = np.flatnonzero(m & edge)
    edge[-1] = True
    np.logical_not(m[1:], out=edge[:-1])
    edge[offs[1:][offs[1:] > 0] - 1] = True
    ends = np.flatnonzero(m & edge) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of the hash base, grown to the longest slice seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE + 1)
            self.up = np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP_INV)]).cumprod(dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span`` takes the hash of any substring."""
    up, _ = POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def span(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((p[e] - p[s]) * POWERS.to(len(p))[1][s])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of rows sorted by ``keys``: tables of whole groups, and where each group
    begins (with the end). Only the group that is still open is held back."""
    held: list[pa.RecordBatch] = []

    def changes(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        new = np.zeros(max(0, batch.num_rows - 1), bool)
        for k in keys:
            c = batch.column(k)
            c = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).to_numpy(zero_copy_only=False)
            new |= c[1:] != c[:-1]
        return np.flatnonzero(new) + 1

    def table(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, np.concatenate([[0], changes(t), [t.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        at = changes(batch)
        if len(at):
            yield table([*held, batch.slice(0, int(at[-1]))])
            held = [batch.slice(int(at[-1]))]
        elif held and any(held[-1].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield table(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield table(held)
