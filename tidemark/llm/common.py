"""Helpers shared by the training-data operators: columns by exact name, byte-level word scanning and hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_path, written  # noqa: F401


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    """A top-level column by its exact name, dots and blanks included."""
    return F.col(quoted(name))


def with_columns(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """``schema`` with ``fields`` put in; an input column of the same name gives way."""
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(fields))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- words and shingles, straight from UTF-8 bytes ---------------------------------------------------------------

#: Separators are the bytes 0x20 and 0x09-0x0D; no byte of a multi-byte UTF-8 sequence equals one of them.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, equal for A-Z and a-z.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}
_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        with np.errstate(over="ignore"):
            size = 1 << (n - 1).bit_length()
            for key, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


#: The bytes of ASCII that are neither letters nor digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(data: bytes, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes, start bytes, end bytes) of the words of UTF-8 ``data``, A-Z taken as a-z."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], ~separators[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts, ends
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends


def slices(texts: list[bytes], limit: int = 1 << 20):
    """Runs of ``texts`` of about ``limit`` bytes, each as (first index, texts); a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def shingle_hashes(texts: list[bytes], width: int = 5):
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A text of fewer words has one: its whole word sequence. A text without words has none.
    """
    for _, part in slices(texts):
        hashes, starts, _ = word_hashes(b"\n".join(part))
        bounds = np.cumsum([0] + [len(t) + 1 for t in part])
        at = np.searchsorted(starts, bounds)
        n = len(hashes)
        full = np.zeros(max(0, n - width + 1), dtype=np.uint64)
        for k in range(width):
            full += hashes[k : k + len(full)] * _SHINGLE[k]
        full = mix64(full)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo >= width:
                yield np.unique(full[lo : hi - width + 1])
            elif hi > lo:
                short = (hashes[lo:hi] * _SHINGLE[: hi - lo]).sum(dtype=np.uint64)
                yield mix64(np.array([short + np.uint64(hi - lo)], dtype=np.uint64))
            else:
                yield np.empty(0, dtype=np.uint64)


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
