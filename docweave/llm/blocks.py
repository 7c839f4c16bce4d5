"""Text blocks: documents dealt by a hash of their id and text into groups of a few megabytes.

A block is the unit of work of the window operators: its texts lie in one byte
buffer, every value is reduced to one entry per block before it is shuffled, so
even a passage that stands in a third of all documents sends one entry per block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20


def dealt_into_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, id, text) of every row, and the number of blocks, which follows the size of the texts."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    return docs.select(
        # with the text, or all rows of a null or repeated id would fall into one block
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int").alias("block"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
    ), n


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def buffer_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the offsets between them; a null text is empty."""
    chunks = [c for c in texts.chunks if len(c)]
    data, offsets, base = [], [np.zeros(1, np.int64)], 0
    for c in chunks:
        wide = pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)
        off = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        raw = np.frombuffer(c.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        if c.null_count:  # a null may own bytes: close the gaps
            off = off - off[0]
            ok = np.asarray(c.is_valid())
            size = np.where(ok, np.diff(off), 0)
            raw = raw[np.repeat(ok, np.diff(off))]
            off = np.concatenate([[0], np.cumsum(size)])
        data.append(raw)
        offsets.append(off[1:] - off[0] + base)
        base += len(raw)
    return (np.concatenate(data) if data else np.zeros(0, np.uint8)), np.concatenate(offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours: len(x) - width + 1 values."""
    n, span, out = len(x) - width + 1, 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[:n], out[width - span : width - span + n])
    return out[:n]


def runs_of(keys: np.ndarray, valid: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of valid positions with equal keys, cut where `first` is set."""
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = (keys[1:] != keys[:-1]) | first[1:] | ~valid[:-1]
    starts = np.flatnonzero(new & valid)
    stop = np.concatenate([np.flatnonzero(new | ~valid), [len(keys)]])
    return starts, stop[np.searchsorted(stop, starts, "right")] - starts


def home(keys: np.ndarray, homes: int) -> np.ndarray:
    """The group of each key, 0 to homes - 1, rising with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(homes) >> np.uint64(32)).astype(np.int64)


def pieces(sorted_homes: np.ndarray) -> list[tuple[int, int, int]]:
    """(home, from, to) of every stretch of equal homes."""
    if not len(sorted_homes):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(sorted_homes)) + 1, [len(sorted_homes)]])
    return [(int(sorted_homes[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
