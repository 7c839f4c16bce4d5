"""Windows that repeat across documents: what the two substring operators share.

Two documents that share a window also share the window's smallest gram (its
anchor, by a hash). So each block first sends its distinct anchors, once each;
anchors of a single document are dropped, which leaves only windows that may
repeat. This drops no repeated window: it is a filter on a necessary condition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame

from docweave.llm.blocks import home, packed, pieces

#: Anchors with more occurrences than this are dealt out window by window.
HOT_ANCHOR = 20_000
NOTE = "block int, tag int, data binary, extra binary"

#: In a block: for each run of windows with one anchor its anchor, first window, number of windows and document.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def notes_frame(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    return pa.table(
        {
            "block": pa.array([r[0] for r in rows], pa.int32()),
            "tag": pa.array([r[1] for r in rows], pa.int32()),
            "data": pa.array([r[2] for r in rows], pa.binary()),
            "extra": pa.array([r[3] for r in rows], pa.binary()),
        }
    )


def ids_of(block: pa.Table) -> np.ndarray:
    """Document ids as numbers; a null id counts as the largest."""
    return block.column("id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def in_order(block: pa.Table) -> pa.Table:
    """The rows of a block in an order that every pass over it finds again."""
    return block.take(pa.compute.sort_indices(block.select(["id", "text"]), sort_keys=[("id", "ascending"), ("text", "ascending")])) if block.num_rows > 1 else block


def short_keys(anchors: np.ndarray, homes: int) -> np.ndarray:
    """Home and 32 bits of each anchor: homes grow with the input, so few anchors of a home share their 32 bits.

    Those that do only let a window pass the filter.
    """
    return (home(anchors, homes).astype(np.uint64) << np.uint64(32)) | (anchors & np.uint64(0xFFFFFFFF))


def shared_anchors(blocks: DataFrame, homes: int, runs: Callable[[pa.Table], Runs]) -> DataFrame:
    """Notes to every block (tag 0): which of its anchors also stand in another document, and whether they are hot."""

    def tell(block: pa.Table) -> pa.Table:
        anchors, _, _, doc = runs(block)
        anchors = short_keys(anchors, homes)
        ids = ids_of(block)[doc]
        order = np.lexsort((ids, anchors))
        a, d = anchors[order], ids[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        new_d = new_a | np.concatenate([[True], d[1:] != d[:-1]]) if len(a) else new_a
        at = np.flatnonzero(new_a)
        n = np.minimum(np.add.reduceat(new_d.astype(np.int64), at), 255).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
        a, b = a[at], block.column("block")[0].as_py()
        rows = [(p, b, packed(a[i:j].astype(np.uint32)), packed(n[i:j])) for p, i, j in pieces(a >> np.uint64(32))]
        return pa.table(
            {
                "home": pa.array([r[0] for r in rows], pa.int32()),
                "block": pa.array([r[1] for r in rows], pa.int32()),
                "data": pa.array([r[2] for r in rows], pa.binary()),
                "extra": pa.array([r[3] for r in rows], pa.binary()),
            }
        )

    def weigh(group: pa.Table) -> pa.Table:
        names = group.column("block").to_pylist()
        own_home = np.array([group.column("home")[0].as_py()], np.uint32)
        each = [np.frombuffer(x, np.uint32) for x in group.column("data").to_pylist()]
        anchors = np.concatenate(each)
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("extra").to_pylist()])
        kinds, at = np.unique(anchors, return_inverse=True)
        total = np.bincount(at, weights=n, minlength=len(kinds))
        keep, hot = (total >= 2)[at], (total > HOT_ANCHOR)[at]
        rows, i = [], 0
        for name, own in zip(names, each, strict=True):
            part = slice(i, i := i + len(own))
            if keep[part].any():
                rows.append((name, 0, packed(np.concatenate([own_home, own[keep[part]]])), packed(hot[part][keep[part]])))
        return notes_frame(rows)

    told = blocks.groupBy("block").applyInArrow(tell, "home int, block int, data binary, extra binary")
    return told.groupBy("home").applyInArrow(weigh, NOTE)


def read_anchors(notes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The block's shared anchors, sorted, and whether each is hot."""
    rows = [(d, e) for t, d, e in zip(*(notes.column(c).to_pylist() for c in ("tag", "data", "extra")), strict=True) if t == 0]
    each = [np.frombuffer(d, np.uint32).astype(np.uint64) for d, _ in rows]
    a = np.concatenate([np.zeros(0, np.uint64), *((x[0] << np.uint64(32)) | x[1:] for x in each)])
    hot = np.concatenate([np.zeros(0, bool), *(np.frombuffer(e, bool) for _, e in rows)])
    order = np.argsort(a)
    return a[order], hot[order]


def among(values: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among the sorted kinds, and where."""
    if not len(kinds):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(kinds, values), len(kinds) - 1)
    return kinds[at] == values, at


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """A mask of n places covered by the stretches."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0
