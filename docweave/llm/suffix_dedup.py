"""Removal of byte strings that also stand in an earlier document, by bucket-pointer refinement.

Plan. Texts are dealt into blocks; anchors of windows (see `repeats`) are
compared across blocks; the windows left are sent, as stretches of text that
share an anchor, to the anchor's home; equal stretches of a block go once, with the smallest document that has them. There the
suffixes of the distinct stretches are bucket-sorted: initial buckets are 8-gram buckets, which are refined one after the other by
the bucket pointers at a later offset; pointers are written in place, so buckets refined later use those refined before, and
a bucket's depth grows by the depth of the bucket pointed to. The smallest document of each bucket decides which windows go. Stretches
that share their anchor with no other distinct stretch need no sort: their windows are buckets of their own.
Windows of an anchor with very many occurrences are sent one by one to the home of a hash of
the window's own bytes, so no group grows with the copies of one passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import BLOCK_BYTES, buffer_of, dealt_into_blocks, mixed, packed, pieces, runs_of, sliding_min
from docweave.llm.repeats import NOTE, Runs, among, covered, ids_of, in_order, notes_frame, read_anchors, shared_anchors, short_keys

QGRAM = 8
SLICE = 1 << 20
#: Places sorted together where buckets are small.
BATCH = 1 << 15


def words_at(buf: np.ndarray, n: int, offset: int = 0) -> np.ndarray:
    """The 8 bytes from each of the first n places on, as numbers; buf is padded by 8."""
    return np.ndarray((n,), ">u8", buf, offset, (1,)).astype(np.uint64)


def window_anchors(buf: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window start the hash of the smallest gram in it; `buf` padded by 16 bytes at least."""
    n = len(buf) - 16 - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for a in range(0, n, SLICE):
        m = min(SLICE, n - a)
        part = buf[a : a + m + length + 16]
        k = m + length - gram
        g = words_at(part, k)
        if gram < 8:
            g >>= np.uint64(64 - 8 * gram)
        else:
            g *= np.uint64(0xA24BAED4963EE407)
            g ^= words_at(part, k, gram - 8)
        if gram > 16:
            g = mixed(g) ^ words_at(part, k, gram // 2 - 4)
        out[a : a + m] = sliding_min(mixed(g), length - gram + 1)[:m]
    return out


def byte_runs(block: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, Runs]:
    """The block's bytes and offsets, and its runs of windows."""
    buf, offsets = buffer_of(block.column("text"))
    wide = np.concatenate([buf, np.zeros(16, np.uint8)])
    low = window_anchors(wide, length, gram)
    none = np.zeros(0, np.int64)
    if not len(low):
        return buf, offsets, (low, none, none, none)
    step = np.zeros(len(buf) + 1, np.int32)
    sizes = np.diff(offsets)
    np.add.at(step, np.maximum(offsets[1:] - length + 1, offsets[:-1]), 1)
    np.add.at(step, offsets[1:], -1)
    valid = np.cumsum(step)[: len(low)] == 0
    first = np.zeros(len(low), bool)
    heads = offsets[:-1][(sizes > 0) & (offsets[:-1] < len(low))]
    first[heads] = True
    starts, n = runs_of(low, valid, first)
    return buf, offsets, (mixed(low[starts]), starts, n, np.searchsorted(offsets, starts, "right") - 1)


def refined_buckets(text: np.ndarray, starts: np.ndarray, length: int, batch: int = BATCH) -> np.ndarray:
    """A bucket number for each start: equal numbers mean equal strings of `length` bytes; text: padded by 8, the string of every start inside.

    Suffixes are sorted into buckets by their first QGRAM bytes; the bucket pointer of a place is the last rank of its bucket. The
    buckets with several starts are then refined one after the other, from the left: members are sorted by the pointers at the offset of the bucket's
    depth, the pointers of the new buckets are written at once and so are used by every bucket refined after it. A new bucket's depth grows
    by the depth of the bucket its members pointed to, so what was refined before is not compared again. Small buckets
    that lie side by side are sorted together, about `batch` places at a time. In the end the order decides: neighbours in it are one bucket if `length` bytes agree.
    """
    n = len(text) - 8
    q = min(QGRAM, length)
    if not len(starts):
        return np.zeros(0, np.int64)
    code = words_at(text, n)
    if q < 8:
        code >>= np.uint64(64 - 8 * q)
    order = np.argsort(code)
    ranked = code[order]
    last = np.flatnonzero(np.concatenate([ranked[1:] != ranked[:-1], [True]]))
    sizes = np.diff(np.concatenate([[-1], last]))
    # ranks from 1 on; what lies behind the text comes before everything
    pointer = np.zeros(n + length, np.int64)
    pointer[order] = np.repeat(last + 1, sizes)
    depth = np.full(n + 1, q, np.int16)  # by pointer
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    # a bucket is refined with all its members or not at all, or its pointers could not be held against each other
    many = np.add.reduceat(wanted[order].astype(np.int64), last - sizes + 1) > 1
    todo = [order[np.repeat(many, sizes)]]
    del order, ranked, code
    while todo:
        members, todo = todo[0], []
        heads = np.flatnonzero(np.concatenate([[True], pointer[members[1:]] != pointer[members[:-1]]])) if len(members) else np.zeros(0, np.int64)
        cut = np.searchsorted(heads, np.arange(0, len(members), batch))
        cut = np.unique(np.concatenate([heads[np.minimum(cut, len(heads) - 1)], [len(members)]])) if len(heads) else np.zeros(1, np.int64)
        again = []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = members[i:j]
            here = pointer[own]
            d = depth[here].astype(np.int64)
            there = pointer[own + np.minimum(d, length - q)]
            by = np.lexsort((there, here))
            own, here, there, d = own[by], here[by], there[by], d[by]
            end = np.concatenate([(here[1:] != here[:-1]) | (there[1:] != there[:-1]), [True]])
            # the last member's rank within the old bucket names the new one
            stop = np.flatnonzero(end)
            size = np.diff(np.concatenate([[-1], stop]))
            bucket_end = np.flatnonzero(np.concatenate([here[1:] != here[:-1], [True]]))
            behind = bucket_end[np.searchsorted(bucket_end, stop)] - stop
            name = here[stop] - behind
            step = np.minimum(d[stop], length - q) + depth[there[stop]]
            pointer[own] = np.repeat(name, size)
            depth[name] = np.minimum(step, length)
            n_starts = np.add.reduceat(wanted[own].astype(np.int64), stop - size + 1)
            open_ = np.repeat((n_starts > 1) & (step < length), size)
            again.append(own[open_])
        if again and sum(map(len, again)):
            todo.append(np.concatenate(again))
    order = starts[np.argsort(pointer[starts], kind="stable")]
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, length - 7, 8), max(length - 8, 0)]:
        shift = np.uint64(max(64 - 8 * length, 0))
        same &= eight(text, order[1:] + at) >> shift == eight(text, order[:-1] + at) >> shift
    out = np.empty(n, np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~same)])
    return out[starts]


def eight(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as numbers."""
    return np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))[at].astype(np.uint64)


def stretches(block: pa.Table, notes: pa.Table, length: int, gram: int, homes: int):
    """The distinct stretches of windows that may repeat, and where they stand.

    Returns bytes, offsets, per stretch (key, text start, windows), its smallest document,
    and per occurrence (stretch, first window, document id).
    """
    buf, offsets, (anchor, start, n, doc) = byte_runs(block, length, gram)
    kinds, hot = read_anchors(notes)
    anchor = short_keys(anchor, homes)
    ok, at = among(anchor, kinds)
    start, n, doc, key = start[ok], n[ok], doc[ok], anchor[ok]
    is_hot = hot[at[ok]] if len(hot) else np.zeros(len(start), bool)
    if is_hot.any():  # window by window
        many = np.where(is_hot, n, 1)
        back = np.repeat(np.arange(len(start)), many)
        nth = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many)
        one = is_hot[back]
        start, n, doc, key = start[back] + np.where(one, nth, 0), np.where(one, 1, n[back]), doc[back], key[back]
    else:
        one = is_hot
    ids = ids_of(block)[doc]
    raw = buf.tobytes()
    seen: dict[bytes, int] = {}
    which = np.fromiter((seen.setdefault(raw[s : s + m + length - 1], len(seen)) for s, m in zip(start.tolist(), n.tolist(), strict=True)), np.int64, len(start))
    _, lead = np.unique(which, return_index=True)
    least = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    key = key[lead].copy()
    for i in np.flatnonzero(one[lead]):
        s = int(start[lead[i]])
        key[i] = short_keys(np.array([hash_bytes(raw[s : s + length])], np.uint64), homes)[0]
    return buf, offsets, (key, start[lead], n[lead]), least, (which, start, ids)


def repeated_windows(texts: list[bytes], least: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first window, windows): the runs of windows of distinct stretches that also stand in a stretch of a smaller `least`.

    Stretches that share their anchor with no other one are left out before the sort.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
    anchor = window_anchors(text, length, gram)[np.cumsum(sizes) - sizes]
    _, at, many = np.unique(anchor, return_inverse=True, return_counts=True)
    pick = np.flatnonzero(many[at] > 1)
    if not len(pick):
        return pick, pick, pick
    text = np.frombuffer(b"".join([texts[i] for i in pick]) + bytes(8), np.uint8)
    sizes = sizes[pick]
    windows = sizes - length + 1
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(pick)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    bucket = refined_buckets(text, (ends - sizes)[owner] + inside, length)
    low = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, bucket, least[pick][owner])
    first = np.zeros(len(owner), bool)
    first[np.cumsum(windows) - windows] = True
    a, m = runs_of(np.zeros(len(owner), np.int8), low[bucket] < least[pick][owner], first)
    return pick[owner[a]], inside[a], m


def hash_bytes(x: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts in a document of a smaller id.

    Returns a row per input row: id, n_bytes, spans (array of from/to byte offsets of the
    maximal removed runs) and kept (the remaining bytes, which may not be whole UTF-8).
    Null and empty texts give no bytes and no spans. Rows with the same id never match each other;
    a null id counts as larger than any number. Repeats inside one document stay. A very long text is
    handled whole by one task, and so are rows that agree in id and text.
    Other columns of the input are not looked at and not returned. An empty table gives an empty result.
    """
    gram = max(1, length // 2)
    blocks, homes = dealt_into_blocks(docs, id_col, text_col, block_bytes)
    notes = shared_anchors(blocks, homes, lambda block: byte_runs(block, length, gram)[2])

    def send(block: pa.Table, told: pa.Table) -> pa.Table:
        block, rows = in_order(block), []
        if block.num_rows and told.num_rows:
            buf, _, (key, start, n), least, _ = stretches(block, told, length, gram, homes)
            order = np.argsort(key, kind="stable")
            name = block.column("block")[0].as_py()
            for p, i, j in pieces(key[order] >> np.uint64(32)):
                own = order[i:j]
                raw = b"".join(buf[s : s + m + length - 1].tobytes() for s, m in zip(start[own], n[own], strict=True))
                rows.append((p, name, packed(own.astype(np.int32)), packed(n[own].astype(np.int32)), packed(least[own]), raw))
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["home", "block", "nth", "windows", "least", "raw"])

    def settle(group: pa.Table) -> pa.Table:
        column = {c: group.column(c).to_pylist() for c in group.column_names}
        nth = [np.frombuffer(x, np.int32) for x in column["nth"]]
        windows = np.concatenate([np.frombuffer(x, np.int32) for x in column["windows"]]).astype(np.int64)
        least = np.concatenate([np.frombuffer(x, np.int64) for x in column["least"]])
        sizes = windows + length - 1
        ends = np.cumsum(sizes)
        raw = b"".join(column["raw"])
        seen: dict[bytes, int] = {}
        which = np.fromiter((seen.setdefault(raw[i:j], len(seen)) for i, j in zip((ends - sizes).tolist(), ends.tolist(), strict=True)), np.int64, len(ends))
        low = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(low, which, least)
        again = least > low[which]  # an earlier document holds the whole stretch
        run, a, m = repeated_windows(list(seen), low, length, gram)
        lead = np.flatnonzero(~again)
        lo, hi = np.searchsorted(run, which[lead], "left"), np.searchsorted(run, which[lead], "right")
        back = np.repeat(lead, hi - lo)
        r = np.arange(len(back)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        owner = np.concatenate([np.flatnonzero(again), back])
        out = np.stack([np.concatenate(nth)[owner], np.concatenate([np.zeros(again.sum(), np.int64), a[r]]), np.concatenate([windows[again], m[r]])], 1).astype(np.int32)
        names = np.repeat(np.array(column["block"]), [len(x) for x in nth])[owner]
        order = np.argsort(names, kind="stable")
        return notes_frame([(p, 1, packed(out[order[i:j]]), b"") for p, i, j in pieces(names[order])])

    def finish(block: pa.Table, told: pa.Table) -> pa.Table:
        block = in_order(block)
        if not block.num_rows:
            return pa.table([pa.array([], kind) for kind in (pa.int64(), pa.int64(), SPANS, pa.binary())], names=["id", "n_bytes", "spans", "kept"])
        if told.num_rows:
            buf, offsets, (_, _, n), least, (which, start, ids) = stretches(block, told, length, gram, homes)
            replies = [np.frombuffer(d, np.int32).reshape(-1, 3) for t, d in zip(told.column("tag").to_pylist(), told.column("data").to_pylist(), strict=True) if t == 1]
            reply = np.concatenate([np.zeros((0, 3), np.int32), *replies]).astype(np.int64)
            later = ids > least[which]  # an earlier document of this block holds the same stretch
            reply = reply[np.argsort(reply[:, 0], kind="stable")]
            own = np.flatnonzero(~later)
            lo, hi = np.searchsorted(reply[:, 0], which[own], "left"), np.searchsorted(reply[:, 0], which[own], "right")
            back = np.repeat(own, hi - lo)
            r = np.arange(len(back)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            a = np.concatenate([start[later], start[back] + reply[r, 1]])
            size = np.concatenate([n[which[later]], reply[r, 2]]) + length - 1
            gone = covered(a, size, len(buf))
        else:
            buf, offsets = buffer_of(block.column("text"))
            gone = np.zeros(len(buf), bool)
        first = np.zeros(len(buf), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        a, m = runs_of(np.zeros(len(buf), np.int8), gone, first)
        doc = np.searchsorted(offsets, a, "right") - 1
        per = np.searchsorted(doc, np.arange(block.num_rows + 1))
        rel = a - offsets[doc]
        kept_at = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(rel, pa.int64()), pa.array(rel + m, pa.int64())], fields=list(SPANS.value_type)))
        kept = pa.Array.from_buffers(pa.binary(), block.num_rows, [None, pa.py_buffer(kept_at.astype(np.int32).tobytes()), pa.py_buffer(buf[~gone].tobytes())])
        return pa.table([block.column("id"), pa.array(np.diff(offsets), pa.int64()), spans, kept], names=["id", "n_bytes", "spans", "kept"])

    sent = blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(send, "home int, block int, nth binary, windows binary, least binary, raw binary")
    replies = sent.groupBy("home").applyInArrow(settle, NOTE)
    out = blocks.groupBy("block").cogroup(notes.unionByName(replies).groupBy("block")).applyInArrow(finish, "id long, n_bytes long, spans array<struct<from: long, to: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


SPANS = pa.list_(pa.struct([pa.field("from", pa.int64()), pa.field("to", pa.int64())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the digest of every document of `documents` after removal of repeated 50-byte strings."""
    from docweave.functions.session import spread, table

    out = remove_repeated_bytes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM d),
k AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM w),
f AS (SELECT s, min(doc_id) AS least FROM k GROUP BY s),
g AS (SELECT k.doc_id, k.p FROM k JOIN f USING (s) WHERE f.least < k.doc_id),
o AS (SELECT doc_id, p, coalesce(p > max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM g),
n AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY doc_id, run),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
c AS (SELECT t.doc_id, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS spans FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(c.gone, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(c.head || substr(d.h, 2 * c.last + 1), d.h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
