"""Removal of word windows that also stand in an earlier document, by Rabin-Karp hashes counted in Spark.

Every window of 50 words has a rolling polynomial hash (two bases, 128 bits in
all). Windows whose anchor (see `repeats`) stands in one document only cannot
repeat and are left out; of the rest every block sends each hash once, with the
smallest document that holds it. Spark counts the hashes and finds the first document
of each; hashes with an earlier holder go back to their blocks, where
repeated windows merge into maximal removal intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import BLOCK_BYTES, buffer_of, dealt_into_blocks, mixed, packed, runs_of, sliding_min
from docweave.llm.repeats import Runs, among, covered, ids_of, read_anchors, shared_anchors, short_keys

#: Odd multipliers of the rolling hashes: over bytes, over words, over words again.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPANS = pa.list_(pa.struct([pa.field("from", pa.int64()), pa.field("to", pa.int64())]))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(base % 2**64))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def rolling(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of every `width` neighbours of x, modulo 2 ** 64."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(base, len(x)), dtype=np.uint64)])
    return (total[width:] - total[:-width]) * powers(pow(base, -1, 2**64), n)


def words_in(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From/to byte offsets of the words: runs without space or the characters 9 to 13, cut between texts."""
    gap = np.isin(buf, SEPARATORS)
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[True], gap[:-1]]) | cut[:-1] if len(buf) else gap
    after = np.concatenate([gap[1:], [True]]) | cut[1:] if len(buf) else gap
    return np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASES[0], len(buf)), dtype=np.uint64)])
    back = powers(pow(BASES[0], -1, 2**64), len(buf))
    return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASES[1])) if len(starts) else np.zeros(0, np.uint64)


def word_runs(block: pa.Table, length: int, gram: int):
    """Bytes, offsets, word bounds, word hashes, first word of each text, and the runs of windows by anchor."""
    buf, offsets = buffer_of(block.column("text"))
    starts, ends = words_in(buf, offsets)
    hashes = word_hashes(buf, starts, ends)
    heads = np.searchsorted(starts, offsets)
    low = sliding_min(mixed(rolling(hashes, gram, BASES[2])), length - gram + 1) if len(hashes) >= length else np.zeros(0, np.uint64)
    none = np.zeros(0, np.int64)
    runs: Runs = (low, none, none, none)
    if len(low):
        step = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(step, np.maximum(heads[1:] - length + 1, heads[:-1]), 1)
        np.add.at(step, heads[1:], -1)
        valid = np.cumsum(step)[: len(low)] == 0
        first = np.zeros(len(low), bool)
        first[heads[:-1][(np.diff(heads) > 0) & (heads[:-1] < len(low))]] = True
        at, n = runs_of(low, valid, first)
        runs = (mixed(low[at]), at, n, np.searchsorted(heads, at, "right") - 1)
    return buf, offsets, starts, ends, hashes, heads, runs


def likely_windows(block: pa.Table, notes: pa.Table, length: int, gram: int, homes: int):
    """The windows that may repeat: first word, two hashes, document id; and what `word_runs` gives."""
    *rest, runs = word_runs(block, length, gram)
    hashes = rest[4]
    anchor, start, n, doc = runs
    ok, _ = among(short_keys(anchor, homes), read_anchors(notes)[0])
    start, n, doc = start[ok], n[ok], doc[ok]
    back = np.repeat(np.arange(len(start)), n)
    at = start[back] + np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
    one, two = rolling(hashes, length, BASES[1]), rolling(hashes, length, BASES[2])
    return rest, at, one[at], two[at], ids_of(block)[doc[back]] if len(back) else np.zeros(0, np.int64)


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove each word covered by a window of `length` words that also starts in a document of a smaller id.

    Words are runs without space or the characters 9 to 13. Returns a row per input row: id, n_words,
    spans (array of from/to word numbers of the maximal removed runs) and kept (the remaining words joined by one
    space). Null and empty texts have no words. Rows with the same id never match each other; a null id
    counts as larger than any number. Repeats inside one document stay. A very long text is handled whole by one task,
    and so are rows that agree in id and text. Other columns of the input are not looked at and not returned. An empty table gives an empty result.
    """
    gram = max(1, length * 4 // 5)
    blocks, homes = dealt_into_blocks(docs, id_col, text_col, block_bytes)
    notes = shared_anchors(blocks, homes, lambda block: word_runs(block, length, gram)[-1])

    def send(block: pa.Table, told: pa.Table) -> pa.Table:
        one, two, low, name = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        if block.num_rows and told.num_rows:
            name = block.column("block")[0].as_py()
            _, _, one, two, ids = likely_windows(block, told, length, gram, homes)
            order = np.lexsort((ids, two, one))
            one, two, ids = one[order], two[order], ids[order]
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, bool)
            one, two, low = one[new], two[new], ids[new]
        return pa.table([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(low), pa.array(np.full(len(one), name, np.int32))], names=["one", "two", "least", "block"])

    def finish(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table([pa.array([], kind) for kind in (pa.int64(), pa.int64(), SPANS, pa.binary())], names=["id", "n_words", "spans", "kept"])
        if told.num_rows:
            (buf, offsets, starts, ends, _, heads), at, one, two, ids = likely_windows(block, told, length, gram, homes)
            kinds = np.concatenate([np.zeros((0, 2), np.uint64), *(np.frombuffer(d, np.uint64).reshape(-1, 2) for t, d in zip(told.column("tag").to_pylist(), told.column("data").to_pylist(), strict=True) if t == 1)])
            n = len(kinds)
            both = np.concatenate([kinds, np.stack([one, two], 1)])
            _, number = np.unique(both.view([("a", np.uint64), ("b", np.uint64)]).ravel(), return_inverse=True)
            least = np.full(len(both), np.iinfo(np.int64).max)
            np.minimum.at(least, number[n:], ids)
            elsewhere = np.zeros(len(both), bool)
            elsewhere[number[:n]] = True
            gone = at[elsewhere[number[n:]] | (ids > least[number[n:]])]
        else:
            buf, offsets, starts, ends, _, heads, _ = word_runs(block, length, gram)
            gone = np.zeros(0, np.int64)
        lost = covered(gone, np.full(len(gone), length), len(starts))
        first = np.zeros(len(starts), bool)
        first[heads[:-1][np.diff(heads) > 0]] = True
        a, m = runs_of(np.zeros(len(starts), np.int8), lost, first)
        doc = np.searchsorted(heads, a, "right") - 1
        per = np.searchsorted(doc, np.arange(block.num_rows + 1))
        rel = a - heads[doc]
        spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(rel, pa.int64()), pa.array(rel + m, pa.int64())], fields=list(SPANS.value_type)))
        keep = np.flatnonzero(~lost)
        size = (ends - starts)[keep]
        n_kept = np.concatenate([[0], np.cumsum(~lost)])[heads]
        place = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(place[-1], 0x20, np.uint8)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(place[:-1], size) + inside] = buf[np.repeat(starts[keep], size) + inside]
        # every word has a space behind it; the last one of each text falls away
        drop = place[n_kept[1:][np.diff(n_kept) > 0]] - 1
        bounds = place[n_kept] - np.concatenate([[0], np.cumsum(np.diff(n_kept) > 0)])
        kept = pa.Array.from_buffers(pa.binary(), block.num_rows, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(np.delete(out, drop).tobytes())])
        return pa.table([block.column("id"), pa.array(np.diff(heads), pa.int64()), spans, kept], names=["id", "n_words", "spans", "kept"])

    def pack(group: pa.Table) -> pa.Table:
        data = np.stack([group.column(c).combine_chunks().to_numpy() for c in ("one", "two")], 1)
        return pa.table([pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([1], pa.int32()), pa.array([packed(data)], pa.binary()), pa.array([b""], pa.binary())], names=["block", "tag", "data", "extra"])

    sent = blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(send, "one long, two long, least long, block int")
    # a hash has a row per block at most, so one exchange serves both the count and the way back
    sent = sent.where("one is not null and two is not null and least is not null and block is not null").repartition("one", "two")
    counts = sent.groupBy("one", "two").agg(F.count("block").alias("n_blocks"), F.min("least").alias("first_id")).where("n_blocks > 1")
    earlier = sent.join(counts, ["one", "two"]).where("first_id < least").select("block", "one", "two")
    replies = earlier.groupBy("block").applyInArrow(pack, "block int, tag int, data binary, extra binary")
    out = blocks.groupBy("block").cogroup(notes.unionByName(replies).groupBy("block")).applyInArrow(finish, "id long, n_words long, spans array<struct<from: long, to: long>>, kept binary")
    return out.withColumnRenamed("id", id_col).withColumn("kept", F.col("kept").cast("string"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the digest of every document of `documents` after removal of repeated windows of 50 words."""
    from docweave.functions.session import spread, table

    out = remove_repeated_windows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM p),
f AS (SELECT s, min(doc_id) AS least FROM k GROUP BY s),
g AS (SELECT DISTINCT doc_id, i + x AS i FROM (SELECT k.doc_id, k.i, unnest(range(0, 50)) AS x FROM k JOIN f USING (s) WHERE f.least < k.doc_id)),
v AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
r AS (SELECT v.doc_id, count(g.i) AS gone, string_agg(v.word, ' ' ORDER BY v.i) FILTER (WHERE g.i IS NULL) AS kept FROM v LEFT JOIN g ON v.doc_id = g.doc_id AND v.i = g.i GROUP BY v.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.gone, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
