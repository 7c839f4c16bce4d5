"""Near-duplicate documents by SimHash fingerprints, found by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Of two fingerprints with at most 3 differing bits, one segment differs in at most one bit. So each
fingerprint stands in a table by the value of each segment, and asks the tables for the Hamming ball of radius 1 around its own values; of
two values that differ in one bit, only the one without that bit asks. What a table fetches is verified by the whole distance.

Documents with the same fingerprint are one node. A bucket (segment, value) holds its members and those that ask for it. Buckets are packed
into tasks of bounded size; a large one is cut into cells, a slice of its members against a slice of all its rows. A task compares
the pairs of its cells in arrays and returns a forest of links, at most one for each fingerprint that it has, so no pair is a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.session import release, spool
from docweave.llm.components import components

BITS, SEGMENT = 64, 32
#: Shingles whose bits are added up at a time.
CHUNK = 1 << 15
#: Buckets up to WHOLE rows are one cell, and cells of about PART_ROWS rows together are one task; larger buckets are cut into slices of WHOLE rows.
WHOLE, PART_ROWS = 2048, 20_000
#: Linked pairs that a task holds before it keeps only a forest of them.
HELD = 1 << 20


def fingerprint(text: str | None, k: int, seed: int = 42) -> int:
    """The bits set in over half of the XXH64 of all k-word shingles; fewer words are one shingle, none give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both of them
    if not words:
        return 0
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    data = b" ".join(words)
    k = min(k, len(words))
    ends = np.cumsum(sizes) - 1
    starts, ends = (ends - sizes + 1)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = b"".join([digest(data[a:b], seed) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, fp) of every row; the fingerprint as a number of 64 bits with a sign."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, k) for x in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def links_of(rows: pa.Table, most: int) -> pa.Table:
    """(a, b): links that tie together the fingerprints of the rows as the pairs of their cells with at most `most` differing bits do. rows: cell, fp, left, right; a pair is one of a
    left and another right row of a cell."""
    cell, fp = rows.column("cell").to_numpy(), rows.column("fp").to_numpy()
    left, right = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right"))
    names, node = np.unique(fp, return_inverse=True)
    order = np.lexsort((~left, cell))
    cell, node, left, right = cell[order], node[order], left[order], right[order]
    bits = names.view(np.uint64)[node]
    label, held, size = np.arange(len(names)), [], 0

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal label, size
        near = np.bitwise_count(bits[x] ^ bits[y]) <= most
        held.append((node[x[near]], node[y[near]]))
        size += int(near.sum())
        if size > HELD:
            settle()

    def settle() -> None:
        nonlocal label, size
        if held:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            label = forest(len(names), np.concatenate([a, np.arange(len(names))]), np.concatenate([b, label]))
        held.clear()
        size = 0

    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff([*heads, len(cell)])
    last = np.repeat(heads + sizes, sizes)  # where each row's cell ends
    small = np.repeat(sizes <= 64, sizes)
    at, shift = np.flatnonzero(left & small), 1
    while len(at):  # all small cells at once: each left row with the one `shift` behind it
        at = at[at + shift < last[at]]
        keep(at, at + shift)
        shift += 1
    for i, n in zip(heads[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        x, y = i + np.flatnonzero(left[i : i + n]), i + np.flatnonzero(right[i : i + n])
        for part in np.array_split(x, max(1, len(x) * len(y) // HELD)):
            p, q = np.nonzero(np.bitwise_count(bits[part][:, None] ^ bits[y][None, :]) <= most)
            keep(part[p], y[q])
    settle()
    tied = np.flatnonzero(label != np.arange(len(names)))
    return pa.table({"a": names[tied], "b": names[label[tied]]})


def near_fingerprints(fps: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): links that tie together the distinct fingerprints `fps` (fp) as all pairs with at most `most` (0 to 3) differing bits do."""
    value = lambda s: F.shiftrightunsigned("fp", SEGMENT * s).bitwiseAND(F.lit(2**SEGMENT - 1))
    named = lambda s, v: v.bitwiseOR(F.lit(s << SEGMENT))
    segments = range(BITS // SEGMENT)
    members = fps.select("fp", F.explode(F.array(*[named(s, value(s)) for s in segments])).alias("key"))
    ball = [F.when(value(s).bitwiseAND(F.lit(1 << i)) == 0, named(s, value(s).bitwiseOR(F.lit(1 << i)))) for s in segments for i in range(SEGMENT)]
    asking = fps.select("fp", F.explode(F.array_compact(F.array(*ball))).alias("key"))
    tables = spool(members.groupBy("key").agg(F.count("*").alias("members")), "tables")
    asking = spool(asking.join(tables.select("key"), "key", "left_semi"), "asking")
    asked = asking.groupBy("key").agg(F.count("*").alias("asking"))
    shape = tables.join(asked, "key", "left").withColumn("rows", F.col("members") + F.coalesce("asking", F.lit(0))).where("rows > 1")
    cut = lambda n: F.ceil(F.when(F.col("rows") > WHOLE, F.col(n) / F.lit(WHOLE)).otherwise(1)).cast("int")
    shape = spool(shape.select("key", "rows", cut("members").alias("lefts"), cut("rows").alias("rights")), "shapes")
    every = members.withColumn("member", F.lit(True)).unionByName(asking.withColumn("member", F.lit(False))).join(shape, "key")
    nth = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    none = F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>")
    as_left = F.when(F.col("member"), F.transform(upto("rights"), lambda j: one(nth("lefts", 1), j, F.lit(True), F.lit(False)))).otherwise(none)
    as_right = F.transform(upto("lefts"), lambda i: one(i, nth("rights", 2), F.lit(False), F.lit(True)))
    cells = F.when(F.col("rows") <= WHOLE, F.array(one(F.lit(0), F.lit(0), F.col("member"), F.lit(True)))).otherwise(F.concat(as_left, as_right))
    parts = max(1, math.ceil((shape.agg(F.sum("rows")).first()[0] or 0) / PART_ROWS))
    placed = every.withColumn("c", F.explode(cells)).select(
        F.when(F.col("rows") <= WHOLE, F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(F.xxhash64("key", "c.i", "c.j")).alias("part"), F.xxhash64("key", "c.i", "c.j").alias("cell"), "fp", "c.left", "c.right"
    )
    found = spool(placed.groupBy("part").applyInArrow(lambda t: links_of(t, most), "a long, b long"), "links")
    release(tables, asking, shape)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, most: int = 3) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most `most` (0 to 3) bits.

    Words are runs without space or the characters 9 to 13, A-Z in lower case; shingles of k words count as often as they occur. Returns a row per input
    row: id, fingerprint (16 hex digits), component_id (the smallest id reached). Null texts and texts
    without words have fingerprint zero and are linked like any other; fewer than k words are one shingle. A null id takes no part: its component is null, and it ties no others together. Rows that share an
    id are judged by their own texts. A text of any length is read whole, by one task. Other columns are not looked at. An empty table gives an empty result. All links count: there are no caps, and
    nothing depends on chance.
    """
    seen = spool(fingerprints(docs, id_col, text_col, k), "fingerprints")
    nodes = spool(seen.where("id is not null").groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    links = near_fingerprints(nodes.select("fp"), most)
    labels = spool(nodes.join(components(links).select(F.col("node").alias("fp"), "label"), "fp"), "labels")
    lowest = labels.groupBy("label").agg(F.min("low").alias("component"))
    tied = labels.join(lowest, "label").select("fp", "component")
    named = spool(nodes.join(tied, "fp", "left").select(F.col("fp").alias("node"), F.coalesce("component", "low").alias("component")), "components")
    release(nodes, links, labels)
    component = F.when(F.col("id").isNotNull(), F.col("component"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return seen.join(named, F.col("fp") == F.col("node"), "left").select(F.col("id").alias(id_col), digits.alias("fingerprint"), component.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: near-duplicate components of `documents` by SimHash of 3-word shingles."""
    from docweave.functions.session import spread, table

    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
