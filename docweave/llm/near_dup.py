"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full shingle sets.

Two small collections of `bands` band hashes each are computed per document, of
`rows` minhashes each; every pair (one of each collection) is the key of one of
bands ** 2 tables. So 2 * bands * rows minhashes serve bands ** 2 tables of
2 * rows minhashes, about the square root of what tables of their own would need.

Documents with the same shingle set are one node. In each table bucket the members are
first compared with the smallest one. Where a bucket still holds several
components, its members outside the largest one (outsiders) are compared with all members of other
components. A bucket is cut into cells, a slice of its outsiders against a slice of its members, so no task
holds more than a cell of bounded size. A pair that meets in several tables is asked for in the first of them only, which both
band keys tell; the asked pairs are grouped by blocks of sets, which then meet once. So no bucket is cut off and no pair is a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.session import release, spool
from docweave.llm.blocks import buffer_of, mixed, packed
from docweave.llm.components import components
from docweave.llm.window_dedup import BASES, rolling, word_hashes, words_in

BANDS, ROWS = 20, 4
#: Sets packed together for the second comparison.
BLOCK_SETS = 128
#: Buckets up to WHOLE members are one cell, and cells of about PART_ROWS rows together are one task; of larger buckets OUT_SLICE outsiders meet MEMBER_SLICE members in a cell.
WHOLE, PART_ROWS, OUT_SLICE, MEMBER_SLICE = 1024, 20_000, 128, 32_768
CHUNK_BYTES = 1 << 20


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """The rows in tables of about `limit` bytes of text, a longer text alone."""
    for batch in batches:
        t = pa.table([*batch.columns], names=batch.schema.names)
        size = np.asarray(pa.compute.binary_length(t.column(text).combine_chunks()).fill_null(0)).astype(np.int64)
        part = np.cumsum(size) // limit
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield t.slice(a, b - a)


def shingle_sets(texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the offsets between texts.

    Fewer than k words: the whole sequence is the one shingle; none: no shingle.
    """
    buf, offsets = buffer_of(texts)
    buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    starts, ends = words_in(buf, offsets)
    hashes = word_hashes(buf, starts, ends)
    heads = np.searchsorted(starts, offsets)
    n = np.diff(heads)
    roll = mixed(rolling(hashes, k, BASES[1]))
    many = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), many)
    at = np.repeat(heads[:-1], many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    values = roll[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = [mixed(rolling(hashes[heads[i] : heads[i + 1]], int(n[i]), BASES[1]) + np.uint64(n[i]))[0] for i in short]
        doc, values = np.concatenate([doc, short]), np.concatenate([values, np.array(own, np.uint64)])
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[new], values[new]
    return values, np.searchsorted(doc, np.arange(len(n) + 1))


def band_keys(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each set with members: 2 * bands keys, those of the first collection first."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    at = offsets[:-1][full]
    out = np.zeros((len(full), 2 * bands), np.uint64)
    if not len(full):
        return out
    factors = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(BASES[2])) | np.uint64(1)
    for b in range(2 * bands):
        key = np.full(len(full), (b + 1) * BASES[0] % 2**64, np.uint64)
        for r in range(rows):
            key = mixed(key ^ np.minimum.reduceat(values * factors[b * rows + r], at))
        out[:, b] = key
    return out


def features(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, d1, d2, keys) of every row: size and digest of the shingle set, and its band keys."""

    def run(batches):
        for t in chunks(batches, "text"):
            values, offsets = shingle_sets(t.column("text"), k)
            d = digests(values, offsets)
            keys = band_keys(values, offsets, bands, rows)
            n = np.diff(offsets)
            per = np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * bands, 0))])
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.array(n, pa.int64()), pa.array(d[0]), pa.array(d[1]), pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(keys.ravel().view(np.int64)))], names=["id", "n", "d1", "d2", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, d1 long, d2 long, keys array<long>")


def digests(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set."""
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values * np.uint64(BASES[i])), dtype=np.uint64)]) for i in (0, 1)]
    return [(x[offsets[1:]] - x[offsets[:-1]]).view(np.int64) for x in total]


def sets_of(rows: DataFrame, k: int) -> DataFrame:
    """(id, n, members) with the sorted shingle hashes as packed 64-bit words, of the rows (id, d1, d2, text) whose set has this digest."""

    def run(batches):
        for t in chunks(batches, "text"):
            values, offsets = shingle_sets(t.column("text"), k)
            d = digests(values, offsets)
            own = np.flatnonzero((d[0] == t.column("d1").to_numpy()) & (d[1] == t.column("d2").to_numpy()))
            data = [packed(values[offsets[i] : offsets[i + 1]]) for i in own.tolist()]
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(pa.array(own)), pa.array(np.diff(offsets)[own], pa.int64()), pa.array(data, pa.binary())], names=["id", "n", "members"])

    return rows.mapInArrow(run, "id long, n long, members binary")


def linked_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |intersection| >= num * |union|, on the full sets."""

    def run(batches):
        for t in batches:
            linked = []
            for x, y in zip(t.column("left"), t.column("right"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("members").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("members").alias("right"))
    near = F.least("na", "nb") * den >= F.greatest("na", "nb") * num  # else the sizes alone rule it out
    joined = pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long")


def named_components(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) of all members: the smallest id that links reach, or the own one."""
    found = components(links)
    return spool(members.join(found, members["id"] == found["node"], "left").select("id", F.coalesce("label", "id").alias("label")), "labels")


def asked_pairs(rows: pa.Table, bands: int) -> pa.Table:
    """(left, right, pairs): for blocks left <= right the pairs (place in left << 16 | place in right) that the cells of `rows` ask for."""
    cell, ids, label, block, place, table, out, member = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "id", "label", "block", "place", "table", "outside", "member"))
    keys = rows.column("short").combine_chunks().flatten().to_numpy().reshape(-1, 2 * bands)
    inside = rows.column("inside").combine_chunks().to_numpy(zero_copy_only=False)
    order = np.argsort(cell, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1, [len(order)]])
    told, held, size = [], [], 0

    def pack() -> None:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        swap = (block[a] > block[b]) | ((block[a] == block[b]) & (place[a] > place[b]))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        left, right, code = block[a], block[b], (place[a].astype(np.uint32) << np.uint32(16)) | place[b].astype(np.uint32)
        by = np.lexsort((right, left))
        left, right, code = left[by], right[by], code[by]
        new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        stop = [*new[1:].tolist(), len(left)]
        told.append(pa.table([pa.array(left[new]), pa.array(right[new]), pa.array([packed(code[i:j]) for i, j in zip(new.tolist(), stop, strict=True)], pa.binary())], names=["left", "right", "pairs"]))

    for i, j in zip(cut[:-1], cut[1:], strict=True):
        own = order[i:j]
        x_all, y_all = own[out[own]], own[member[own]]
        one, two = divmod(int(table[own[0]]), bands)
        for x_part in np.array_split(x_all, max(1, len(x_all) * len(y_all) // 200_000)):
            x, y = np.nonzero(label[x_part][:, None] != label[y_all][None, :])
            x, y = x_part[x], y_all[y]
            # two outsiders meet twice
            pick = inside[y] | (ids[x] < ids[y])
            x, y = x[pick], y[pick]
            for side, at in ((0, one), (bands, two)):
                first = np.ones(len(x), bool)
                for k in range(at):
                    first &= keys[x, side + k] != keys[y, side + k]
                x, y = x[first], y[first]
            held.append((x, y))
            size += len(x)
            if size > 1_000_000:
                pack()
                held.clear()
                size = 0
    if size:
        pack()
    return pa.concat_tables(told) if told else pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["left", "right", "pairs"])


def linked_outsiders(open_: DataFrame, sets: DataFrame, num: int, den: int, bands: int) -> DataFrame:
    """(a, b) of the links between different components in the same bucket. open_: bucket, table, id, label, lead, short.

    Every pair of an outsider (a member outside the bucket's largest component) and a member of another component is tested
    once. Sets are packed by family (the smallest lead of their buckets) into blocks, and a pair of blocks is brought together once for all its pairs.
    """
    family = open_.groupBy("id").agg(F.min("lead").alias("family"))
    # written, so that Spark can split a large family in the join below
    sizes = spool(family.groupBy("family").agg(F.ceil(F.count("*") / F.lit(BLOCK_SETS)).cast("long").alias("parts")), "sizes")
    dealt = family.join(sizes, "family").select("id", F.xxhash64("family", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    home = spool(dealt.withColumn("place", F.row_number().over(W.partitionBy("block").orderBy("id")) - 1), "blocks")
    labels = open_.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    shape = labels.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    cut = lambda n, by: F.when(F.col("n") > WHOLE, F.ceil(n / F.lit(by))).otherwise(1).cast("int")
    shape = spool(shape.select("bucket", "n", F.col("top.label").alias("top"), cut(F.col("n") - F.col("top.n"), OUT_SLICE).alias("outs"), cut(F.col("n"), MEMBER_SLICE).alias("slices")), "shapes")
    parts = max(1, math.ceil(open_.count() / PART_ROWS))
    nth = lambda k, n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int").alias(k)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda o, m, outside, member: F.struct(o.alias("o"), m.alias("m"), outside.alias("outside"), member.alias("member"))
    outside = F.col("label") != F.col("top")
    own_out, own_slice = nth("o", "outs", 1), nth("m", "slices", 2)
    as_member = F.transform(every("outs"), lambda o: cell(o, own_slice, F.lit(False), F.lit(True)))
    as_outsider = F.when(outside, F.transform(every("slices"), lambda m: cell(own_out, m, F.lit(True), F.lit(False)))).otherwise(F.array().cast("array<struct<o:int,m:int,outside:boolean,member:boolean>>"))
    small = F.col("n") <= WHOLE
    cells = F.when(small, F.array(cell(F.lit(0), F.lit(0), outside, F.lit(True)))).otherwise(F.concat(as_member, as_outsider))
    each = open_.join(shape, "bucket").join(home, "id").select("bucket", "table", "id", "label", "short", "block", "place", small.alias("small"), (~outside).alias("inside"), F.explode(cells).alias("c"))
    named = F.xxhash64("bucket", "c.o", "c.m")
    rows = each.select(F.when(F.col("small"), F.pmod(F.xxhash64("bucket"), F.lit(parts))).otherwise(named).alias("part"), named.alias("cell"), "table", "id", "label", "short", "block", "place", "inside", "c.outside", "c.member")
    asked = rows.groupBy("part").applyInArrow(lambda t: asked_pairs(t, bands), "left long, right long, pairs binary").groupBy("left", "right").agg(F.collect_list("pairs").alias("pairs"))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")  # a repeated row has its place twice
        rows = rows.take(pa.array(np.unique(rows.column("place").to_numpy(), return_index=True)[1]))
        size = rows.column("n").combine_chunks().to_numpy()
        data = b"".join(rows.column("members").to_pylist())
        return pa.table([rows.column("block").slice(0, 1), pa.array([packed(rows.column("id").combine_chunks().to_numpy())], pa.binary()), pa.array([packed(size)], pa.binary()), pa.array([data], pa.binary())], names=["block", "ids", "sizes", "data"])

    blocks = spool(sets.join(home, "id").groupBy("block").applyInArrow(pack, "block long, ids binary, sizes binary, data binary"), "packed-sets")
    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "sizes", "data")])

    def test(batches):
        for t in batches:
            for k in range(t.num_rows):
                own = {}
                for s in ("left", "right"):
                    ids, size, data = (np.frombuffer(t.column(f"{s}_{c}")[k].as_buffer(), kind) for c, kind in (("ids", np.int64), ("sizes", np.int64), ("data", np.uint64)))
                    own[s] = ids, size, np.concatenate([[0], np.cumsum(size)]), data
                code = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("pairs")[k].values]))
                x_of, y_of = (code >> np.uint32(16)).astype(np.int64), (code & np.uint32(0xFFFF)).astype(np.int64)
                a_ids, na, at, flat = own["left"]
                b_ids, nb, bt, other = own["right"]
                near = np.minimum(na[x_of], nb[y_of]) * den >= np.maximum(na[x_of], nb[y_of]) * num  # else the sizes alone rule it out
                x_of, y_of = x_of[near], y_of[near]
                if not len(x_of):
                    continue
                heads = np.flatnonzero(np.concatenate([[True], x_of[1:] != x_of[:-1]]))
                a, b = [], []
                for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(x_of)], strict=True):
                    x, y = x_of[i], y_of[i:j]
                    members = flat[at[x] : at[x + 1]]
                    hit = np.concatenate([[0], np.cumsum(members[np.minimum(np.searchsorted(members, other), len(members) - 1)] == other)])
                    both = hit[bt[y + 1]] - hit[bt[y]]
                    good = y[den * both >= num * (na[x] + nb[y] - both)]
                    a.append(np.full(len(good), a_ids[x]))
                    b.append(b_ids[good])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    met = asked.join(side("left"), "left").join(side("right"), "right")
    out = spool(met.mapInArrow(test, "a long, b long"), "tested")
    release(sizes, home, shape, blocks)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of documents whose sets of k-word shingles have a Jaccard similarity of num / den or more.

    Words are runs without space or the characters 9 to 13, A-Z in lower case. Returns a row per input row: id,
    n_shingles, component_id (the smallest id reached) and kept (the id is the component's).
    Null texts and texts without words have no shingles and stay alone, even beside copies of themselves. A null
    id takes no part: its component is null and it is kept. Rows that share an id are judged by their
    own texts. A text of any length is one set, read whole by one task. Other columns are not looked at. An empty table gives an empty result. Candidates
    come from minhashes: with 20 bands of 4 rows a pair of similarity 0.8 is missed with a probability
    of 5e-5, a more similar one with less; every link is exact.
    """
    # written: the numbers of the rows hold from here on; nodes go by them, so that rows that share an id stay apart
    seen = spool(features(docs, id_col, text_col, k, bands, rows).withColumn("row", F.monotonically_increasing_id()), "features")
    known = seen.where("n > 0 and id is not null")
    nodes = spool(known.groupBy("d1", "d2", "n").agg(F.min(F.struct("row", F.col("id").alias("doc"))).alias("head"), F.min("id").alias("low"), F.first("keys").alias("keys")).select("d1", "d2", "n", F.col("head.row").alias("id"), "head.doc", "low", "keys"), "nodes")
    each = nodes.select("id", F.posexplode("keys").alias("pos", "key"))
    common = each.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    held = lambda first: F.collect_list(F.when((F.col("pos") < bands) == F.lit(first), F.struct(F.pmod("pos", F.lit(bands)).alias("at"), "key")))
    own = each.join(common, "key").groupBy("id").agg(held(True).alias("one"), held(False).alias("two"))
    tensor = F.flatten(F.transform("one", lambda x: F.transform("two", lambda y: F.struct(F.xxhash64(x["key"], y["key"]).alias("bucket"), (x["at"] * bands + y["at"]).alias("table")))))
    keys = own.where((F.size("one") > 0) & (F.size("two") > 0)).select("id", F.explode(tensor).alias("t")).select("id", "t.bucket", "t.table")
    full = keys.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    buckets = spool(keys.join(full, "bucket").select("bucket", "table", "id", "lead"), "buckets")
    members = buckets.select("id").distinct()
    heads = nodes.join(members, "id", "left_semi").select("id", "doc", "d1", "d2")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    sets = spool(sets_of(texts.join(heads, "doc").select("id", "d1", "d2", "text"), k), "sets")

    pairs = buckets.where("id > lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    links = spool(linked_pairs(pairs, sets, num, den), "links")
    labels = named_components(members, links)
    placed = buckets.join(labels, "id")
    unsettled = placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
    short = nodes.select("id", F.transform("keys", lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("short"))
    open_ = spool(placed.join(unsettled, "bucket").join(short, "id"), "unsettled")
    more = linked_outsiders(open_, sets, num, den, bands)
    if not more.isEmpty():
        before, labels = labels, named_components(members, links.unionByName(more))
        release(before)
    release(buckets, sets, links, open_, more)

    named = nodes.join(labels, "id", "left").select("d1", "d2", F.col("n").alias("m"), "low", F.coalesce("label", "id").alias("label"))
    named = named.join(named.groupBy("label").agg(F.min("low").alias("component")), "label").select("d1", "d2", "m", "component")
    same = (seen["d1"] == named["d1"]) & (seen["d2"] == named["d2"]) & (seen["n"] == named["m"]) & (seen["n"] > 0)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = seen.select("id", "n", "d1", "d2").join(named, same, "left").select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: near-duplicate components of `documents` on sets of 4-word shingles."""
    from docweave.functions.session import spread, table

    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k=4)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT e.b, r.reached FROM r JOIN e ON e.a = r.doc_id WHERE r.reached < e.b),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
