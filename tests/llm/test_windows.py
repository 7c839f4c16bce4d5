"""Removal of repeated strings and windows against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.llm.blocks import dealt_into_blocks
from docweave.llm.suffix_dedup import refined_buckets, remove_repeated_bytes
from docweave.llm.window_dedup import remove_repeated_windows


def test_rows_of_one_id_are_dealt_out(spark):
    df = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    blocks, n = dealt_into_blocks(df, "doc_id", "text", 400)
    assert n > 5 and blocks.groupBy("block").count().agg(F.max("count")).first()[0] < 150


def corpus(rng, unit, n=60):
    passages = [unit(rng, 90) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [unit(rng, rng.choice([0, 5, 30, 80])) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages)[rng.randrange(20) :])
        rows.append((i * 7 % n, " ".join(p for p in parts if p)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "é" * 200), (105, "x" + "é" * 200), (106, "ab" * 400), (107, "ab" * 400), (None, rows[0][1]), (3, rows[5][1])]
    return rows


def syllables(rng, n):
    return " ".join("".join(rng.choice(["ba", "do", "ni", "é"]) for _ in range(rng.randrange(1, 4))) for _ in range(n // 5 + 1))[: n * 3]


def brute(rows, length, units):
    """Per row: units, and whether each is removed."""
    big = 2**63 - 1
    seen = {}
    cut = [units(t) for _, t in rows]
    for (i, _), u in zip(rows, cut, strict=True):
        for p in range(len(u) - length + 1):
            w = tuple(u[p : p + length])
            seen[w] = min(seen.get(w, big), big if i is None else i)
    out = []
    for (i, _), u in zip(rows, cut, strict=True):
        gone = [False] * len(u)
        for p in range(len(u) - length + 1):
            if seen[tuple(u[p : p + length])] < (big if i is None else i):
                gone[p : p + length] = [True] * length
        out.append((i, u, gone))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_bytes_equal_brute_force(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr("docweave.llm.repeats.HOT_ANCHOR", 3)
    rows = corpus(random.Random(1), syllables)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(5)
    got = remove_repeated_bytes(df, length=20, block_bytes=3000)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) for r in got.collect())
    want = []
    for i, u, gone in brute(rows, 20, lambda t: (t or "").encode()):
        spans = [m.span() for m in re.finditer("x+", "".join("x" if g else "." for g in gone))]
        want.append((i is None, i or 0, len(u), bytes(b for b, g in zip(u, gone, strict=True) if not g), spans))
    assert found == sorted(want)


def test_words_equal_brute_force(spark):
    rows = corpus(random.Random(2), syllables)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, one int").repartition(5)
    got = remove_repeated_windows(df, length=8, block_bytes=3000)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.kept) for r in got.collect())
    want = [(i is None, i or 0, len(u), " ".join(w for w, g in zip(u, gone, strict=True) if not g)) for i, u, gone in brute(rows, 8, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""))]
    assert found == sorted(want)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(df).count() == 0 and remove_repeated_windows(df).count() == 0


def test_buckets_are_classes_of_equal_strings():
    import numpy as np

    rng = random.Random(3)
    for length, letters, batch in ((5, b"ab", 1), (8, b"a", 1), (9, b"ab", 40), (13, b"abc", 1), (33, b"ab", 1), (33, b"abcdefghijkl", 1), (20, b"abc", 1 << 15), (50, b"ab", 1 << 15), (50, b"a", 7)):
        text = bytes(rng.choice(letters) for _ in range(300)) * 2
        # as in separate stretches: places at the end of each are no starts
        starts = np.array([p for p in range(len(text) - length + 1) if p % 90 <= 90 - length or length > 45])[:: 1 + (batch == 40)]
        bucket = refined_buckets(np.frombuffer(text + bytes(8), np.uint8), starts, length, batch)
        kinds = {}
        for p, b in zip(starts, bucket, strict=True):
            assert kinds.setdefault(text[p : p + length], b) == b
        assert len(set(bucket.tolist())) == len(kinds)


def test_query_digest_matches(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.h for r in remove_repeated_windows(df).select("doc_id", F.sha2("kept", 256).alias("h")).collect()}
    assert rows == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
