"""Near duplicates and components against brute force."""

import random
import re

import pytest

from docweave.llm.components import components
from docweave.llm.near_dup import asked_pairs, near_duplicates


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(x), find(i)) for i, x in sets}


def rows_for(rng, n=120):
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.choice([3, 12, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = "z" + str(rng.randrange(1000))
        rows.append((i, " ".join(w).upper() if i % 3 else "\t".join(w)))
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE")]


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, small, monkeypatch):
    if small:  # every bucket in many cells, and tasks of few rows
        for name, n in (("WHOLE", 2), ("PART_ROWS", 50), ("OUT_SLICE", 2), ("MEMBER_SLICE", 3), ("BLOCK_SETS", 2)):
            monkeypatch.setattr(f"docweave.llm.near_dup.{name}", n)
    rows = rows_for(random.Random(4))
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, id string, n int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, k=4).collect()}
    assert got == brute(rows, 4)


def test_cells_ask_for_every_pair_once():
    import numpy as np
    import pyarrow as pa

    rng, bands = np.random.default_rng(3), 3
    keys = rng.integers(0, 2, (30, 2 * bands)).astype(np.int32)
    label = rng.integers(0, 4, 30)
    rows = []
    for table in range(bands * bands):
        i, j = divmod(table, bands)
        for kind in {(a, b) for a, b in keys[:, [i, bands + j]].tolist()}:
            own = [x for x in range(30) if (keys[x, i], keys[x, bands + j]) == kind]
            top = max(set(label[own].tolist()), key=label[own].tolist().count)
            rows += [(table * 4 + kind[0] * 2 + kind[1], x, label[x], x % 4, x // 4, table, keys[x].tolist(), label[x] == top, label[x] != top, True) for x in own]
    names = ["cell", "id", "label", "block", "place", "table", "short", "inside", "outside", "member"]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] + [pa.bool_()] * 3
    out = asked_pairs(pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names), bands)
    got = [tuple(sorted((left + 4 * (code >> 16), right + 4 * (code & 0xFFFF)))) for left, right, x in zip(*(c.to_pylist() for c in out.columns), strict=True) for code in np.frombuffer(x, np.uint32).tolist()]
    meets = lambda x, y: (keys[x, :bands] == keys[y, :bands]).any() and (keys[x, bands:] == keys[y, bands:]).any()
    assert sorted(got) == [(x, y) for x in range(30) for y in range(x + 1, 30) if label[x] != label[y] and meets(x, y)]


def test_rows_that_share_an_id_stay_apart(spark):
    a, b = "a b c d e f g h", "r s t u v w x y"
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(5, a), (5, b), (5, b), (2, a), (7, b), (None, b), (8, long), (9, long + " z")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 0, True), (2, 2, True), (5, 2, False), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (9, 8, False)]


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, None, True), (4, 4, True), (5, 4, False)]
    assert near_duplicates(df.where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 150)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, 150: 150, 200: 150}
