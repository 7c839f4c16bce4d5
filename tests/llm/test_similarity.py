"""SimHash components, clustering and divergence against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from docweave.llm import centroids, divergence, simhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_fingerprint(text, k=3):
    w = words(text)
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(rows, most=3):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    root = {k: k for k in range(len(fps))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(fps)):
        for y in range(x):
            if fps[x][0] is not None and fps[y][0] is not None and (fps[x][1] ^ fps[y][1]).bit_count() <= most:
                root[find(x)] = find(y)
    low = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted([(i, f"{f:016x}", low[find(k)] if i is not None else None) for k, (i, f) in enumerate(fps)], key=str)


def texts(rng, n=150):
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.choice([2, 12, 80, 300]))] for _ in range(10)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = "ZÉ" + str(rng.randrange(1000))
        rows.append((i + 1, " ".join(w).upper() if i % 3 else "\t".join(w) + "\n"))
    return [*rows, (200, None), (201, ""), (202, " \n"), (203, "one"), (203, "ONE two"), (None, rows[0][1]), (None, None), (7, "other words of the same id"), (7, rows[9][1]), (300, "long " * 50_000)]


@pytest.mark.parametrize("small", [True, False])
def test_simhash_equals_brute_force(spark, small, monkeypatch):
    if small:  # every bucket in many cells, tasks of few rows, forests cut short
        for name, n in (("WHOLE", 2), ("PART_ROWS", 40), ("HELD", 20), ("CHUNK", 7)):
            monkeypatch.setattr(simhash, name, n)
    rows = texts(random.Random(5))
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, fp string, component_id int").repartition(5)
    got = sorted([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()], key=str)
    assert got == plain_components(rows)
    assert len({r[2] for r in got}) < len({r[1] for r in got})  # some fingerprints differ and are linked


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("whole", [1, 64, 2048])
def test_multi_index_loses_no_link(spark, whole, monkeypatch):
    """Fingerprints around few centres: distances from 0 to 6, in both segments, many in one bucket."""
    monkeypatch.setattr(simhash, "WHOLE", whole)
    rng = random.Random(whole)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(40):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))))
    fps |= {0, 2**64 - 1, 2**63, 1, 7 << 61}
    signed = [x - 2**64 if x >= 2**63 else x for x in sorted(fps)]
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    want = [(x, y) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 3]

    def sets(links):
        of = {x: {x} for x in fps}
        for a, b in links:
            if of[a] is not of[b]:
                of[a] |= of[b]
                for x in of[b]:
                    of[x] = of[a]
        return {frozenset(x) for x in of.values()}

    assert sets(got) == sets(want)


def plain_lloyd(rows, k, rounds, dims):
    def fine(v):
        return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)

    own = [(i, [max(-(2**63), min(math.floor(256 * x), 2**63 - 1024)) for x in v]) for i, v in rows if i is not None and fine(v)]
    c = [v for _, v in sorted(own, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in own:
            by[near(v)[1]].append(v)
        c = [[sum(x) // len(by[j]) for x in zip(*by[j], strict=True)] if by[j] else w for j, w in enumerate(c)]
    end = [(i, *near(v)[::-1]) for i, v in own]
    border = lambda x: min(x, 2**63 - 1)
    total = [sum(border(d) for _, j, d in end if j == q) for q in range(len(c))]
    return sorted((i, j, border(d), border(total[j]), border(sum(total)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in end)


@pytest.mark.parametrize("large", [False, True])
def test_clusters_equal_a_plain_version(spark, large):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.25, -1.5, rng.gauss(0, 2)]) for _ in range(4)]) for i in range(60)]
    rows += [(5, rows[5][1]), (6, [9.0] * 4), (None, [1.0] * 4), (70, None), (71, []), (72, [1.0] * 3), (73, [1.0, None, 2.0, 3.0]), (74, [float("nan")] * 4), (75, [1.0, float("inf"), 0.0, 0.0])]
    rows += [(80, [1e18, -3.0, 1e300, 0.0]), (81, [3e6, -3e6, 1e7, 0.0])] * large
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id int").repartition(3)
    got = sorted(tuple(r) for r in centroids.clusters(df, k=9, rounds=3, dims=4).collect())
    assert got == plain_lloyd(rows, 9, 3, 4)


def test_clusters_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert centroids.clusters(spark.createDataFrame([], kind)).collect() == []
    assert centroids.clusters(spark.createDataFrame([(1, [1.0]), (2, None)], kind)).collect() == []
    two = [(1, [0.5] * 64), (2, [0.5] * 64)]
    assert sorted(tuple(r)[:5] for r in centroids.clusters(spark.createDataFrame(two, kind)).collect()) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]


def plain_divergence(rows, least, top):
    cut = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    own = [(la or "", s or "", re.findall(cut, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, la, s in rows]
    df = Counter((la, w) for la, _, ws in own for w in set(ws))
    kept = defaultdict(list)
    for (la, w), n in df.items():
        if n >= least:
            kept[la].append(w)
    count = defaultdict(Counter)
    for la, s, ws in own:
        count[la, s].update(w for w in ws if df[la, w] >= least)
        count[la, None].update(w for w in ws if df[la, w] >= least)
    p = {g: {w: 1 + 10**9 * (c[w] + 5) // (c.total() + 5 * len(kept[g[0]])) for w in kept[g[0]]} for g, c in count.items()}
    out = []
    for (la, s), c in count.items():
        if s is None:
            continue
        pairs = [(t, sum(abs(p[la, s][w] - p[la, t][w]) for w in kept[la])) for (other, t) in count if other == la and t not in (None, s)]
        terms = [(w, p[la, s][w] - p[la, None][w]) for w in kept[la] if c[w] > 0 and p[la, s][w] > p[la, None][w]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(la, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_divergence_equals_a_plain_version(spark, small, monkeypatch):
    if small:  # many pieces, blocks and batches
        for name, n in (("HELD", 3), ("BLOCK_COUNTS", 6), ("MATRIX", 8)):
            monkeypatch.setattr(divergence, name, n)
    rng = random.Random(8)
    vocab = ["the", "The", "über", "naïve", "x", "yy", "中文", "a b", "z" * 300, "\U0001f600"] + [f"w{c}" for c in "abcdefg"]
    rows = [(" ".join(rng.choice(vocab) + rng.choice(["", ",", "1x", "_", "\u0000the"]) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "é", "", None])) for _ in range(160)]
    rows += [(None, "en", "only null"), ("", "fr", "p"), ("1 2", "fr", "q"), (None, None, None), ("the the the " * 3000, "en", "a")] + [rows[3]] * 4
    df = spark.createDataFrame([(t, la, s, 1, "x") for t, la, s in rows], "text string, lang string, source string, n int, term string").repartition(4)
    got = sorted(tuple(r) for r in divergence.source_divergence(df, least=8, top=4, piece_bytes=700 if small else 4 << 20).collect())
    assert got == plain_divergence(rows, 8, 4)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in got)


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
