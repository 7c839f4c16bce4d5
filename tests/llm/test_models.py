"""Language identification, top-k search and mixing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import language_id as L
from docweave.llm import mixing, topk

WORDS = {"en": "the and with tion ing her".split(), "de": "und der nicht keit sch über".split(), "es": "que ción los ñ para mente".split()}


def text(rng, lang, n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, k), k) for i in range(150) for k in [rng.choice(list(WORDS))]]
    train = spark.createDataFrame([*rows, (900, None, "en"), (901, "1234", "en"), (902, "x", None)], "doc_id long, text string, lang string")
    odd = [(1000, None, "a"), (1001, "", "a"), (1002, "123 !?", "a"), (1003, text(rng, "de", 20_000), "a"), (1003, "ок", "a")]
    test = spark.createDataFrame([(2000 + i, text(rng, k), k) for i in range(60) for k in [rng.choice(list(WORDS))]] + odd, "doc_id long, text string, score string")
    got = L.identify(test.withColumn("true", F.col("score")), train).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    sure = [r for r in got if r.doc_id >= 2000]
    assert sum(r.lang_pred == r.true for r in sure) >= 57
    by_id = {r.doc_id: r.lang_pred for r in got if r.doc_id < 1003}
    assert set(by_id.values()) == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 1003 and r.score > 0.9} >= {"de"}
    assert {r.lang_pred for r in L.identify(test, train.where("false")).collect()} == {"und"}
    assert L.identify(test.where("false"), train).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in L.fresh_params(3, 2).items()}
    codes, target, weight = rng.integers(97, 100, (5, 4)), np.array([0, 1, 2, 1]), np.ones((5, 4))

    def loss(q):
        left, right = L.states(q["xl"], q["ul"], codes), L.states(q["xr"], q["ur"], codes[::-1])[::-1]
        return -sum(np.log(L.probabilities(q, left[t], right[t])[target, np.arange(4)]).sum() for t in range(5)) / 20

    grad = L.gradients(p, codes, target, weight)
    for k, at in (("xl", (0, 98)), ("xr", (5, 97)), ("ul", (1, 1)), ("ul", (3, 0)), ("ur", (4, 1)), ("out", (2, 3)), ("bias", (0, 0))):
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-2
        up = loss(q)
        q[k][at] -= 2e-2
        assert grad[k][at] == pytest.approx((up - loss(q)) / 2e-2, abs=2e-4)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.choice([0.0, 0.0, 0.25, -0.5, 1.0], 12)]) for i in range(230)]
    odd = [(300, None), (301, [1.0, None]), (302, [float("nan")] * 12), (303, [float("inf")]), (304, []), (350, [1.0, 2.0]), (305, [1e30, -1e30]), (None, [1.0]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows + odd], "vec_id long, embedding array<float>, id long").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0).collect())
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows + [odd[4], odd[5]]} | {305: [2**63 - 1024, -(2**63)]}
    want = []
    for q in sorted(good):
        if q % 50 == 0:
            s = sorted(((-max(min(sum(a * b for a, b in zip(good[q], v, strict=False)), 2**63 - 1), -(2**63)), i) for i, v in good.items() if i != q))[:5]
            want += [(q, n + 1, i, max(min(-x, 2**63 - 1), -(2**63))) for n, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(df.where("false"), F.col("id") % 50 == 0).count() == 0


def test_copies_of_queries_are_not_broadcast(spark, tmp_path, capsys):
    """The blocks of queries are few, their copies for all blocks of vectors are not: the driver must not hold them."""
    spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(-300.0).cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/v")
    found = topk.top_k(spark.read.parquet(f"{tmp_path}/v"), F.col("id") % 50 == 0)
    assert [r.vec_id for r in found.where("query_id = 150").orderBy("rank").collect()] == [199, 198, 197, 196, 195]
    found.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_blocks_hold_numbers_in_few_bytes():
    for most, kind in ((127, np.int8), (128, np.int16), (-(2**15), np.int16), (2**31, np.int64), (-(2**63), np.int64)):
        a = topk.narrowed(np.array([0, most, 5], np.int64))
        assert a.dtype == kind and [v.tolist() for v in topk.vectors_of(a.tobytes(), np.array([1, 0, 2], np.int32))] == [[0], [], [most, 5]]
    assert [v.tolist() for v in topk.vectors_of(b"", np.array([0, 0], np.int32))] == [[], []]


def test_large_components_stay_exact():
    q, m = [np.array([2**40, 3])], [np.array([2**20, 5]), np.array([-(2**20)])]
    assert topk.scores_of(q, m).tolist() == [[2**60 + 15, -(2**60)]]
    q, m = [np.array([2**62, 2**62, 5])], [np.array([2**62, -(2**62), 2]), np.array([4, 4, 0]), np.array([-4, -4, -1])]
    assert topk.scores_of(q, m).tolist() == [[10, 2**63 - 1, -(2**63)]]
    low = np.iinfo(np.int64).min
    assert topk.best_of(np.array([3, low, 3, 9]), np.array([8, 1, 2, 5]), 4).tolist() == [3, 2, 0, 1]


def test_documents_held_out_are_labelled_well(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = L.identify(docs.select("doc_id", "text"), docs.where(~L.is_held_out()))
    seen = out.join(docs.select("doc_id", "lang"), "doc_id").where(L.is_held_out() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    n, right = seen.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n >= 20 and right >= 0.9 * n


def test_dirty_labels_are_bounded(spark, monkeypatch):
    rows = [(i, "some text", "en" if i % 2 else "de") for i in range(20)] + [(100 + i, "other text", f"x{i}") for i in range(10)]
    assert L.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", most_langs=2)[0] == ["de", "en"]


def test_mixing_of_rows_that_look_alike(spark):
    rows = [(None, "a b", "s", i) for i in range(40)] + [(7, "c d e", "s", 40 + i) for i in range(30)] + [(None, None, "t", 80), (1, "x " * 400, None, 81)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    got = mixing.mixture(df.repartition(3), keep=("row", "text")).collect()
    assert sorted(r.k0 for r in got) == [r[3] for r in rows] and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixture(df.repartition(5), keep=("row", "text")).collect()), key=str)
    for s in ("s", None):
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target)


def test_mixing_reaches_targets(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([0, 1, 5, 400]), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(400)] + [(500, None, "d"), (7, "x", "a")]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.mixture(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(df.repartition(2)).collect()))
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.whole * r["size"] + r.part
    total = sum(r["size"] for r in got)
    for own in by.values():
        target, size = own[0].target, own[0].source_size
        assert size == sum(r["size"] for r in own) and target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in own) - target) < 1.001
    assert sum(own[0].target for own in by.values()) == pytest.approx(total)
    # the filling by rounds gives the same targets
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    size = {s: own[0].source_size for s, own in by.items()}
    fixed = {}
    while True:
        rest = total - sum(fixed.values())
        live = {s: w for s, w in weight.items() if s not in fixed}
        share = {s: rest * w / sum(live.values()) for s, w in live.items()}
        over = {s: 3 * size[s] for s in live if share[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    assert {s: own[0].target for s, own in by.items()} == pytest.approx(fixed | share)
    assert mixing.mixture(df.where("false")).count() == 0
