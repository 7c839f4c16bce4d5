"""Views in lines against views in one value, places over many tasks, drift of covers against brute force."""

import json
import random

from pyspark.sql import functions as F

from docweave.functions.frontmatter import docs_of
from docweave.functions.paths import PROSE
from docweave.functions.session import spool
from docweave.operators import graph, segments, views
from docweave.operators.views import cover_edges


def corpus(spark):
    """Three repositories: one with everything in it, one without markdown, one with a single odd document."""
    rng = random.Random(5)
    names = [f"{'abc'[i % 3]}/n{i}.md" for i in range(60)]
    rows = [("z", "x.go", ""), ('q"uo\\te é', "only.md", "---\ntype: guide\ntitle: 'a \"b\" \\\\ ü'\ndescription: d\n---\n# H\n")]
    for n in names:
        links = "".join(f"  - rel: {rng.choice(['see-also', 'part-of'])}\n    to: {rng.choice(names)}\n    note: '{rng.choice(['', 'n', 'm'])}'\n" for _ in range(rng.randrange(4)))
        head = f"---\ntype: {rng.choice(['guide', 'runbook', 'odd', '', 'index'])}\ntitle: {rng.choice(['T', '', n])}\n" + (f"links:\n{links}" if links else "") + "---\n" if rng.random() < 0.8 else ""
        rows.append(("big", n, head + f"see [l](../{rng.choice(names)}) and {rng.choice(names)}\n"))
    files = spark.createDataFrame(rows, "repo string, path string, content string").select("repo", F.lit("").alias("ref"), "path", "content", F.lit(True).alias("tracked")).repartition(5)
    return files, docs_of(graph.markdown_nodes(files))


def test_graph_lines_are_the_graph(spark, tmp_path):
    files, d = corpus(spark)
    content, meta = spool(graph.content_edges(files), "content"), spool(graph.metadata_edges(files, d), "metadata")
    given = (files, d, content, meta, graph.orphans(files, content), graph.disconnected(d, meta))
    want = {r.repo: r.json for r in graph.graph_json(*given).collect()}
    assert set(want) == {"big", "z", 'q"uo\\te é'} and len(json.loads(want["big"])["metadataEdges"]) > 20
    lines = segments.graph_lines(*given)
    got = {r.repo: r.t for r in lines.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "pos", "text"))), lambda x: x["text"]), "\n").alias("t")).collect()}
    assert {k: v.replace("\n", "") for k, v in got.items()} == want
    # files of five lines, several tasks for a repository
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    segments.write_lines(lines, f"file://{tmp_path}/g", 5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = tmp_path / "g" / "repo=big"
    told = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert json.loads(told) == json.loads(want["big"]) and len(list(folder.glob("part-*"))) > 10 and len({p.name[:10] for p in folder.glob("part-*")}) > 1


def test_index_lines_are_the_index(spark):
    _, d = corpus(spark)
    lines = segments.index_lines(d).orderBy("repo", "rank", "type", "pos").collect()
    want = {r.repo: r.text for r in views.index_markdown(d).collect()}
    assert set(want) == {"big", 'q"uo\\te é'} and want["big"].count("## ") == 5
    assert {k: "\n".join(r.text for r in lines if r.repo == k) for k in want} == want
    assert segments.index_lines(d.where("false")).count() == 0


def test_places_in_one_large_group(spark):
    n = 300_000
    items = spark.range(n).select(F.lit("r").alias("repo"), F.lpad((F.col("id") * 7919 % n).cast("string"), 6, "0").alias("k"), "id")
    out = segments.placed(items.unionByName(spark.createDataFrame([(None, "b", -1), (None, "a", -2), ("s", None, -3)], "repo string, k string, id long")), ["repo"], ["k"])
    assert out.where("repo = 'r' and pos <> cast(k as long)").count() == 0 and out.where("repo = 'r'").count() == n
    assert {(r.id, r.pos) for r in out.where("id < 0").collect()} == {(-2, 0), (-1, 1), (-3, 0)}
    # the large group is never gathered: the one window is over counts
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Aggregate [block" in plan.split("Window", 1)[1]


def test_covers_drift_by_brute_force(spark):
    rng = random.Random(11)
    docs = [f"d{i}.md" for i in range(12)]
    tree = {p: "---\ntype: guide\nlinks:\n" + "".join(f"  - rel: covers\n    to: {t}\n" for t in rng.sample(["src", "src/a", "src/a/f1.go", "src/b/", "lib", "gone"], rng.randrange(1, 4))) + "---\n" for p in docs}
    files = spark.createDataFrame([(r, "", p, c, True) for r in ("r", "s") for p, c in tree.items()], "repo string, ref string, path string, content string, tracked boolean")
    code = [f"{d}/f{i}.{e}" for d in ("src/a", "src/b", "lib", "other") for i in range(6) for e in ("go", "md")]
    rows = [(r, f"g{rng.randrange(9)}", rng.choice(docs + code)) for r in ("r", "s") for _ in range(260)] * 2
    # one range in which all changed, documents that changed alone with it, and rows without a range
    rows += [("r", "all", p) for p in docs[:7] + code] + [("r", None, p) for p in docs + code]
    d = docs_of(graph.markdown_nodes(files))
    edges = [tuple(r) for r in cover_edges(d).collect()]
    held = {x for x in rows if x[1] is not None}
    want = {(r, doc, p) for r, doc, t in edges for (x, g, p) in held if x == r and (p == t or p.startswith(t + "/")) and p.rsplit(".", 1)[1] not in PROSE and (r, g, doc) not in held}
    changes = spark.createDataFrame(rows, "repo string, range_id string, path string").repartition(3)
    long = [tuple(r) for r in views.covers_drift_paths(changes, d).collect()]
    assert set(long) == want and len(long) == len(want) > 100
    whole = {(r.repo, r.doc): r.paths for r in views.covers_drift(changes, d).collect()}
    assert whole == {k: sorted(p for *x, p in want if tuple(x) == k) for k in {x[:2] for x in want}}
