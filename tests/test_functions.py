"""Cases of text and path functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.functions import frontmatter, paths
from docweave.functions import markdown as M
from docweave.operators import drift, views
from docweave.operators.usage import selected_checks


def found_links(spark, text):
    df = spark.createDataFrame([(text,)], "content string")
    return [tuple(r) for r in M.links(df, F.col("content")).select("line", "target").orderBy("line").collect()]


def test_links(spark):
    assert found_links(spark, "go [home](start.md), then\n[up](../top.md#way)\n\n[note]: notes/n1.md\n") == [(1, "start.md"), (2, "../top.md#way"), (4, "notes/n1.md")]
    assert found_links(spark, "```\n[off](p.md)\n~~~\n[off](q.md)\n```\n`[off](r.md)` [on](s.md)\n`left open [off](t.md)") == [(6, "s.md")]
    assert found_links(spark, "~~~\n[off](p.md)") == []


def test_local_markdown(values):
    yes = ["plan.md", "../up/two.md", "here.md#below", 'named.md "Some title"', "q.md?raw"]
    no = ["ftp://host.example/k.md", "mailto:me@host.example", "#below", "/root/k.md", "chart.svg", "", "k.md.txt"]
    assert values(*[paths.is_local_markdown(F.lit(x)) for x in yes + no]) == [True] * len(yes) + [False] * len(no)


def test_resolve(values):
    got = values(
        paths.link_path(F.lit("guide/parts/lamp.md"), F.lit("../tools/saw.md#teeth")),
        paths.link_path(F.lit("top.md"), F.lit("./guide//lamp.md")),
        paths.link_path(F.lit("top.md"), F.lit("../../beyond.md")),
        paths.edge_path(F.lit("guide/x/../../bin/run.py")),
        paths.edge_path(F.lit("guide/lamp.md#wire")),
        paths.edge_path(F.lit("lib/power/")),
        paths.edge_path(F.lit("")),
        paths.normal_path(F.lit("/a/../../b")),
    )
    assert got == ["guide/tools/saw.md", "guide/lamp.md", "../../beyond.md", "bin/run.py", "guide/lamp.md", "lib/power", ".", "/b"]


def test_edge_kind(values):
    cases = {"lamp.md#wire": "doc", "guide/saw.md#t:u": "doc", "bin/run.py": "code", "ftp://host.example/k": "external", "mailto:me@host.example": "external", "team/tools:lib/power": "cross-repo", "": "code", "k:v": "code"}
    assert values(*[paths.edge_kind(F.lit(k)) for k in cases]) == list(cases.values())


@pytest.mark.parametrize(
    ("glob", "path", "match"),
    [
        ("**/attic/**", "one/attic/two/three.md", True), ("**/attic/**", "attics/three.md", False), ("guide/*.md", "guide/parts/lamp.md", False), ("**/*.draft.md", "one/two/lamp.draft.md", True),
        (".claude/**", ".claude", True), (".claude/**", ".claude/a/b", True), ("a/**/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a[", "a[", False), ("[a-c]?.md", "bx.md", True), ("[^a].md", "/.md", False), ("**", "any/thing", True),
    ],
)
def test_globs(glob, path, match):
    assert bool(re.search(paths.glob_regex(glob).replace(r"\z", r"\Z"), path)) is match


def test_frontmatter_split(values):
    cases = {"---\na: 1\n---\nbody\n": ("a: 1", "body\n"), "no block": (None, "no block"), "x\n---\na\n---\n": (None, "x\n---\na\n---\n"), "---\nopen": (None, "---\nopen"), "---\n---\nb": ("", "b"), "---\r\na: 1\r\n---\r\nb": ("a: 1\r", "b")}
    got = values(*[c for k in cases for c in (M.block_text(F.lit(k)), M.body_text(F.lit(k)))])
    assert list(zip(got[::2], got[1::2], strict=True)) == list(cases.values())


def test_frontmatter_decode():
    d = frontmatter.decode("type: guide\ntitle: T\ntags: [a, b]\nverified: 2026-01-02\nservice: {x: 1}\nheading: h\nlinks:\n  - rel: covers\n    to: src\n    note: n")
    assert d == (None, "guide", "T", "", ["a", "b"], "2026-01-02", "", [{"rel": "covers", "to": "src", "note": "n"}], {"service": '{"x": "1"}', "heading": "h"})
    assert frontmatter.decode("")[:3] == (None, "", "")
    for bad in ("links: [", "- a", "type: [x]", "links: x", "a: 1\na: 2", "tags: {a: b}"):
        assert frontmatter.decode(bad)[0] == "malformed"


def test_first_heading(values):
    cases = {"# A\n": "A", "text\n# B ": "B", "```\n# no\n```\n# C": "C", "  # no": "", "#no": "", "## no": "", "~~~\n# no": "", "": "", "````\n# no\n~~~\n```\n# D": "D"}
    assert values(*[M.first_heading(F.lit(k)) for k in cases]) == list(cases.values())


def test_small_functions(values):
    assert values(*[views.review_days(F.lit(x)) for x in ("90d", "2w", "", "90", "-1d", "xd", " 7d ")]) == [90, 14, None, None, None, None, 7]
    yes, no = ["ROW_COUNT", "BlueTram", "XMLTree", "Q_12"], ["openDoor", "Garden", "Sum", "bar", "xyz", "K9", "small_words"]
    assert values(*[drift.looks_like_symbol(F.lit(x)) for x in yes + no]) == [True] * 4 + [False] * 7
    yes = ["> **Footgun: x**", "# Footgun — y", "- footgun: z", "Footguns: many", "**footgun - a** b", "footgun -", "  > * **Footgun:** x"]
    no = ["see the footgun above", "## Footguns", "footgun-drift runs"]
    assert values(*[drift.is_footgun(F.lit(x)) for x in yes + no]) == [True] * len(yes) + [False] * len(no)
    assert values(*[drift.split_range(F.lit(x)) for x in ("a..b", "a..", "a", "a..b..c")]) == [("a", "b"), None, None, ("a", "b..c")]
    assert selected_checks("leaks, edges") == ["orphans", "broken", "untracked", "frontmatter", "disconnected"]
    assert selected_checks("broken") == ["orphans", "untracked", "leaks", "frontmatter", "edges", "disconnected"]
    with pytest.raises(ValueError):
        selected_checks("nonsense")


def test_mentions_equal_brute_force(spark):
    rng = random.Random(5)
    nodes = ["a.md", "docs/a.md", "x-y/b.md", "d.md.md"]
    texts = ["".join(rng.choice([*nodes, "a", "/", ".", " ", "`", "-", ".md", "docs", "é"]) for _ in range(8)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {(r.i, r.p) for r in df.select("i", F.explode(M.mentioned_paths(F.col("t"))).alias("p")).collect() if r.p in nodes}
    want = {(i, n) for i, t in enumerate(texts) for n in nodes if re.search(r"(?:\A|[^A-Za-z0-9./_-])" + re.escape(n), t)}
    assert got == want
