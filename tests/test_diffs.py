"""The reader of whole diff texts."""

import pytest

from docweave.operators import drift
from docweave.sources import diffs

GIT = """commit 1
--- not a header
diff --git a/lib/one.go b/lib/one.go
index 1..2 100644
--- a/lib/one.go
+++ b/lib/one.go
@@ -1,2 +5,3 @@
-type GoneThing struct
--- a/fake.md
+++ b/fake.md
+type NewThing struct
diff --git a/pages/gone.txt b/pages/gone.txt
deleted file mode 100644
--- a/pages/gone.txt
+++ /dev/null
@@ -1 +0,0 @@
-type ProseThing struct
diff --git a/was/here.go b/now/there.go
similarity index 90%
rename from was/here.go
rename to now/there.go
--- a/was/here.go
+++ b/now/there.go
@@ -3 +3 @@
-type MovedThing struct
diff --git a/a.bin b/a.bin
Binary files a/a.bin and b/a.bin differ
diff --git "a/caf\\303\\251 \\"x\\".go" "b/caf\\303\\251 \\"x\\".go"
old mode 100644
new mode 100755
diff --git a/with space.go b/with space.go
--- a/with space.go\t
+++ b/with space.go\t
@@ -1 +1 @@
+x
"""
PLAIN = "--- one.go\t2020-01-01\n+++ one.go\t2020-01-02\n@@ -1,2 +1,2 @@\n--- not\n+++ a header\n+x\n--- two.go\n+++ two.go\n@@ -1 +1 @@\n+y"
SCHEMA = "repo string, range_id string, text string, path int"


def read(spark, *texts, **options):
    rows = diffs.diff_lines(spark.createDataFrame([(r, g, t, 1) for r, g, t in texts], SCHEMA), **options).orderBy("repo", "range_id", "seq").collect()
    return [(r.repo, r.range_id, r.path, r.seq, r.text) for r in rows]


@pytest.mark.parametrize("lines", [1, 3, 10_000])
def test_paths_of_a_diff(spark, lines, monkeypatch):
    monkeypatch.setattr(diffs, "BLOCK_LINES", lines)
    got = read(spark, ("r", "g", GIT), ("r", "h", PLAIN), ("r", "n", None), (None, None, "a\n\nb\n"), ("r", "h", PLAIN))
    assert [t for r, g, _, _, t in got if g == "g"] == GIT.rstrip("\n").split("\n")
    assert [t for r, g, _, _, t in got if g == "h"] == PLAIN.split("\n")
    assert [(s, t) for r, g, _, s, t in got if r is None] == [(0, "a"), (1, ""), (2, "b")]
    assert [s for _, g, _, s, _ in got if g == "g"] == list(range(len(GIT.rstrip("\n").split("\n"))))
    order = list(dict.fromkeys(p for _, g, p, _, _ in got if g == "g"))
    assert order == [None, "lib/one.go", "pages/gone.txt", "now/there.go", "a.bin", 'café "x".go', "with space.go"]
    assert [p for _, g, p, _, _ in got if g == "g"].count("lib/one.go") == 9
    assert [p for _, g, p, _, _ in got if g == "h"] == ["one.go"] * 6 + ["two.go"] * 4


def test_two_texts_of_a_range_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(diffs, "BLOCK_LINES", 2)
    got = read(spark, ("r", "g", GIT), ("r", "g", "front\n" + GIT.replace("one", "uno")))
    n = len(GIT.rstrip("\n").split("\n"))
    assert [s for *_, s, _ in got] == list(range(2 * n + 1))
    assert {p for _, _, p, _, t in got if t in ("front", "commit 1", "--- not a header")} == {None}
    assert {p for _, _, p, _, _ in got} >= {"lib/one.go", "lib/uno.go"}


def test_without_prefixes(spark):
    assert {p for _, _, p, _, _ in read(spark, ("r", "g", "diff --git a/x.go a/x.go\n--- a/x.go\n+++ a/x.go\n@@ -1 +1 @@\n+x"), prefixes=False)} == {"a/x.go"}


def test_prose_falls_out_and_lines_are_numbered(spark):
    lines = diffs.diff_lines(spark.createDataFrame([("r", "g", GIT, 1)], SCHEMA))
    assert sorted(r.name for r in drift.removed_symbols(lines).collect()) == ["GoneThing", "MovedThing"]
    # a line that looks like a header counts as one of the new file
    assert sorted((r.path, r.line) for r in drift.added_lines(lines).collect()) == [("lib/one.go", 7), ("with space.go", 1)]


def test_nothing(spark):
    assert read(spark, ("r", "g", None)) == [] and diffs.diff_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_text_is_looked_at_once(spark):
    """The digest of a whole text is worked out below the explode, not for each of its lines."""
    plan = diffs.diff_lines(spark.createDataFrame([("r", "g", GIT, 1)], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64(text")


def test_lines_and_paths_of_a_small_source_are_not_broadcast(spark, tmp_path, capsys):
    """A small file whose texts become many lines: neither these nor the paths of its files go through the driver."""
    spark.createDataFrame([("r", f"g{i}", GIT, 1) for i in range(20)] + [(None, None, GIT, 1)], SCHEMA).write.parquet(f"{tmp_path}/texts")
    found = drift.removed_symbols(diffs.diff_lines(spark.read.parquet(f"{tmp_path}/texts")))
    assert sorted({r.name for r in found.collect()}) == ["GoneThing", "MovedThing"] and found.count() == 42
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 3
