"""The incremental jobs on small streams."""

import datetime as dt
import random

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from docweave.operators import leaks
from docweave.operators.drift import nearest_base, once_per_head, push_ranges
from docweave.operators.usage import usage_records, usage_trend
from docweave.sources import files as S
from docweave.sources.files import Rule, append_usage, rules_from_toml, usage_log
from docweave.streaming import jobs


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_push_and_leak_streams(spark, tmp_path):
    spark.createDataFrame([("r", "a h1 a b1"), ("r", "x")], "repo string, line string").write.parquet(str(tmp_path / "p"))
    s = spark.readStream.schema("repo string, line string").parquet(str(tmp_path / "p"))
    assert [tuple(r) for r in drained(jobs.push_stream(s), "pushes")] == [("r", "b1", "h1")]
    spark.createDataFrame([("f", "a secret")], "path string, text string").write.parquet(str(tmp_path / "f"))
    s = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "f"))
    assert [r.match for r in drained(jobs.leak_stream(s, [Rule("deny", "secret")]), "leaks")] == ["secret"]


def test_leak_stream_of_files_equals_the_scan(spark, tmp_path):
    """Files arrive in parts; folder rules, ignores and the binary test hold, and a query that starts again goes on where it was."""
    rules = rules_from_toml('terms = ["term"]\nregex = ["key-[0-9]+"]\n[[dir]]\npath = "/w/r1/vendor"\nignore = ["**"]\n[[dir]]\npath = "/w/r1/sub"\nallow = ["term"]') + rules_from_toml('terms = ["other"]', "r2")
    tree = {"a.md": b"term other", "sub/b.md": b"term key-12", "vendor/c.md": b"term", "bin/d": b"term\0", "skip/e.md": b"term", "f.md": "übrig TERM\nkey-3".encode()}
    top, ends = tmp_path / "files", []

    def arrive(repo, names):
        for n in names:
            p = top / f"repo={repo}/ref=__HIVE_DEFAULT_PARTITION__" / n
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(tree[n])

    where = spark.createDataFrame([("r1", "/w/r1"), ("r2", "/w/r2")], "repo string, root string")
    for k, (repo, names) in enumerate([("r1", ["a.md", "bin/d"]), ("r2", ["a.md", "sub/b.md"]), ("r1", ["sub/b.md", "vendor/c.md", "skip/e.md", "f.md"])]):
        arrive(repo, names)
        found = jobs.leak_stream(S.read_repositories(spark, f"file://{top}", stream=True), rules, ("skip/**",), where)

        def put(batch, number, fail=k == 1):
            if fail and not ends:
                ends.append(number)
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))

        for _ in range(2):  # after a failure the query starts again
            q = found.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except StreamingQueryException:
                continue
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()))
    assert ends and got == sorted(map(tuple, leaks.scan_files(S.read_repositories(spark, f"file://{top}"), rules, ("skip/**",), where).collect())) and len(got) == 8


def test_push_stream_equals_batch(spark, tmp_path):
    """New branches take the nearest of their candidates; deletions, short lines and branches without a candidate have no range."""
    zero = "0" * 40
    lines = [("r", f"x h{i} x {zero if i % 3 == 0 else f'b{i}'}") for i in range(12)] + [("r", f"x {zero} x b"), ("q", f"x h0 x {zero}"), ("q", "short"), ("r", f"x gone x {zero}")]
    pushes = spark.createDataFrame(lines, "repo string, line string")
    candidates = spark.createDataFrame([("r", f"h{i}", k, f"c{i}-{k}", (i * 7 + k * 5) % 4) for i in range(12) for k in range(3)] + [("q", "h0", 0, "only", 9)], "repo string, head string, ord int, base string, n_commits int")
    for part in pushes.randomSplit([1.0, 1.0, 1.0], 3):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(pushes.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "p"))
    got = drained(jobs.push_stream(stream, candidates), "push_bases")
    want = push_ranges(pushes, nearest_base(candidates)).select("repo", "base", "head").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 13


def test_guard_stream(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [("r", t0 + dt.timedelta(hours=i), h, n) for i, (h, n) in enumerate([("A", 1), ("A", 2), ("B", 1), ("A", 1), ("C", 0), ("A", 3)])]
    schema = "repo string, ts timestamp, head string, n_findings int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "g"))
    got = drained(jobs.guard_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "g"))), "guard")
    assert sorted(r.ts.hour for r in got) == [0, 2, 3]


def test_guard_stream_equals_batch_in_any_order(spark, tmp_path):
    """Runs of several repositories arrive out of order over many micro-batches, up to two hours late; a last run lets all go."""
    rng, t0 = random.Random(4), dt.datetime(2026, 1, 1)
    runs = [(rng.choice(["r1", "r2", "r3"]), t0 + dt.timedelta(minutes=7 * i // 2, microseconds=rng.randrange(3)), rng.choice(["A", "B", "C", None]), rng.randrange(0, 3)) for i in range(160)]
    schema = "repo string, ts timestamp, head string, n_findings int"
    arrival = sorted(runs, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(100)))
    for k in range(0, len(arrival), 20):
        spark.createDataFrame(arrival[k : k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "g"))
    spark.createDataFrame([("end", t0 + dt.timedelta(days=3), "Z", 1), ("r1", None, "A", 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "g"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "g"))
    got = drained(jobs.guard_stream(stream, "2 hours"), "guard_order")
    want = once_per_head(spark.createDataFrame(runs, schema)).collect()
    key = lambda r: (r.repo, r.ts, r.head or "", r.n_findings)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 40


def test_guard_forgets_quiet_repositories(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    schema = "repo string, ts timestamp, head string, n_findings int"
    for k, (repo, day) in enumerate([("r", 0), ("r", 1), ("q", 5), ("r", 6), ("q", 9)]):
        spark.createDataFrame([(repo, t0 + dt.timedelta(days=day), "A", 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "g"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "g"))
    got = drained(jobs.guard_stream(stream, "1 hour", "2 days"), "guard_forgets")
    assert sorted((r.repo, (r.ts - t0).days) for r in got) == [("q", 5), ("r", 0), ("r", 6)]


def test_trend_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(t0 + dt.timedelta(hours=9 * i), "r", {"leaks": i, "links": 1}) for i in range(8)]
    schema = "ts timestamp, repo string, counts map<string,int>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "u"))
    got = drained(jobs.trend_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "u"))), "trend", "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, usage_trend(spark.createDataFrame(rows, schema)).collect()))


def test_usage_log_feeds_the_trend(spark, tmp_path):
    """Records written by runs come back as a stream; a window comes once, when the watermark has passed it."""
    path = str(tmp_path / "log")
    repos = spark.createDataFrame([("r",)], "repo string")
    found = spark.createDataFrame([("r", "leaks", "a", 1, "x")], "repo string, check string, path string, line int, detail string")
    times = ["2026-01-01 01:00:00", "2026-01-01 20:00:00", "2026-01-02 05:00:00", "2026-01-01 02:00:00", "2026-01-04 00:00:00"]
    append_usage(usage_records(repos, found, ["leaks", "broken"], 1, F.lit(times[0])), path)
    q = jobs.trend_stream(usage_log(spark, path, stream=True)).writeStream.outputMode("append").format("memory").queryName("log_trend").start()
    for t in times[1:]:
        append_usage(usage_records(repos, found, ["leaks", "broken"], 1, F.lit(t)), path)
        q.processAllAvailable()
    q.stop()
    got = {(str(r.start), r.check): r.n for r in spark.table("log_trend").collect()}
    # the record of 02:00 came after the watermark of the second day and is left out
    assert got == {("2026-01-01 00:00:00", "leaks"): 2, ("2026-01-01 00:00:00", "broken"): 0, ("2026-01-02 00:00:00", "leaks"): 1, ("2026-01-02 00:00:00", "broken"): 0}
