"""The incremental jobs as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweave.operators.drift import nearest_base, parsed_pushes
from docweave.operators.leaks import leak_findings, scan_files
from docweave.operators.usage import usage_trend
from docweave.sources.files import Rule

#: The state of a processor needs this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def push_stream(pushes: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Push lines (repo, line) as (repo, base, head), without state.

    A new branch takes its base from the table `candidates` (repo, head, ord, base, n_commits), as `push_ranges` does; without a candidate, or without that table, it is left out.
    """
    rows = parsed_pushes(pushes)
    if candidates is not None:
        nearest = nearest_base(candidates).withColumnRenamed("base", "nearest")
        rows = rows.join(nearest, ["repo", "head"], "left").withColumn("base", F.coalesce("base", "nearest"))
    return rows.where("base is not null").select("repo", "base", "head")


def leak_stream(files: DataFrame, rules: list[Rule] | DataFrame, extra_ignores: tuple[str, ...] = (), root: str | DataFrame = "/") -> DataFrame:
    """Leak findings of arriving texts (any key columns, text), or of arriving files as `read_repositories` streams them; without state.

    Of files, folder rules, ignores and the test for binary content hold as in `scan_files`.
    """
    if "text" in files.columns:
        return leak_findings(files, "text", rules)
    return scan_files(files, rules, extra_ignores, root)


def trend_stream(records: DataFrame, lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Findings per window and check of arriving usage records, as `usage_log` reads them; records later than `lateness` are left out.

    In append mode a window comes once the watermark has passed its end.
    """
    return usage_trend(records.withWatermark("ts", lateness), width)


class HeadGuard(StatefulProcessor):
    """Passes a run on if its head differs from that of the repository's run before it in event time.

    Runs wait until the watermark has passed them, as an earlier one may still come; a timer at the earliest one's time lets all go, in order, that are due then. What is kept of a
    repository, its last head, goes `forget` microseconds after that head's run.
    """

    def __init__(self, forget: int) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "head string, us bigint")
        self.waiting = handle.getListState("waiting", "us bigint, head string, n_findings int")

    def wake_at(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))  # the first millisecond that is not before

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            heads = [h if isinstance(h, str) else None for h in batch["head"]]
            self.waiting.appendList(list(zip(map(int, batch["us"]), heads, map(int, batch["n_findings"]), strict=True)))
            low = int(batch["us"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        runs = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in runs if r[0] <= now), key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
        head, at = self.last.get() if self.last.exists() else (None, None)
        out = []
        for run in due:
            if head is None or (run[1] is not None and run[1] != head):
                out.append(run)
            at, head = run[0], run[1]
        rest = [r for r in runs if r[0] > now]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.wake_at(min(r[0] for r in rest))
        if at is not None and at + self.forget > now:
            if due:
                self.last.update((head, at))
                self.wake_at(at + self.forget)
        elif self.last.exists():
            self.last.clear()
        if out:
            us, heads, counts = zip(*out, strict=True)
            yield pd.DataFrame({"repo": [key[0]] * len(out), "us": us, "head": heads, "n_findings": counts})

    def close(self) -> None:
        pass


def guard_stream(runs: DataFrame, lateness: str = "1 hour", forget: str = "365 days") -> DataFrame:
    """Runs (repo, ts, head, n_findings) that report a new head, as `once_per_head` finds them in a table, in whatever order they arrive.

    A run comes once the watermark, `lateness` behind the latest run, has passed it; runs that arrive later than that are left out, and so are those without a time, repository or number. Runs
    without findings change nothing. A repository without a run with findings for `forget` is forgotten: its next run reports.
    """
    with_findings = runs.where((F.col("n_findings") > 0) & F.col("ts").isNotNull() & F.col("repo").isNotNull()).withWatermark("ts", lateness)
    rows = with_findings.select("repo", "ts", F.unix_micros("ts").alias("us"), "head", F.col("n_findings").cast("int").alias("n_findings"))
    span = pd.Timedelta(forget) // pd.Timedelta("1us")
    found = rows.groupBy("repo").transformWithStateInPandas(HeadGuard(int(span)), "repo string, us bigint, head string, n_findings int", "append", "eventTime")
    return found.select("repo", F.timestamp_micros("us").alias("ts"), "head", "n_findings")
