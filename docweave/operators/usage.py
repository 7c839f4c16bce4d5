"""Usage records of audit runs: counts by check, tiered details, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The checks, in order.
CHECKS = ("orphans", "broken", "untracked", "leaks", "frontmatter", "edges", "disconnected")


def selected_checks(skip: str = "") -> list[str]:
    """All checks but those named in a comma-separated list; an unknown name is an error."""
    names = [x.strip() for x in skip.split(",") if x.strip()]
    unknown = [x for x in names if x not in CHECKS]
    if unknown:
        raise ValueError(f"unknown check: {', '.join(unknown)}")
    return [c for c in CHECKS if c not in names]


def usage_records(repos: DataFrame, findings: DataFrame, checks: list[str], level: int = 1, ts: Column | None = None, version: str = "", cmd: str = "audit") -> DataFrame:
    """(ts, version, repo, cmd, checks, exit, counts, files, findings): a record of a run for each repository of `repos`.

    findings: repo, check, path, line, detail. checks are sorted; exit is 1 with findings, else 0; ts is now, if not given. counts has
    every selected check, zeros too. Level 2 adds files (path:line, never matched text), level 3 findings (whole text); otherwise these are null.
    """
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    # details are gathered at the levels that show them
    listing = {2: F.sort_array(F.collect_set(place)), 3: F.sort_array(F.collect_list(F.concat_ws(" ", place, "detail")))}.get(level, F.lit(None).cast("array<string>"))
    own = findings.where(F.col("check").isin(*checks)).groupBy("repo", "check").agg(F.count("*").alias("n"), listing.alias("listed"))
    entry = F.collect_list(F.struct("check", "n", "listed"))
    rows = repos.select("repo").distinct().join(own.groupBy("repo").agg(entry.alias("own")), "repo", "left")

    def count_of(check: str) -> Column:
        found = F.filter("own", lambda x: x["check"] == check)
        return F.coalesce(F.get(found, F.lit(0))["n"], F.lit(0).cast("long")).cast("int")

    counts = F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*map(count_of, checks)))
    listed = F.when(F.size("own") > 0, F.map_from_entries(F.transform(F.array_sort("own"), lambda x: F.struct(x["check"], x["listed"]))))
    none = F.lit(None).cast("map<string,array<string>>")
    total = F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return rows.select(
        (F.current_timestamp() if ts is None else ts).cast("timestamp").alias("ts"), F.lit(version).alias("version"), "repo", F.lit(cmd).alias("cmd"), F.array(*map(F.lit, sorted(checks))).cast("array<string>").alias("checks"),
        F.when(total > 0, 1).otherwise(0).alias("exit"), counts.alias("counts"), (listed if level == 2 else none).alias("files"), (listed if level == 3 else none).alias("findings"),
    )


def usage_trend(records: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, repo, check, n): findings per time window and check. records: ts, repo, counts (map). For streams too."""
    rows = records.select("ts", "repo", F.explode("counts").alias("check", "n"))
    return rows.groupBy(F.window("ts", width).alias("w"), "repo", "check").agg(F.sum("n").alias("n")).select(F.col("w.start").alias("start"), "repo", "check", "n")
