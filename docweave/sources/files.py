"""Sources and sinks: tracked files, snapshots, leak rules, diffs, usage records."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes looked at when a file is tested for being binary.
SNIFF_BYTES = 8000


def read_files(spark: SparkSession, path: str, repo: str, root: str) -> DataFrame:
    """The files table of a folder that Spark reads: (repo, ref, path, content, tracked), content binary.

    Files that cannot be read are skipped.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(path)
    inside = F.regexp_replace(F.col("path"), "^" + re.escape(root.rstrip("/")) + "/", "")
    return found.select(F.lit(repo).alias("repo"), F.lit("").alias("ref"), inside.alias("path"), "content", F.lit(True).alias("tracked"))


#: What a scan of files yields; the folders of `read_repositories` add the last two.
BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def read_repositories(spark: SparkSession, top: str, tracked: DataFrame | None = None, stream: bool = False) -> DataFrame:
    """The files table of many repositories in one scan: (repo, ref, path, content, tracked) of the files below `top`/repo=<name>/ref=<ref>/, content binary.

    A filter on repo or ref reads those folders only. The working tree of a repository lies in the folder ref=__HIVE_DEFAULT_PARTITION__, its ref is null. tracked: a listing (repo, path, and ref if
    it differs by ref) of tracked files; those of the scan that it lacks are untracked. Without one all are tracked. With `stream`, files that arrive. Files that cannot be read are skipped.
    """
    reader = (spark.readStream if stream else spark.read).format("binaryFile").schema(f"{BINARY}, repo string, ref string")
    found = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(top)
    files = found.select("repo", "ref", F.regexp_replace("path", "^.*?/repo=[^/]*/ref=[^/]*/", "").alias("path"), "content")
    if tracked is None:
        return files.withColumn("tracked", F.lit(True))
    keys = [c for c in ("repo", "ref", "path") if c in tracked.columns]
    listed = tracked.select(*[F.col(c).alias(f"listed_{c}") for c in keys]).distinct().withColumn("tracked", F.lit(True))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"listed_{c}")) for c in keys])
    return files.join(listed, same, "left").select("repo", "ref", "path", "content", F.coalesce("tracked", F.lit(False)).alias("tracked"))


def snapshot(files: DataFrame, ref: str | None = None) -> DataFrame:
    """The working tree (an empty or null ref), or the files of one ref; a plain filter on `ref`, so that it prunes partitions."""
    return files.where(F.col("ref") == ref if ref else (F.col("ref") == "") | F.col("ref").isNull())


def looks_binary(content: Column) -> Column:
    """A zero byte among the first 8000 bytes; for binary and for text columns."""
    return F.instr(F.substring(content.cast("binary"), 1, SNIFF_BYTES).cast("string"), "\x00") > 0


#: A usage record, as it is written and read.
USAGE = "ts timestamp, version string, repo string, cmd string, checks array<string>, exit int, counts map<string,int>, files map<string,array<string>>, findings map<string,array<string>>"


def append_usage(records: DataFrame, path: str) -> None:
    """Append usage records as JSON lines; null fields are left out."""
    records.write.mode("append").option("ignoreNullFields", "true").json(path)


def usage_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The usage records appended to a folder, as a table or as a stream of those that arrive."""
    return (spark.readStream if stream else spark.read).schema(USAGE).json(path)


def write_report(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines in the order of a report: by repository, file, line, then the rest."""
    first = [c for c in ("repo", "path", "line", "start", "target", "match") if c in findings.columns]
    findings.orderBy(*first, *[c for c in findings.columns if c not in first]).write.json(path)


@dataclass(frozen=True)
class Rule:
    """scope: folder for dir rules; action: deny, allow or ignore; repo: the one repository it holds for, None for all."""

    action: str
    raw: str
    is_regex: bool = False
    scope: str | None = None
    repo: str | None = None

    @property
    def pattern(self) -> str:
        """What is searched: terms literally, all without regard to case unless the expression begins with (?-i)."""
        if not self.is_regex:
            return "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", self.raw)
        raw = engine_pattern(self.raw)
        return raw if raw.startswith("(?-i)") else "(?iu)" + raw


def engine_pattern(raw: str) -> str:
    """An expression as Spark's engine reads it: groups named `(?P<x>` are plain groups, `[[:alpha:]]` is a class of its own kind."""
    out = re.sub(r"((?:^|[^\\])(?:\\\\)*)\(\?P?<[A-Za-z_]\w*>", r"\1(", raw)
    posix = {"word": r"\\w"} | {k: rf"\\p{{{k.capitalize() if k != 'xdigit' else 'XDigit'}}}" for k in ("alnum", "alpha", "ascii", "blank", "cntrl", "digit", "graph", "lower", "print", "punct", "space", "upper", "xdigit")}
    for k, v in posix.items():
        out = out.replace(f"[:{k}:]", v.replace("\\\\", "\\"))
    return out


def rules_from_toml(text: str, repo: str | None = None) -> list[Rule]:
    """Rules of a config, for one repository or for all: terms, regex, allow, allow_regex and [[dir]] tables (path, ignore, allow, allow_regex).

    Blank entries are dropped; a bad expression or a folder that is not absolute is an error.
    """
    c = tomllib.loads(text) if text.strip() else {}
    out = [Rule("deny", x) for x in c.get("terms", [])] + [Rule("deny", x, True) for x in c.get("regex", [])]
    out += [Rule("allow", x) for x in c.get("allow", [])] + [Rule("allow", x, True) for x in c.get("allow_regex", [])]
    for d in c.get("dir", []):
        if not d["path"].startswith("/"):
            raise ValueError(f"not an absolute path: {d['path']}")
        out += [Rule("ignore", x, False, d["path"]) for x in d.get("ignore", [])]
        out += [Rule("allow", x, False, d["path"]) for x in d.get("allow", [])] + [Rule("allow", x, True, d["path"]) for x in d.get("allow_regex", [])]
    return checked([replace(r, repo=repo) for r in out])


def checked(rules: list[Rule]) -> list[Rule]:
    """Rules without blank ones; an expression that Spark's engine does not take is an error before any scan."""
    kept = [r for r in rules if r.raw.strip()]
    patterns = list(dict.fromkeys(r.pattern for r in kept if r.is_regex))
    if patterns:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        try:
            spark.createDataFrame([(p,) for p in patterns], "p string").where(F.rlike(F.lit(""), F.col("p"))).count()
        except Exception as e:
            raise ValueError(f"not an expression: {e}") from e
    return kept


def dropped_rules(rules: list[Rule], dirs: int | None = None) -> dict[str, int]:
    """What a redaction leaves out: `allows`, the allow rules of all scopes, and `dirs`, the folders with rules (`dirs` of a config says so for empty ones)."""
    kept = [r for r in rules if r.raw.strip()]
    return {"allows": sum(r.action == "allow" for r in kept), "dirs": len({r.scope for r in kept if r.scope}) if dirs is None else dirs}
