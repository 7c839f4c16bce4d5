"""Documentation drift: what a range of commits changed against the documents that name or cover it.

diff_lines: (repo, range_id, path, seq, text); seq is a total order of the lines of a range. files: the current snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import markdown as M
from docweave.functions import paths as P
from docweave.functions.session import spool

#: What defines a name, what assigns a number, how a footgun is declared, where documents end.
DEFINES = r"(?:const|let|var|function|class|interface|type|enum|def|fn|func|struct|trait)\s+([A-Za-z_][A-Za-z0-9_]*)"
ASSIGNS = r"([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*([0-9][0-9]+)"
FOOTGUN = (
    r"(?iu)^\s*(?:>[ \t]*)*(?:#{1,6}\s*|[-*+]\s+)?\*{0,2}footguns?\s*(?::|—|-(?:\s|$))",
    r"(?iu)\*\*\s*footguns?\s*(?::|—|-(?:\s|$))",
)
DOCUMENTS = r"\.(?:md|mdx)$"
SYMBOLS, HITS = 40, 5
#: Bytes of the test that drops words before they are rows.
MOST_SLOTS = 1 << 20


def looks_like_symbol(name: Column) -> Column:
    """A distinctive name: SCREAMING_SNAKE with an underscore, or PascalCase with two humps; four characters at least."""
    snake = name.rlike(r"^[A-Z0-9_]+$") & name.contains("_") & name.rlike("[A-Z]")
    pascal = name.rlike(r"^[A-Z][A-Za-z0-9]*$") & name.rlike("[a-z]") & (F.regexp_count(name, F.lit("[A-Z]")) >= 2)
    return (F.length(name) >= 4) & (snake | pascal)


def side(diff: DataFrame) -> DataFrame:
    """Changed lines with side `+` or `-` and their content; headers and code-free paths are left out."""
    rows = diff.where(F.col("path").isNull() | P.is_code(F.col("path")))
    mark = F.substring("text", 1, 1)
    return rows.where(mark.isin("+", "-") & ~F.col("text").startswith("+++") & ~F.col("text").startswith("---")).select("repo", "range_id", "path", "seq", mark.alias("side"), F.substring(F.col("text"), F.lit(2), F.lit(2147483647)).alias("content"))


def removed_symbols(diff: DataFrame) -> DataFrame:
    """(repo, range_id, name): names whose definition a range removes and nowhere adds."""
    rows = side(diff).where(F.col("content").rlike(DEFINES)).select("repo", "range_id", "side", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(DEFINES), F.lit(1)))).alias("name"))
    each = rows.groupBy("repo", "range_id", "name").agg(F.max(F.col("side") == "+").alias("added"))
    return each.where(~F.col("added")).select("repo", "range_id", "name")


def changed_constants(diff: DataFrame) -> DataFrame:
    """(repo, range_id, name, old, new): names assigned another number; the last assignment of a side counts."""
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(ASSIGNS), F.lit(1)).alias("name"), F.regexp_extract_all("content", F.lit(ASSIGNS), F.lit(2)).alias("value"))
    rows = side(diff).where(F.col("content").rlike(ASSIGNS)).select("repo", "range_id", "side", "seq", F.posexplode(pairs).alias("pos", "p")).select("repo", "range_id", "side", "seq", "pos", "p.name", "p.value")
    last = lambda s: F.max_by(F.when(F.col("side") == s, F.col("value")), F.when(F.col("side") == s, F.struct("seq", "pos")))
    return rows.groupBy("repo", "range_id", "name").agg(last("-").alias("old"), last("+").alias("new")).where("old is not null and new is not null and old <> new")


def distinctive(symbols: DataFrame, limit: int = SYMBOLS) -> DataFrame:
    """The first names of a range, in order, that look like symbols."""
    order = W.partitionBy("repo", "range_id").orderBy("name")
    return symbols.where(looks_like_symbol(F.col("name"))).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def slot(repo: Column, token: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(repo, token), F.lit(slots)).cast("int")


def may_be_wanted(wanted: DataFrame) -> Callable[[Column, Column], Column]:
    """A test for tokens, inside the row: whether (repo, token) may be one of `wanted`. A text of at most MOST_SLOTS bytes, one for each slot of a hash; more tokens let more others through."""
    n = wanted.count()
    slots = min(MOST_SLOTS, 1 << max(10, (16 * n).bit_length()))
    taken = bytearray(slots)
    for r in wanted.select(slot(F.col("repo"), F.col("token"), slots).alias("at")).distinct().collect():
        taken[r["at"]] = 1
    return lambda repo, token: F.substring(F.lit(bytes(taken)), slot(repo, token, slots) + 1, F.lit(1)) == F.lit(b"\x01")


def token_lines(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """(repo, path, line, text, token): lines that hold one of the tokens (repo, token) as a whole word.

    Words that cannot be one of the tokens are dropped inside the row, so what is shuffled are lines with a token, once for each, and not words.
    """
    wanted = spool(tokens.select("repo", "token").distinct(), "tokens")
    maybe = may_be_wanted(wanted)
    words = lambda text: F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))), lambda w: maybe(F.col("repo"), w))
    lines = files.where("content is not null").select("repo", "path", F.posexplode(F.split("content", "\n", -1)).alias("k", "text"))
    found = lines.select("repo", "path", (F.col("k") + 1).cast("int").alias("line"), "text", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return found.withColumn("token", F.explode("words")).join(wanted, ["repo", "token"]).select("repo", "path", "line", "text", "token")


def first_hits(hits: DataFrame, limit: int = HITS) -> DataFrame:
    """The first hits of each range and name by path and line, a line once."""
    order = W.partitionBy("repo", "range_id", "name").orderBy("path", "line")
    return hits.dropDuplicates(["repo", "range_id", "name", "path", "line"]).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def is_document(path: Column) -> Column:
    return path.rlike(DOCUMENTS)


def dangling_references(diff: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, range_id, name, path, line, text): documents that still name a symbol that code no longer holds."""
    gone = removed_symbols(diff).where(looks_like_symbol(F.col("name")))
    wanted = gone.select("repo", F.col("name").alias("token")).distinct()
    alive = token_lines(files.where(P.is_code(F.col("path"))), wanted).select("repo", F.col("token").alias("name")).distinct()
    lost = distinctive(gone.join(alive, ["repo", "name"], "left_anti"))
    hits = token_lines(files.where(is_document(F.col("path"))), lost.select("repo", F.col("name").alias("token")))
    found = lost.join(hits.withColumnRenamed("token", "name"), ["repo", "name"])
    return first_hits(found.select("repo", "range_id", "name", "path", "line", M.trimmed(F.col("text")).alias("text")))


def value_drift(diff: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, range_id, name, old, path, line, text): documents naming a changed constant, at the first lines with its old number; all constants of a range that look like symbols."""
    changed = changed_constants(diff).where(looks_like_symbol(F.col("name")))
    docs = files.where(is_document(F.col("path")))
    naming = token_lines(docs, changed.select("repo", F.col("name").alias("token"))).select("repo", "path", F.col("token").alias("name")).distinct()
    lines = token_lines(docs, changed.select("repo", F.col("old").alias("token"))).withColumnRenamed("token", "old")
    found = changed.join(naming, ["repo", "name"]).join(lines, ["repo", "path", "old"])
    return first_hits(found.select("repo", "range_id", "name", "old", "path", "line", M.trimmed(F.col("text")).alias("text")))


def added_lines(diff: DataFrame) -> DataFrame:
    """(repo, range_id, path, line): new line numbers of added lines, counted from each hunk's header.

    A `+` line (no `+++`) takes the counter and moves it on, a `-` line (no `---`) does not, every other line
    moves it on.
    """
    start = F.regexp_extract("text", r"^@@ [^+]*\+(\d+)", 1)
    head = F.col("text").startswith("@@") & (start != "")
    plus = F.col("text").startswith("+") & ~F.col("text").startswith("+++")
    minus = F.col("text").startswith("-") & ~F.col("text").startswith("---")
    by_file = W.partitionBy("repo", "range_id", "path").orderBy("seq")
    rows = diff.select("repo", "range_id", "path", "seq", F.when(head, start.cast("int")).alias("start"), (plus & ~head).alias("plus"), (~minus & ~head).cast("int").alias("moves"))
    # both windows have the same order, so a task sorts and holds its lines once
    passed = rows.withColumn("passed", F.coalesce(F.sum("moves").over(by_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at_zero = F.last(F.col("start") - F.col("passed"), ignorenulls=True).over(by_file.rowsBetween(W.unboundedPreceding, W.currentRow))
    counted = passed.withColumn("at_zero", at_zero).where("plus and at_zero is not null")
    return counted.select("repo", "range_id", "path", (F.col("at_zero") + F.col("passed")).cast("int").alias("line"))


def is_footgun(line: Column) -> Column:
    """A line that declares a footgun, in code fences too."""
    return line.rlike(FOOTGUN[0]) | line.rlike(FOOTGUN[1])


def footguns(files: DataFrame) -> DataFrame:
    """(columns without content, line, text): footgun declarations of the given files."""
    keep = [c for c in files.columns if c != "content"]
    rows = files.where(F.col("content").rlike("(?i)footgun")).select(*keep, F.posexplode(F.split("content", "\n", -1)).alias("k", "text"))
    return rows.where(is_footgun(F.col("text"))).select(*keep, (F.col("k") + 1).cast("int").alias("line"), M.trimmed(F.col("text")).alias("text"))


def footguns_added(diff: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, path, line, text): declarations on added lines. heads: repo, range_id, path, content at the range's head."""
    # merged: by the size of a source whose rows become many lines, the lines would seem few enough for a broadcast, which every task holds whole
    return footguns(heads).join(added_lines(diff).hint("merge"), ["repo", "range_id", "path", "line"], "left_semi").select("repo", "path", "line", "text").distinct()


def push_ranges(pushes: DataFrame, nearest: DataFrame) -> DataFrame:
    """(repo, base, head) of push lines `local-ref local-sha remote-ref remote-sha`; deletions and short lines are skipped.

    A new branch (remote sha of zeros) takes its base from `nearest` (repo, head, base); without one there is no range.
    """
    rows = parsed_pushes(pushes)
    known = rows.where("base is not null")
    new = rows.where("base is null").drop("base").join(nearest.select("repo", "head", "base"), ["repo", "head"]).select("repo", "base", "head")
    return known.select("repo", "base", "head").unionByName(new)


def parsed_pushes(pushes: DataFrame) -> DataFrame:
    """(repo, head, base): base is null for a new branch. Stateless, for streams too."""
    f = F.split(M.trimmed(F.col("line")), r"\s+")
    zero = lambda c: c.rlike("^0+$")
    rows = pushes.where(F.size(f) >= 4).select("repo", F.get(f, F.lit(1)).alias("head"), F.get(f, F.lit(3)).alias("remote"))
    return rows.where(~zero(F.col("head"))).select("repo", "head", F.when(~zero(F.col("remote")), F.col("remote")).alias("base"))


def nearest_base(candidates: DataFrame) -> DataFrame:
    """(repo, head, base): the candidate with the fewest commits, the first in list order among equals. candidates: repo, head, ord, base, n_commits."""
    return candidates.groupBy("repo", "head").agg(F.min_by("base", F.struct("n_commits", "ord")).alias("base"))


def split_range(text: Column) -> Column:
    """base and head of `base..head`, null unless both are there."""
    p = F.split(text, r"\.\.", 2)
    both = (F.size(p) == 2) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != "")
    return F.when(both, F.struct(F.get(p, F.lit(0)).alias("base"), F.get(p, F.lit(1)).alias("head")))


def once_per_head(runs: DataFrame, tie: tuple[str, ...] = ("head", "n_findings")) -> DataFrame:
    """Runs with findings whose head differs from the last head reported for the repository. runs: repo, ts, head, n_findings; `tie` orders runs of the same time."""
    with_findings = runs.where("n_findings > 0")
    before = F.lag("head").over(W.partitionBy("repo").orderBy("ts", *tie))
    return with_findings.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col("head"))).drop("__b")
