"""Whole diff texts as lines with the paths of their files.

A text is cut into lines once; everything behind that works on blocks of lines, so one huge diff spreads over all tasks. Which file a line belongs to is a
running count of the lines at which files begin: counted within each block first, then over the blocks, of which there are few, and carried down to the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines in a block.
BLOCK_LINES = 10_000
#: In front of the lines at which the files of a plain diff begin; no diff of text holds it.
MARK = "\x00"
#: A plain diff's file begins with two header lines in front of a hunk.
PLAIN = r"(?m)^(?=--- [^\n]*\n\+\+\+ [^\n]*\n@@ )"


def unquoted(name: Column) -> Column:
    """A path as a diff writes it: in quotes with escapes, octal ones for the bytes of other characters, or plain up to a tab."""
    inner = F.regexp_replace(name, r'^"|"\s*$', "")
    pieces = F.regexp_extract_all(inner, F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    escapes = {r"\n": "0A", r"\t": "09", r"\r": "0D", r"\a": "07", r"\b": "08", r"\f": "0C", r"\v": "0B", "\\\\": "5C", r"\"": "22"}

    def code(p: Column) -> Column:
        out = F.when(p.rlike(r"^\\[0-7]{3}$"), F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0"))
        for k, v in escapes.items():
            out = out.when(p == k, v)
        return out.otherwise(F.hex(p.cast("binary")))

    decoded = F.decode(F.unhex(F.array_join(F.transform(pieces, code), "")), "UTF-8")
    return F.when(name.startswith('"'), decoded).otherwise(F.regexp_extract(name, r"^([^\t]*)", 1))


def diff_lines(texts: DataFrame, prefixes: bool = True) -> DataFrame:
    """(repo, range_id, path, seq, text) of whole diff texts (repo, range_id, text): only the last line feed is dropped.

    seq counts from 0; several texts of a range follow each other in it, rows that agree in all columns count once. path: the file's new path, the old one where the new one is
    /dev/null; of files without hunks (renames, modes, binary files) the one in their header. Paths in quotes are decoded. With `prefixes`, `a/` and `b/` (or i, w, c, o) in
    front of paths are cut off. In diffs whose files begin with `diff `, nothing inside a hunk is taken for a header; in plain
    ones a `---` line counts as one where `+++` and `@@` lines follow. Lines in front of a text's first file have no path. A null text has no lines. Other columns are not looked at.
    """
    git = F.col("text").rlike("(?m)^diff ")
    marked = F.when(git, F.col("text")).otherwise(F.regexp_replace("text", PLAIN, MARK))
    # what is asked of a whole text stands in a select of its own: beside the explode it would be worked out for every line
    whole = texts.where("text is not null").select("repo", "range_id", F.xxhash64("text").alias("__t"), git.alias("__git"), F.split(F.regexp_replace(marked, r"\n\z", ""), "\n", -1).alias("__lines"))
    rows = whole.select("repo", "range_id", "__t", "__git", F.posexplode("__lines").alias("__pos", "text"))
    begins = F.when(F.col("__git"), F.col("text").startswith("diff ")).otherwise(F.col("text").startswith(MARK))
    rows = rows.select("repo", "range_id", "__t", F.floor(F.col("__pos") / F.lit(BLOCK_LINES)).alias("__block"), "__pos", begins.alias("__begins"), F.when(F.col("__git"), F.col("text")).otherwise(F.regexp_replace("text", f"^{MARK}", "")).alias("text"))
    key = ["repo", "range_id", "__t", "__block"]
    rows = rows.repartition(*key).dropDuplicates([*key, "__pos"])
    # of each block: the files that begin in front of it in its text, and the lines in front of it in its range
    blocks = rows.groupBy(*key).agg(F.count("*").alias("lines"), F.sum(F.col("__begins").cast("long")).alias("files"))
    above = W.orderBy("__t", "__block").rowsBetween(W.unboundedPreceding, -1)
    running = lambda c, *by: F.coalesce(F.sum(c).over(above.partitionBy(*by)), F.lit(0))
    carried = blocks.select(*[F.col(c).alias(f"b{c}") for c in key], running("lines", "repo", "range_id").alias("__lines"), running("files", "repo", "range_id", "__t").alias("__files"))
    inside = W.partitionBy(*key).orderBy("__pos")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    counted = rows.withColumn("__nth", F.sum(F.col("__begins").cast("long")).over(inside))
    # merged: by the size of a source whose texts become many lines, either side would seem small enough for a broadcast, which goes through the driver whole
    placed = counted.join(carried.hint("merge"), same("repo", "brepo") & same("range_id", "brange_id") & same("__t", "b__t") & same("__block", "b__block")).select(
        "repo", "range_id", "__t", (F.col("__files") + F.col("__nth")).alias("__file"), (F.col("__lines") + F.col("__pos") % BLOCK_LINES).cast("long").alias("seq"), "text"
    )
    file = ["repo", "range_id", "__t", "__file"]
    first = lambda start: F.min_by(F.when(F.col("text").startswith(start), F.col("text")), F.when(F.col("text").startswith(start), F.col("seq")))
    rest = lambda c, start: unquoted(F.substring(F.col(c), F.lit(len(start) + 1), F.lit(2147483647)))
    headers = {"old": "--- ", "new": "+++ ", "moved": "rename to ", "copied": "copy to ", "own": "diff --git "}
    heads = placed.where("__file > 0").where(" or ".join(f"startswith(text, '{h}')" for h in headers.values())).groupBy(*file).agg(*[first(h).alias(c) for c, h in headers.items()])
    bare = lambda c: F.regexp_replace(c, r"^[abiwco]/", "") if prefixes else c
    real = lambda c: F.when(c != "/dev/null", bare(c))
    both = r'^diff --git "?[abiwco]/(.+?)"? "?[abiwco]/\1"?$' if prefixes else r'^diff --git "?(.+?)"? "?\1"?$'
    same_name = F.regexp_extract("own", both, 1)
    listed = F.when(same_name != "", F.when(F.col("own").startswith('diff --git "'), unquoted(F.concat(F.lit('"'), same_name, F.lit('"')))).otherwise(same_name))
    path = F.coalesce(real(rest("new", "+++ ")), real(rest("old", "--- ")), rest("moved", "rename to "), rest("copied", "copy to "), listed)
    files = heads.select(*[F.col(c).alias(f"f{c}") for c in file], path.alias("path"))
    out = placed.join(files.hint("merge"), same("repo", "frepo") & same("range_id", "frange_id") & same("__t", "f__t") & same("__file", "f__file"), "left")
    return out.select("repo", "range_id", "path", "seq", "text")
