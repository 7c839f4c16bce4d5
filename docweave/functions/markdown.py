"""Markdown expressions: frontmatter, fences, inline code, links, headings, path mentions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First line `---`, a later line `---`; group 1 the block. The outer `??` must stay lazy.
BLOCK = r"\A---\r*\n(?s:(?:(.*?)\n)??---\r*(?=\n|\z))"
#: Fixed value: characters that count as space when text is trimmed.
SPACE = r"[\t\n\x0B\f\r \u0085   -     　]"
INLINE_LINK = r"\]\(([^)]+)\)"
REFERENCE = r"^\s*\[[^\]]+\]:\s+(\S+)"


def trimmed(text: Column) -> Column:
    """Without Unicode space at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def block_head(content: Column) -> Column:
    """The frontmatter with both its lines `---`, empty without a block; the text behind it is not read."""
    return F.when(content.startswith("---"), F.regexp_extract(content, BLOCK, 0)).otherwise("")


def head_text(head: Column) -> Column:
    """What stands between the lines of `block_head`."""
    return F.regexp_extract(head, BLOCK, 1)


def behind(content: Column, head: Column) -> Column:
    """What follows the frontmatter; all of the text without one."""
    return F.when(head != "", F.substring(content, F.length(head) + 2, F.length(content))).otherwise(content)


def has_block(content: Column) -> Column:
    return block_head(content) != ""


def block_text(content: Column) -> Column:
    """The frontmatter text, null without a block."""
    return let(block_head(content), lambda h: F.when(h != "", head_text(h)))


def body_text(content: Column) -> Column:
    """What follows the frontmatter block; all of it without a block."""
    return let(block_head(content), lambda h: behind(content, h))


def fenced_stretches(lines: Column) -> Column:
    """(from, to) line numbers of fenced code, from 0; a fence ends at the same character, an open one at the end."""
    # most lines hold neither character, which is seen without an expression
    near = F.filter(F.transform(lines, lambda x, k: F.struct(k.alias("k"), x.alias("x"))), lambda z: (z["x"].contains("`") | z["x"].contains("~")) & z["x"].rlike("[`~]{3}"))
    marks = F.filter(F.transform(near, lambda z: F.struct(z["k"].alias("k"), trimmed(z["x"]).alias("x"))), lambda z: z["x"].rlike("^[`~]{3,}"))
    marks = F.transform(marks, lambda z: F.struct(z["k"].alias("k"), F.substring(z["x"], 1, 1).alias("c")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    state = lambda o, b, iv: F.struct(o.alias("o"), b.cast("int").alias("b"), iv.alias("iv"))
    span = lambda b, e: F.array(F.struct(b.cast("int").alias("s"), e.cast("int").alias("e")))
    return F.aggregate(
        marks,
        state(F.lit(""), F.lit(-1), none),
        lambda a, z: F.when(a["o"] == "", state(z["c"], z["k"], a["iv"]))
        .when(a["o"] == z["c"], state(F.lit(""), F.lit(-1), F.concat(a["iv"], span(a["b"], z["k"]))))
        .otherwise(a),
        lambda a: F.when(a["o"] == "", a["iv"]).otherwise(F.concat(a["iv"], span(a["b"], F.lit(2147483647)))),
    )


def plain_lines(content: Column, keep: Callable[[Column], Column]) -> Column:
    """(line from 1, text) of the lines outside of fences for whose text `keep` holds; only these are held against the fences."""
    rows = lambda lines: F.filter(F.transform(lines, lambda x, k: F.struct((k + 1).cast("int").alias("line"), x.alias("text"))), lambda r: keep(r["text"]))
    outside = lambda v: F.filter(v["rows"], lambda r: ~F.exists(v["fences"], lambda f: (f["s"] < r["line"]) & (r["line"] - 1 <= f["e"])))
    lines = F.split(content, "\n", -1)
    fenced = let(lines, lambda x: let(F.struct(rows(x).alias("rows"), fenced_stretches(x).alias("fences")), outside))
    # the fold over fences is only worth its price where a fence is
    return F.when(content.rlike("[`~]{3}"), fenced).otherwise(rows(lines))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, though lambdas inside use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_inline_code(line: Column) -> Column:
    """Inline code blanked; an unclosed backtick blanks the rest of the line."""
    return F.regexp_replace(line, r"`[^`]*(`|$)", " ")


def links(files: DataFrame, content: Column) -> DataFrame:
    """(columns of `files`, line, target): inline links outside of code, then reference definitions at a line's start."""
    rows = files.withColumn("__l", F.explode(plain_lines(content, lambda text: text.contains("]"))))
    line = without_inline_code(F.col("__l.text"))
    inline = F.regexp_extract_all(line, F.lit(INLINE_LINK), F.lit(1))
    reference = F.when(line.rlike(REFERENCE), F.array(F.regexp_extract(line, REFERENCE, 1))).otherwise(F.array().cast("array<string>"))
    return rows.select(*[F.col(f"`{c}`") for c in files.columns], F.col("__l.line").alias("line"), F.explode(F.concat(inline, reference)).alias("target"))


def first_heading(body: Column) -> Column:
    """Text of the first `# ` line outside of fences, empty without one."""
    heads = plain_lines(body, lambda text: text.startswith("# "))
    return F.coalesce(trimmed(F.substring(F.get(heads, F.lit(0))["text"], F.lit(3), F.lit(2147483647))), F.lit(""))


def mentioned_paths(body: Column) -> Column:
    """Every `.md` path that the text mentions: prefixes, ending in `.md`, of runs of path characters."""
    # no run goes over a line; a run is looked at from its first character only, or a long one would be read once for each of its characters
    lines = F.array_join(F.filter(F.split(body, "\n", -1), lambda x: x.contains(".md")), "\n")
    runs = F.filter(F.array_distinct(F.regexp_extract_all(lines, F.lit(r"(?<![A-Za-z0-9./_-])[A-Za-z0-9./_-]*\.md[A-Za-z0-9./_-]*"), F.lit(0))), lambda r: r != "")
    prefixes = lambda r: F.transform(F.sequence(F.lit(1), F.size(F.split(r, r"\.md", -1)) - 1), lambda i: F.concat(F.array_join(F.slice(F.split(r, r"\.md", -1), F.lit(1), i), ".md"), F.lit(".md")))
    return F.array_distinct(F.flatten(F.transform(runs, prefixes)))
