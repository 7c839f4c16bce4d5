"""Path expressions: globs, link and edge targets, ancestors. All are plain column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ignore globs that hold everywhere.
DEFAULT_IGNORES = ("**/superpowers/**", ".claude/**", ".agents/**")
#: File endings that are prose, not code.
PROSE = ("md", "mdx", "txt", "rst", "adoc", "markdown")


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob over slash paths.

    `*`, `?` and `[..]` stay inside a segment; a segment `**` stands for any number of segments, none too. A malformed
    class never matches.
    """
    segments: list[str] = []
    for s in glob.split("/"):
        if not (s == "**" and segments and segments[-1] == "**"):
            segments.append(s)
    if segments == ["**"]:
        return r"\A.*\z"
    out, pending = "", False
    for i, s in enumerate(segments):
        if s == "**":
            if i == len(segments) - 1:
                out, pending = out + "(?:/.*)?", False
            else:
                out, pending = out + ("/" if pending else "") + "(?:[^/]*/)*", False
            continue
        part = segment_regex(s)
        if part is None:
            return r"\A(?!)\z"
        out, pending = out + ("/" if pending else "") + part, True
    return rf"(?s)\A{out}\z"


def segment_regex(segment: str) -> str | None:
    """The expression of one segment, None if its classes or escapes are malformed."""
    out, i = "", 0
    while i < len(segment):
        c = segment[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(segment):
                return None
            out += re.escape(segment[i])
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\\\]])(?:\\.|[^\\\]])*)\]", segment[i:])
            if not m:
                return None
            body = re.sub(r"([\[&^~])", r"\\\1", m[2])
            if body.startswith("-") or body.endswith("-"):
                return None
            out += f"(?!/)[{m[1]}{body}]"
            i += len(m[0]) - 1
        else:
            out += re.escape(c)
        i += 1
    return out


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether the path matches one of the globs."""
    found = [path.rlike(glob_regex(g)) for g in globs]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def is_markdown(path: Column) -> Column:
    return path.endswith(".md")


def is_code(path: Column) -> Column:
    """Not one of the prose endings."""
    return ~path.rlike(rf"\.(?:{'|'.join(PROSE)})$")


def clean_target(target: Column) -> Column:
    """The target up to the first `#`, `?`, space or tab."""
    return F.regexp_extract(target, r"\A[^#? \t]*", 0)


def is_local_markdown(target: Column) -> Column:
    """A link that points at a markdown file by a relative path."""
    cleaned = clean_target(target)
    return ~target.contains("://") & ~target.startswith("mailto:") & (cleaned != "") & ~cleaned.startswith("/") & cleaned.endswith(".md")


def normal_path(path: Column) -> Column:
    """The path without `.`, `..` and empty segments; leading `..` stay, nothing left is `.`; a leading slash stays."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    fold = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, s: F.when(s != "..", F.concat(a, F.array(s)))
        .when((F.size(a) > 0) & (F.get(a, F.size(a) - 1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1))
        .when(rooted, a)
        .otherwise(F.concat(a, F.array(s))),
    )
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(fold, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def folder(path: Column) -> Column:
    """The folder of a path, empty for a file at the root."""
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def link_path(source: Column, target: Column) -> Column:
    """Where a link of the file `source` points to, from the root."""
    inside = F.concat(folder(source), F.lit("/"), clean_target(target))
    return normal_path(F.when(folder(source) == "", clean_target(target)).otherwise(inside))


def edge_path(target: Column) -> Column:
    """Where a typed edge points to: from the root, without anchor and trailing slash."""
    return normal_path(clean_target(F.trim(target)))


def edge_kind(target: Column) -> Column:
    """external, cross-repo, doc or code, by the text of an edge's target."""
    t = F.trim(target)
    cleaned = clean_target(t)
    colon = F.instr(cleaned, ":")
    slash = F.instr(cleaned, "/")
    return (
        F.when(t.contains("://") | t.startswith("mailto:"), "external")
        .when((colon > 1) & (slash > 0) & (slash < colon), "cross-repo")
        .when(cleaned.endswith(".md"), "doc")
        .otherwise("code")
    )


def ancestors(path: Column, own: bool = True) -> Column:
    """The path (unless not `own`) and all folders above it, without the root."""
    n = F.size(F.split(path, "/")) - (0 if own else 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", path, F.lit("/"), i))).otherwise(F.array().cast("array<string>"))
