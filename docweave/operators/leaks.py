"""The leak scan: deny spans that no allow span covers, in one narrow pass over the lines.

Rules are data. They are looked for all at once: every match of a rule holds a literal part of it, and one automaton over the literal parts of all rules finds, in Arrow batches, the
lines and the rules that come into question. Only these lines go on, with their rules in an array, and are matched by Spark's own engine. So the plan is the same for
any number of rules.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import paths as P
from docweave.functions.literals import folded, required_literal
from docweave.functions.session import spool, unused
from docweave.sources.files import Rule, checked, looks_binary

MARK = "***REMOVED***"
#: Bytes of rules that go to the tasks together.
RULE_BYTES = 16 << 20
#: Keys that a repository has where its files meet a table of folders.
ROOT_PARTS = 64
RULES_KIND = "array<struct<deny:boolean,raw:string,pattern:string>>"


class RuleBook:
    """Rules by what they hold for, with the automaton over their literal parts. Made once in each process."""

    def __init__(self, rules: list[Rule]) -> None:
        import ahocorasick

        self.rules = rules
        self.patterns = [r.pattern for r in rules]
        self.ignores: dict = defaultdict(list)  # by repository and folder
        self.anywhere: dict = defaultdict(list)  # rules without a literal part
        literals: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(rules):
            place = (r.repo, r.scope and r.scope.rstrip("/"))
            literal = "" if r.action == "ignore" else folded(required_literal(self.patterns[i]) if r.is_regex else r.raw)
            if r.action == "ignore":
                self.ignores[place].append(re.compile(P.glob_regex(r.raw).replace(r"\z", r"\Z")))
            elif literal:
                literals[literal].append(i)
            else:
                self.anywhere[place].append(i)
        self.automaton = ahocorasick.Automaton()
        for x, own in literals.items():
            self.automaton.add_word(x, own)
        if literals:
            self.automaton.make_automaton()

    def places(self, repo: str | None, path: str | None) -> list[tuple]:
        """What a rule that holds for the row may be filed under."""
        up = [path[:k] for k, c in enumerate(path) if c == "/"] + [path] if path is not None else []
        return [(r, s) for r in ([None] if repo is None else [None, repo]) for s in [None, *dict.fromkeys(up)]]

    def lines(self, text: str, repo: str | None, path: str | None) -> dict[int, set[int]]:
        """Rules that come into question in each line, counted from 0; lines without a deny rule are left out."""
        places = self.places(repo, path)
        for place in places if self.ignores else ():
            if any(g.search(path[len(place[1]) + 1 :]) for g in self.ignores.get(place, ())):
                return {}
        found: dict[int, set[int]] = defaultdict(set)
        ends = None
        if len(self.automaton):
            for end, rules in self.automaton.iter(folded(text)):
                if ends is None:
                    ends = [m.start() for m in re.finditer("\n", text)]
                found[bisect_left(ends, end)].update(rules)
        everywhere = [i for place in places for i in self.anywhere.get(place, ())] if self.anywhere else []
        if any(self.rules[i].action == "deny" for i in everywhere):
            for k in range(text.count("\n") + 1):
                found[k].update(everywhere)
        own, out = set(places), {}
        for k, rules in found.items():
            holding = {i for i in rules if (self.rules[i].repo, self.rules[i].scope and self.rules[i].scope.rstrip("/")) in own}
            if any(self.rules[i].action == "deny" for i in holding):
                out[k] = holding.union(everywhere)
        return out


#: The rule book that this process has used last, by the number of its broadcast.
OPEN: dict = {}


def candidate_lines(rows: DataFrame, rules: list[Rule], names: dict[str, str], text_col: str, path_col: str | None, repo_col: str | None) -> DataFrame:
    """(columns of `rows` but the text, and by `names` line, text, rules): the lines in which a deny rule may match, with all rules that may."""
    keep = [c for c in rows.columns if c != text_col]
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(rules)
    number = f"{context.applicationId}-{shared._jbroadcast.id()}"
    asked = {"text": text_col} | ({"path": path_col} if path_col else {}) | ({"repo": repo_col} if repo_col else {})
    # what the rules ask for comes behind the columns that are kept
    given = rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").cast("string").alias(unused(f"ask_{k}", rows.columns)) for k, c in asked.items()])
    kind = T.StructType([*given.select(*keep).schema.fields, T.StructField(names["line"], T.IntegerType()), T.StructField(names["text"], T.StringType()), T.StructField(names["rules"], T._parse_datatype_string(RULES_KIND))])
    struct = pa.struct([("deny", pa.bool_()), ("raw", pa.string()), ("pattern", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in OPEN:
            OPEN.clear()
            OPEN[number] = RuleBook(shared.value)
        book = OPEN[number]
        for b in batches:
            at, line, text, held = [], [], [], []
            ask = {k: b.column(len(keep) + j).to_pylist() for j, k in enumerate(asked)}
            for i, own in enumerate(ask["text"]):
                if own is None or path_col and ask["path"][i] is None:
                    continue
                lines = book.lines(own, ask["repo"][i] if repo_col else None, ask["path"][i] if path_col else None)
                if lines:
                    cut = own.split("\n")
                    for k in sorted(lines):
                        at.append(i)
                        line.append(k + 1)
                        text.append(cut[k])
                        # rules of several folders or repositories may ask for the same
                        own_rules = dict.fromkeys((book.rules[j].action == "deny", book.rules[j].raw, book.patterns[j]) for j in sorted(lines[k]))
                        held.append([{"deny": deny, "raw": raw, "pattern": pattern} for deny, raw, pattern in own_rules])
            kept = b.select(b.schema.names[: len(keep)]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(line, pa.int32()), pa.array(text, pa.string()), pa.array(held, pa.list_(struct))], names=[f.name for f in kind])

    return given.mapInArrow(run, kind)


def uncovered(rules: list[dict]) -> dict[tuple, None]:
    """(start, match, rule) of the deny matches that no allow match covers, each once. rules: deny, raw, gaps (lengths of what stands between the matches) and found."""
    spans = []
    for r in rules:
        size = np.fromiter(map(len, r["found"]), np.int64, len(r["found"]))
        before = np.concatenate([[0], np.cumsum(r["gaps"])])
        start = before[np.minimum(np.arange(len(size)) + 1, len(before) - 1)] + np.cumsum(size) - size
        spans.append((start, start + size, size > 0))
    allowed = [np.stack([s[k], e[k]]) for r, (s, e, k) in zip(rules, spans, strict=True) if not r["deny"]]
    low, high = np.concatenate(allowed, axis=1) if allowed else np.zeros((2, 0), np.int64)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(order) else high
    out: dict[tuple, None] = {}
    for r, (s, e, full) in zip(rules, spans, strict=True):
        if r["deny"]:
            at = np.searchsorted(low, s, "right") - 1
            covered = (at >= 0) & (high[np.maximum(at, 0)] >= e) if len(low) else np.zeros(len(s), bool)
            for k in np.flatnonzero(full & ~covered).tolist():
                out[int(s[k]), r["found"][k], r["raw"]] = None
    return out


def leak_findings(rows: DataFrame, text_col: str, rules: list[Rule] | DataFrame, path_col: str | None = None, repo_col: str | None = None) -> DataFrame:
    """(columns of `rows` but the text, line, start, match, rule): deny matches that no allow match of the same line covers.

    rows: a text each; with `path_col` (absolute) dir rules apply: files that an ignore glob of a folder above
    matches are left out, allow rules of a folder hold below it; rows without a path have no findings. Rules of one repository hold for its rows only; without `repo_col` they
    hold for none. Findings are distinct by start, match and rule text. Null texts have no findings; no deny rules, none at all.

    rules: a list, or a table (repo, scope, action, is_regex, raw) of any size. Of a table, the rules of whole repositories go to the tasks in parts of RULE_BYTES, each with a
    scan of these repositories' rows; those of a single repository, and those of all, are in one part.
    """
    if isinstance(rules, DataFrame):
        # a rule that stands there twice finds nothing more, but would go with every line that it may match
        table = rules.select(F.col("repo").cast("string").alias("repo"), "scope", "action", F.coalesce("is_regex", F.lit(False)).alias("is_regex"), "raw").distinct()
        table = spool(table, "rules")
        size = table.agg(F.sum(F.octet_length("raw") + F.coalesce(F.octet_length("scope"), F.lit(0)) + 64)).first()[0] or 0
        parts = max(1, math.ceil(size / RULE_BYTES)) if repo_col else 1
        part = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(parts))
        scans = []
        for i in range(parts):
            own = table.where(F.col("repo").isNull() | (part(F.col("repo")) == i) if repo_col else F.col("repo").isNull()).collect()
            some = rows.where(part(F.col(f"`{repo_col}`")) == i) if parts > 1 else rows
            scans.append(leak_findings(some, text_col, [Rule(r.action, r.raw, bool(r.is_regex), r.scope, r.repo) for r in own], path_col, repo_col))
        return reduce(DataFrame.unionByName, scans)
    rules = [r for r in dict.fromkeys(checked(rules)) if (repo_col or r.repo is None) and (path_col or not r.scope)]
    keep = [c for c in rows.columns if c != text_col]
    fields = [*rows.select(*[F.col(f"`{c}`") for c in keep]).schema.fields]
    kind = T.StructType([*fields, T.StructField("line", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("match", T.StringType()), T.StructField("rule", T.StringType())])
    if not any(r.action == "deny" for r in rules):
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[len(keep) :]]
        return rows.where(F.lit(False)).select(*[F.col(f"`{c}`") for c in keep], *none)
    names = {k: unused(f"leak_{k}", keep) for k in ("line", "text", "rules")}
    lines = candidate_lines(rows, rules, names, text_col, path_col, repo_col)
    text = F.col(names["text"])
    matched = F.filter(names["rules"], lambda r: F.rlike(text, r["pattern"]))
    each = F.transform(matched, lambda r: F.struct(r["deny"].alias("deny"), r["raw"].alias("raw"), F.transform(F.split(text, r["pattern"], -1), F.length).alias("gaps"), F.regexp_extract_all(text, r["pattern"], F.lit(0)).alias("found")))
    hit = F.exists(names["rules"], lambda r: r["deny"] & F.rlike(text, r["pattern"]))
    hits = lines.where(hit).select(*[F.col(f"`{c}`") for c in keep], names["line"], each.alias(names["rules"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, line, out = [], b.column(len(keep)).to_pylist(), []
            for i, own in enumerate(b.column(len(keep) + 1)):
                found = uncovered(own.as_py())
                at.extend([i] * len(found))
                out.extend(found)
            kept = b.select(b.schema.names[: len(keep)]).take(pa.array(at, pa.int64()))
            start, match, rule = zip(*out, strict=True) if out else ((), (), ())
            more = [pa.array([line[i] for i in at], pa.int32()), pa.array(start, pa.int32()), pa.array(match, pa.string()), pa.array(rule, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[f.name for f in kind])

    return hits.mapInArrow(run, kind)


def scan_files(files: DataFrame, rules: list[Rule] | DataFrame, extra_ignores: tuple[str, ...] = (), root: str | DataFrame = "/") -> DataFrame:
    """Leak findings of all tracked files (repo, path, content): ignore globs of documents do not apply, extra ones do.

    root: where every repository lies, or a table (repo, root) with a folder for each; without one there, a repository lies at `/`.
    """
    rows = files.where(~P.matches_any(F.col("path"), list(extra_ignores)) & ~looks_binary(F.col("content")))
    if isinstance(root, str):
        top = F.lit(root)
    else:
        # contents are not dealt by repository: a small table of folders goes to them, for a large one each repository has many keys
        folders = spool(root.select("repo", "root").dropDuplicates(["repo"]).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(ROOT_PARTS - 1)))), "roots")
        rows, top = rows.withColumn("__part", F.pmod(F.xxhash64("path"), F.lit(ROOT_PARTS)).cast("int")).join(folders, ["repo", "__part"], "left"), F.coalesce("root", F.lit("/"))
    absolute = F.concat(F.regexp_replace(top, "/+$", ""), F.lit("/"), "path")
    rows = rows.select("repo", "path", absolute.alias("__abs"), F.col("content").cast("string").alias("content"))
    return leak_findings(rows, "content", rules, "__abs", "repo").drop("__abs")


def redaction_patterns(rules: list[Rule]) -> list[str]:
    """Deny rules in order, terms first, without repeats: what a redaction replaces."""
    deny = [r for r in checked(rules) if r.action == "deny"]
    ordered = [r for r in deny if not r.is_regex] + [r for r in deny if r.is_regex]
    return list(dict.fromkeys(r.pattern.removeprefix("(?-i)") for r in ordered))


def redacted(text: Column, rules: list[Rule]) -> Column:
    """The text with every match of a deny rule replaced, one rule after the other."""
    for p in redaction_patterns(rules):
        text = F.regexp_replace(text, p, MARK.replace("$", r"\$"))
    return text
