"""Leak rules as data: many of them, the texts they must hold, long lines."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docweave.functions.literals import folded, required_literal
from docweave.operators import leaks
from docweave.sources.files import Rule

RULES = "repo string, scope string, action string, is_regex boolean, raw string"


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [
        ("abc", "abc"), (r"a\.bc", "a.bc"), ("ab+c", "ab"), ("ab?cd", "cd"), ("x|y", ""), ("(x|y)tail", "tail"), (r"(?:long part){2}x", "long part"), (r"(?:long part)*xy", "xy"), ("[abc]de[^]]f", ""), ("[abc]de[^x]f", "de"),
        (r"(?P<n>name)=\d+", "name"), (r"(?-i)Key", "Key"), (r"(?iu)Key", "Key"), (r"\Qa\E", ""), (r"\x41b", ""), (r"\p{Lu}kk", "kk"), (r"a{0}b", "b"), (r"a{0,3}bc", "bc"), ("", ""), (r"\d{3}", ""), ("(?=ab)cde", "cde"),
        ("(?x)a b", ""), (r"[a-z0-9._%+-]+@[a-z]{2,}", "@"), (r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "."), ("a*?bc", "bc"), ("(", ""), ("ab[", ""), ("(a(b)c)d", "a"),
    ],
)
def test_required_literal(pattern, literal):
    assert required_literal(pattern) == literal


def test_required_literals_stand_in_every_match():
    rng = random.Random(11)

    def expression(depth=0):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            x = rng.choice(["a", "b", "ab", r"\.", "[ab]", ".", r"\d", "K"])
            if depth < 1 and rng.random() < 0.3:
                x = f"({rng.choice(['', '?:'])}{expression(depth + 1)})"
            parts.append(x[-1:] if len(x) > 1 and x.isalpha() and rng.random() < 0.3 else x)
            if rng.random() < 0.4:
                parts[-1] = parts[-1][:-2] + parts[-1][-2:] + rng.choice(["?", "{2}", "{0,1}", "{1,2}"] if x.startswith("(") else ["*", "+", "?", "{2}", "{0,1}", "{1,2}", "*?"])
        return rng.choice(["", "", "b|"] if depth else [""]) + "".join(parts)

    held = 0
    for _ in range(3000):
        p = expression()
        literal = folded(required_literal(p))
        held += bool(literal)
        text = "".join(rng.choice("abABk.1") for _ in range(30))
        for m in re.finditer(p, text, re.IGNORECASE):
            assert literal in folded(m[0]), (p, literal, m[0])
    assert held > 500


def test_case_is_folded_as_the_engine_does(spark):
    """For every letter whose case the engine ignores against an ASCII or Greek one."""
    text = "ſecret Key mıssıng İt ΣΑΣ Ω"
    rules = [Rule("deny", x) for x in ("secret", "KEY", "missing", "it", "σας", "ω")]
    df = spark.createDataFrame([(1, text)], "k int, text string")
    pattern = {r.raw: r.pattern for r in rules}
    want = {x for x, p in pattern.items() if spark.createDataFrame([(text,)], "t string").where(f"t rlike r'{p}'").count()}
    assert {r.rule for r in leaks.leak_findings(df, "text", rules).collect()} == want and {"secret", "KEY"} <= want


def many_rules(n_repos=1000, per=10):
    rows = []
    for i in range(n_repos):
        for j in range(per):
            kind = [("deny", False, f"term{i}x{j}"), ("deny", True, rf"key{i}_[0-9]{{{j % 3 + 1}}}"), ("allow", False, f"term{i}x{j}ok"), ("allow", True, f"key{i}_1+")][j % 4]
            rows.append((f"r{i}", f"/w/r{i}/sub" if j % 4 == 3 else None, *kind))
    return [*rows, (None, None, "deny", False, "everywhere"), (None, "/w/r7", "ignore", False, "skip/**"), ("r8", "/w/r8/", "allow", False, "everywhere")]


def plain_findings(files, rules):
    """Every rule on every line."""
    from docweave.functions.paths import glob_regex

    out = set()
    for repo, path, text in files:
        full = f"/w/{repo}/{path}"
        own = [r for r in rules if r[0] in (None, repo) and (r[1] is None or full.startswith(r[1].rstrip("/") + "/"))]
        if any(r[2] == "ignore" and re.search(glob_regex(r[4]).replace(r"\z", r"\Z"), full[len(r[1].rstrip("/")) + 1 :]) for r in own):
            continue
        for n, line in enumerate(text.split("\n")):
            spans = [(a, m.span(), m[0], raw) for _, _, a, rx, raw in own if a != "ignore" for m in re.finditer(raw if rx else re.escape(raw), line, re.IGNORECASE)]
            out |= {(repo, path, n + 1, s[0], m, raw) for a, s, m, raw in spans if a == "deny" and not any(b == "allow" and t[0] <= s[0] and t[1] >= s[1] for b, t, _, _ in spans)}
    return out


@pytest.mark.parametrize("part_bytes", [16 << 20, 300_000])
def test_ten_thousand_rules(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(leaks, "RULE_BYTES", part_bytes)
    rng = random.Random(2)
    rules = many_rules()
    files = []
    for i in range(400):
        r = rng.randrange(12)
        words = [rng.choice([f"TERM{r}x{rng.randrange(9)}", f"term{r}x2ok", f"key{r}_{rng.choice(['1', '11', '27', '305'])}", f"key{r + 1}_5", "Everywhere", "plain", "\n"]) for _ in range(25)]
        files.append((f"r{r}", rng.choice(["", "sub/", "skip/"]) + f"f{i}.md", " ".join(words)))
    df = spark.createDataFrame(files, "repo string, path string, content string")
    where = spark.createDataFrame([(f"r{i}", f"/w/r{i}") for i in range(12)], "repo string, root string")
    table = spark.createDataFrame(rules, RULES).repartition(5)
    found = leaks.scan_files(df, table, (), where)
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain_findings(files, rules))
    if part_bytes > 1 << 20:  # the plan does not grow with the rules
        few = leaks.scan_files(df, table.where("repo is null or repo in ('r1', 'r2')"), (), where)
        plan = lambda d: re.findall(r"\n[ :+-]*(\w+)", d._jdf.queryExecution().optimizedPlan().toString())
        assert plan(found) == plan(few) and len(plan(found)) < 20


def test_a_line_of_a_million_matches(spark):
    text = "key=1;" * 1_000_000 + "\nkey=2"
    df = spark.createDataFrame([(1, text)], "k int, text string")
    rules = [Rule("deny", r"key=[0-9]", True), Rule("deny", "nothing"), Rule("allow", "key=1;key=1;key=1")]
    began = time.time()
    got = leaks.leak_findings(df, "text", rules).selectExpr("count(*) n", "max(start) last", "sum(line) lines").first()
    # the allow rule takes three of three; one match is left over on the line
    assert (got.n, got.last, got.lines) == (2, 999_999 * 6, 3) and time.time() - began < 90


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a term", "x", "y"), (2, None, "x", "y")], "k int, text string, leak_line string, ask_text string")
    assert [tuple(r) for r in leaks.leak_findings(df, "text", [Rule("deny", "term")]).collect()] == [(1, "x", "y", 1, 2, "term", "term")]
    assert leaks.leak_findings(df, "text", [Rule("allow", "term")]).columns == ["k", "leak_line", "ask_text", "line", "start", "match", "rule"]
    assert leaks.leak_findings(df, "text", spark.createDataFrame([], RULES)).count() == 0


def test_repeated_rules_go_to_the_tasks_once(spark, monkeypatch):
    """A table with a rule many times: once in the tasks, and once with a line, also if it stands there for several folders."""
    sent, plain = [], leaks.candidate_lines

    def candidates(rows, rules, names, *columns):
        lines = plain(rows, rules, names, *columns)
        sent.append((len(rules), [len(r[names["rules"]]) for r in lines.collect()]))
        return lines

    monkeypatch.setattr(leaks, "candidate_lines", candidates)
    f = spark.createDataFrame([("r", "/d/e/a.md", "a term\nnone")], "repo string, path string, text string")
    table = [("r", None, "deny", False, "term")] * 50 + [("r", None, "deny", None, "term")] + [("r", s, "allow", False, "other term") for s in ("/d", "/d/e")] * 3 + [(None, None, "deny", False, "term")]
    got = leaks.leak_findings(f, "text", spark.createDataFrame(table, RULES), "path", "repo").collect()
    assert [(r.line, r.start, r.match) for r in got] == [(1, 2, "term")]
    assert sent == [(4, [1])]


def test_a_large_repository_meets_its_folder_in_many_tasks(spark):
    """Also where the table of folders is not sent to all tasks."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        f = spark.range(200).selectExpr("'r' AS repo", "concat('d', id, '.md') AS path", "'a term' AS content", "true AS tracked")
        rules = [Rule("deny", "term"), Rule("ignore", "d1.md", False, "/x/r")]
        got = leaks.scan_files(f, rules, (), spark.createDataFrame([("r", "/x/r/")], "repo string, root string"))
        sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in sizes) == 199 and max(r["count"] for r in sizes) < 120
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
