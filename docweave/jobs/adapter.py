"""The given tables in the shapes that the jobs take: a corpus of repositories, diffs, pushes, runs.

Plain column arithmetic on ids, so that SQL can repeat it; input for the registered queries only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import paths as P
from docweave.functions.session import spread, table

REPOS = 20
NOW = "2026-01-01 00:00:00"

#: SQL of the document's path for an id expression; both engines read it.
PATH = "CASE WHEN {i} < 20 THEN 'README.md' WHEN {i} < 40 THEN 'CLAUDE.md' ELSE concat('docs/s', CAST(CAST(floor(({i}) / 20) AS BIGINT) % 7 AS STRING), '/d', CAST({i} AS STRING), '.md') END"
#: SQL of the file's text, one piece per line; a null piece is left out.
PIECES = (
    "CASE WHEN q % 3 <> 0 THEN '---' END",
    "CASE WHEN q % 3 <> 0 AND q % 23 = 5 THEN 'links: [' END",
    "CASE WHEN q % 3 <> 0 AND q % 5 <> 4 THEN concat('type: ', CASE q % 5 WHEN 0 THEN 'runbook' WHEN 1 THEN 'guide' WHEN 2 THEN 'recipe' ELSE '\"\"' END) END",
    "CASE WHEN q % 3 <> 0 AND q % 4 <> 1 THEN concat('title: Doc ', CAST(doc_id AS STRING)) END",
    "CASE WHEN q % 3 <> 0 AND q % 4 = 2 THEN 'description: about it' END",
    "CASE WHEN q % 3 <> 0 THEN concat('verified: 2025-0', CAST(q % 9 + 1 AS STRING), '-15') END",
    "CASE WHEN q % 3 <> 0 AND q % 2 = 0 THEN concat('review: ', CASE q % 6 WHEN 0 THEN '90d' WHEN 2 THEN '2w' ELSE 'soon' END) END",
    "CASE WHEN q % 3 <> 0 AND q % 23 <> 5 THEN 'links:' END",
    "CASE WHEN q % 3 <> 0 AND q % 23 <> 5 THEN concat('  - rel: part-of\n    to: ', up) END",
    "CASE WHEN q % 3 <> 0 AND q % 23 <> 5 THEN concat('  - rel: covers\n    to: src/m', CAST(q % 10 AS STRING), '/') END",
    "CASE WHEN q % 3 <> 0 AND q % 23 <> 5 AND q % 7 = 3 THEN concat('  - rel: see-also\n    to: ', far, '#top\n    note: same') END",
    "CASE WHEN q % 3 <> 0 AND q % 23 <> 5 AND q % 11 = 4 THEN '  - rel: source\n    to: https://example.com/a' END",
    "CASE WHEN q % 3 <> 0 THEN '---' END",
    "CASE WHEN q % 2 = 0 THEN concat('# Heading ', CAST(doc_id AS STRING)) END",
    "text",
    "CASE WHEN q % 4 < 3 THEN concat('See [next](', CASE WHEN doc_id < 40 THEN '' ELSE '../../' END, down, '#part) now.') END",
    "CASE WHEN q % 5 < 2 THEN concat('Also `', far, '` and x/', down, '.') END",
    "'```\n[decoy](decoy.md)\n~~~\n```'",
    "CASE WHEN q % 6 = 2 THEN concat('[gone](gone-', CAST(doc_id AS STRING), '.md)') END",
    "CASE WHEN q % 8 = 1 THEN '> **Footgun: mind the gap' END",
    "CASE WHEN q % 9 = 1 THEN concat('Uses OldWidget', CAST(q % 50 AS STRING), ' and MAX_ITEMS_', CAST(q % 50 AS STRING), ' of ', CAST(q % 50 + 10 AS STRING)) END",
)


def corpus_columns() -> list[str]:
    """The working columns over documents: q, and the paths of the own file, the one before, after and far ahead."""
    up = PATH.format(i="CASE WHEN doc_id % 13 = 5 THEN doc_id + 20 ELSE greatest(doc_id - 20, doc_id % 20) END")
    return ["doc_id", "text", "CAST(floor(doc_id / 20) AS BIGINT) AS q", f"{PATH.format(i='doc_id')} AS path", f"{up} AS up", f"{PATH.format(i='(doc_id + 20)')} AS down", f"{PATH.format(i='(doc_id + 60)')} AS far", "concat('r', CAST(doc_id % 20 AS STRING)) AS repo"]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files: a markdown file per document in twenty repositories, and code folders src/m0 to src/m4; every 17th markdown file is not tracked."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).selectExpr(*corpus_columns())
    content = F.concat_ws("\n", *[F.expr(p.replace("\n", "\\n")) for p in PIECES])
    docs = d.select("repo", F.lit("").alias("ref"), "path", content.alias("content"), (F.col("q") % 17 != 16).alias("tracked"))
    code = d.where("q % 12 = 3").selectExpr("repo", "'' AS ref", "concat('src/m', CAST(q % 5 AS STRING), '/f', CAST(doc_id AS STRING), '.go') AS path", "concat('type OldWidget', CAST(q % 25 AS STRING), ' struct {}') AS content", "true AS tracked")
    return docs.unionByName(code)


def corpus_at_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files of the working tree and of the ref `v1`, at which every third document and the code were not there yet."""
    now, number = corpus(spark, sf_dir), F.regexp_extract("path", r"/d(\d+)\.md$", 1).try_cast("int")
    return now.unionByName(now.where(P.is_markdown(F.col("path")) & (F.coalesce(number, F.lit(1)) % 3 != 0)).withColumn("ref", F.lit("v1")))


def part_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """diff_lines: for each part a file of a range in which a type goes, a constant changes, and lines are added."""
    p = spread(table(spark, sf_dir, "part"))
    lines = [
        "'diff --git a b'", "concat('--- a/src/p', k)", "concat('+++ b/src/p', k)", "concat('@@ -10,4 +', CAST(10 + p_partkey % 90 AS STRING), ',5 @@')",
        "concat('-type OldWidget', CAST(p_partkey % 50 AS STRING), ' struct')", "CASE WHEN p_partkey % 3 = 0 THEN concat('+type OldWidget', CAST(p_partkey % 50 AS STRING), ' struct') ELSE ' kept' END",
        "concat('-const MAX_ITEMS_', CAST(p_partkey % 50 AS STRING), ' = ', CAST(p_partkey % 50 + 10 AS STRING))", "concat('+const MAX_ITEMS_', CAST(p_partkey % 50 AS STRING), ' = ', CAST(p_size + 100 AS STRING))", "'+# footgun: new'", "' end'",
    ]
    base = p.selectExpr("*", "CAST(p_partkey AS STRING) AS k")
    rows = base.select("p_partkey", "p_size", "k", F.posexplode(F.array(*[F.expr(x) for x in lines])).alias("pos", "text"))
    return rows.selectExpr(
        "concat('r', CAST(p_partkey % 20 AS STRING)) AS repo", "concat('g', CAST(CAST(floor(p_partkey / 20) AS BIGINT) % 40 AS STRING)) AS range_id",
        "concat('src/p', k, CASE WHEN p_partkey % 10 = 9 THEN '.md' ELSE '.go' END) AS path", "CAST(p_partkey * 100 + pos AS BIGINT) AS seq", "text",
    )


def part_diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, range_id, text): a whole diff text for every range, with the files of its parts one after the other: changed ones, every seventh deleted, every eleventh renamed, in front
    of them one that is renamed only. Inside the hunks stand lines that look like headers."""
    p = table(spark, sf_dir, "part")
    name = "concat('src/p', k, CASE WHEN p_partkey % 10 = 9 THEN '.md' ELSE '.go' END)"
    old = f"CASE WHEN p_partkey % 11 = 5 THEN concat('old/p', k, '.go') ELSE {name} END"
    lines = [
        "CASE WHEN p_partkey % 13 = 4 THEN concat('diff --git a/only', k, '.md b/moved', k, '.md\nsimilarity index 100%\nrename from only', k, '.md\nrename to moved', k, '.md') END",
        f"concat('diff --git a/', {old}, ' b/', {name})", f"CASE WHEN p_partkey % 11 = 5 THEN concat('rename from ', {old}, '\nrename to ', {name}) WHEN p_partkey % 7 = 3 THEN 'deleted file mode 100644' END",
        f"concat('--- a/', {old})", f"CASE WHEN p_partkey % 7 = 3 AND p_partkey % 11 <> 5 THEN '+++ /dev/null' ELSE concat('+++ b/', {name}) END", "concat('@@ -10,5 +', CAST(10 + p_partkey % 90 AS STRING), ',6 @@')",
        "concat('-type OldWidget', CAST(p_partkey % 50 AS STRING), ' struct')", "CASE WHEN p_partkey % 3 = 0 THEN concat('+type OldWidget', CAST(p_partkey % 50 AS STRING), ' struct') ELSE ' kept' END",
        "'+++ b/decoy.md'", "'+# footgun: new'", "' diff --git a/decoy.md b/decoy.md'", "'--- a/decoy.md'",
    ]
    text = F.concat_ws("\n", *[F.expr(x.replace("\n", "\\n")) for x in lines])
    rows = p.withColumn("k", F.col("p_partkey").cast("string")).select((F.col("p_partkey") % 20).alias("r"), (F.floor(F.col("p_partkey") / 20) % 40).alias("g"), "p_partkey", text.alias("text"))
    whole = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))), lambda x: x["text"]), "\n"), F.lit("\n"))
    return rows.groupBy("r", "g").agg(whole.alias("text")).select(F.concat(F.lit("r"), "r").alias("repo"), F.concat(F.lit("g"), "g").alias("range_id"), "text")


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changes: code paths and documents changed in a range, from line items."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.selectExpr(
        "concat('r', CAST(l_orderkey % 20 AS STRING)) AS repo", "concat('g', CAST(l_orderkey % 100 AS STRING)) AS range_id",
        f"CASE WHEN l_linenumber % 3 = 0 THEN {PATH.format(i='(l_partkey * 20 + l_orderkey % 20)')} ELSE concat('src/m', CAST(l_partkey % 10 AS STRING), '/f', CAST(l_suppkey AS STRING), '.go') END AS path",
    )
    return rows.distinct()


def event_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pushes: a push line per event; every fifth is a new branch, every seventh a deletion, every eleventh is short."""
    e = table(spark, sf_dir, "events")
    zero = "'0000000000000000000000000000000000000000'"
    return e.selectExpr(
        "concat('u', CAST(user_id AS STRING)) AS repo", "ts", "event_id",
        f"CASE WHEN event_id % 11 = 10 THEN 'refs/x' ELSE concat_ws(' ', 'refs/heads/a', CASE WHEN event_id % 7 = 6 THEN {zero} ELSE concat('h', CAST(event_id AS STRING)) END, 'refs/heads/a', CASE WHEN event_id % 5 = 4 THEN {zero} ELSE concat('b', CAST(event_id AS STRING)) END) END AS line",
    )


def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base_candidates: three for the head of each event, none for every 13th."""
    e = table(spark, sf_dir, "events").where("event_id % 13 <> 12")
    rows = e.select("user_id", "event_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ord"))
    return rows.selectExpr("concat('u', CAST(user_id AS STRING)) AS repo", "concat('h', CAST(event_id AS STRING)) AS head", "ord", "concat('c', CAST(event_id + ord AS STRING)) AS base", "CAST((event_id * 7 + ord * 5) % 4 AS INT) AS n_commits")


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drift_runs: a run per event, its head from the event's type, findings for most."""
    return table(spark, sf_dir, "events").selectExpr("concat('u', CAST(user_id AS STRING)) AS repo", "ts", "event_id", "concat('h-', event_type) AS head", "CAST(event_id % 4 AS INT) AS n_findings")


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leak_rules as a table: each part denies a word in one repository, every ninth allows one in a folder of it; every repository lies below /work."""
    rows = table(spark, sf_dir, "part").selectExpr("concat('r', CAST(p_partkey % 20 AS STRING)) AS repo", "concat('OldWidget', CAST(p_partkey % 50 AS STRING)) AS raw", "p_partkey % 7 AS f", "p_partkey % 9 = 0 AS allows")
    deny = rows.selectExpr("repo", "CAST(NULL AS STRING) AS scope", "'deny' AS action", "false AS is_regex", "raw")
    return deny.unionByName(rows.where("allows").selectExpr("repo", "concat('/work/', repo, '/docs/s', CAST(f AS STRING)) AS scope", "'allow' AS action", "false AS is_regex", "raw"))


def part_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at the head of each range: a footgun declaration on the added line, for every fourth part one line below it."""
    k = "10 + p_partkey % 90 + 1 + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END"
    return spread(table(spark, sf_dir, "part")).selectExpr(
        "concat('r', CAST(p_partkey % 20 AS STRING)) AS repo", "concat('g', CAST(CAST(floor(p_partkey / 20) AS BIGINT) % 40 AS STRING)) AS range_id",
        "concat('src/p', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 10 = 9 THEN '.md' ELSE '.go' END) AS path",
        f"concat(repeat('\\n', CAST({k} AS INT)), '# footgun: new\\n', '# footgun: old')  AS content",
    )
