"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.frontmatter import docs_of
from docweave.functions.session import spool, spread, table
from docweave.jobs import adapter as A
from docweave.operators import drift, graph, leaks, segments, usage, views
from docweave.sources.diffs import diff_lines
from docweave.sources.files import Rule, snapshot

TERMS = ("apache license", "password")
REGEX = (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", r"token = \"[0-9a-f]{40}\"", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
ALLOW = ("licensed under the apache license",)
ALLOW_REGEX = (r"[a-z0-9._%+-]+@mail[0-4]\.example\.com",)
RULES = [Rule("deny", x) for x in TERMS] + [Rule("deny", x, True) for x in REGEX] + [Rule("allow", x) for x in ALLOW] + [Rule("allow", x, True) for x in ALLOW_REGEX]
#: Folder rules over the corpus, as if every repository lay below /data.
DIR_RULES = [Rule("deny", "Footgun"), Rule("deny", "OldWidget[0-9]+", True), Rule("ignore", "**/d*1.md", False, "/data/docs"), Rule("allow", "OldWidget1", False, "/data/docs/s3"), Rule("allow", "> **footgun", False, "/data/docs/s4")]


#: Rules of single repositories, and one of a folder of one of them; repositories lie in folders of their own.
REPO_RULES = [Rule("deny", "Footgun", repo="r1"), Rule("deny", "OldWidget[0-9]+", True, repo="r2"), Rule("deny", "MAX_ITEMS_(?P<n>[0-9]+)", True), Rule("allow", "OldWidget1", False, "/work/r2/docs/s3", "r2"), Rule("allow", "MAX_ITEMS_3", False, "/work/r3/docs")]


def leak_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_findings(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", RULES)


def leak_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.corpus(spark, sf_dir)
    where = files.select("repo").distinct().withColumn("root", F.concat(F.lit("/work/"), "repo", F.lit("/")))
    return leaks.scan_files(files, REPO_RULES, (), where)


def leak_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leak scan with a table of rules, as many as there are parts."""
    files = A.corpus(spark, sf_dir)
    where = files.select("repo").distinct().withColumn("root", F.concat(F.lit("/work/"), "repo"))
    return leaks.scan_files(files, A.part_rules(spark, sf_dir), (), where)


def leak_findings_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_findings(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "html", RULES)


def leak_dir_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.scan_files(A.corpus(spark, sf_dir), DIR_RULES, ("**/d*7.md",), "/data")


def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", leaks.redacted(F.col("text"), RULES).alias("text"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed once and spooled, as several operators read it."""
    return spool(docs_of(graph.markdown_nodes(A.corpus(spark, sf_dir))).drop("content", "body"), "docs")


def content_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.content_edges(A.corpus(spark, sf_dir))


def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mention_edges(graph.markdown_nodes(A.corpus(spark, sf_dir)))


def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(content_edges(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(A.corpus(spark, sf_dir), content_edges(spark, sf_dir))


def own_ignores(spark: SparkSession) -> DataFrame:
    """Globs of two repositories."""
    return spark.createDataFrame([("r1", "docs/s1/**"), ("r1", "**/d*3.md"), ("r2", "docs/*/d?[0-4]*.md")], "repo string, glob string")


def orphans_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans with ignore globs and further roots of single repositories."""
    files, ignores = A.corpus(spark, sf_dir), own_ignores(spark)
    more = spark.createDataFrame([("r1", "./docs//s2/../s2/d41.md"), ("r3", "docs/s2/d43.md"), ("r4", "gone.md")], "repo string, path string")
    return graph.orphans(files, graph.content_edges(files, ignores), ignores, more)


def orphans_at_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans among the files of a ref instead of the working tree."""
    files = snapshot(A.corpus_at_refs(spark, sf_dir), "v1")
    return graph.orphans(files, graph.content_edges(files))


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.broken_links(A.corpus(spark, sf_dir))


def broken_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.broken_edges(A.corpus(spark, sf_dir), docs(spark, sf_dir))


def frontmatter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.frontmatter_findings(docs(spark, sf_dir))


def frontmatter_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("has_frontmatter and error is null")
    return d.select("repo", "path", "type", "title", "description", "verified", "review", "heading", F.size("links").alias("n_links"))


def untracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.untracked(A.corpus(spark, sf_dir))


def metadata_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.metadata_edges(A.corpus(spark, sf_dir), docs(spark, sf_dir))


def metadata_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.metadata_degree(metadata_edges(spark, sf_dir))


def disconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return graph.disconnected(d, graph.metadata_edges(A.corpus(spark, sf_dir), d))


def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_members(graph.hierarchy_arcs(A.corpus(spark, sf_dir), docs(spark, sf_dir)))


def cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_paths(graph.hierarchy_arcs(A.corpus(spark, sf_dir), docs(spark, sf_dir)))


def part_of_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return graph.part_of_tree(d, graph.metadata_edges(A.corpus(spark, sf_dir), d)).withColumn("trail", F.array_join("trail", " > "))


def cross_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_references(metadata_edges(spark, sf_dir))


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.index_entries(docs(spark, sf_dir))


def index_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.index_markdown(docs(spark, sf_dir))


def stale_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.stale_docs(docs(spark, sf_dir), A.NOW)


def covers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = A.order_changes(spark, sf_dir).select("repo", "path").distinct()
    return views.covers_of(docs(spark, sf_dir), wanted)


def covers_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.covers_drift(A.order_changes(spark, sf_dir), docs(spark, sf_dir), ",")


def covers_drift_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.covers_drift_paths(A.order_changes(spark, sf_dir), docs(spark, sf_dir))


def graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, d = A.corpus(spark, sf_dir), docs(spark, sf_dir)
    content, meta = spool(graph.content_edges(files), "content"), spool(graph.metadata_edges(files, d), "metadata")
    return segments.graph_lines(files, d, content, meta, graph.orphans(files, content), graph.disconnected(d, meta))


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.index_lines(docs(spark, sf_dir))


def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, d = A.corpus(spark, sf_dir), docs(spark, sf_dir)
    content, meta = spool(graph.content_edges(files), "content"), spool(graph.metadata_edges(files, d), "metadata")
    return graph.graph_json(files, d, content, meta, graph.orphans(files, content), graph.disconnected(d, meta))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, d = A.corpus(spark, sf_dir), docs(spark, sf_dir)
    arcs = graph.hierarchy_arcs(files, d)
    edges = graph.broken_edges(files, d).select("repo").unionByName(graph.cycle_paths(arcs).select("repo"))
    loose = graph.disconnected(d, graph.metadata_edges(files, d))
    found = {"orphans": graph.orphans(files, graph.content_edges(files)), "broken": graph.broken_links(files), "untracked": graph.untracked(files), "frontmatter": graph.frontmatter_findings(d), "edges": edges, "disconnected": loose}
    return graph.audit_summary(files, found)


def removed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.removed_symbols(A.part_diff(spark, sf_dir))


def changed_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changed_constants(A.part_diff(spark, sf_dir))


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.dangling_references(A.part_diff(spark, sf_dir), A.corpus(spark, sf_dir))


def value_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.value_drift(A.part_diff(spark, sf_dir), A.corpus(spark, sf_dir))


def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.added_lines(A.part_diff(spark, sf_dir))


def footgun_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.footguns_added(A.part_diff(spark, sf_dir), A.part_heads(spark, sf_dir))


def diff_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every file of whole diff texts: how many, and how many of them are added or removed."""
    mark = F.substring("text", 1, 1)
    lines = diff_lines(A.part_diff_texts(spark, sf_dir))
    return lines.groupBy("repo", "range_id", "path").agg(F.count("*").alias("n_lines"), F.count_if(mark == "+").alias("n_plus"), F.count_if(mark == "-").alias("n_minus"))


def removed_symbols_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed symbols of whole diff texts, prose files left out."""
    return drift.removed_symbols(diff_lines(A.part_diff_texts(spark, sf_dir)))


def footgun_added_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footguns on the added lines of whole diff texts."""
    return drift.footguns_added(diff_lines(A.part_diff_texts(spark, sf_dir)), A.part_heads(spark, sf_dir))


def footguns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.footguns(A.corpus(spark, sf_dir).select("repo", "path", "content"))


def nearest_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.nearest_base(A.event_candidates(spark, sf_dir))


def push_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.push_ranges(A.event_pushes(spark, sf_dir), nearest_base(spark, sf_dir))


def head_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.once_per_head(A.event_runs(spark, sf_dir), ("event_id",)).select("repo", "event_id", "head")


def usage_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per check of a record per source, one row a check."""
    source = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = leaks.leak_findings(source, "text", RULES).select(F.col("source").alias("repo"), F.lit("leaks").alias("check"), F.col("doc_id").cast("string").alias("path"), "line", F.col("match").alias("detail"))
    records = usage.usage_records(source.select(F.col("source").alias("repo")), found, usage.selected_checks("orphans, broken"), 2, F.lit(A.NOW), "1.0")
    return records.select("repo", "exit", F.size("checks").alias("n_checks"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "files", F.explode("counts").alias("check", "n")).select("repo", "exit", "n_checks", "day", "check", "n", F.coalesce(F.size(F.element_at("files", F.col("check"))), F.lit(0)).alias("n_files"))


def usage_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("repo"), F.create_map("event_type", (F.col("event_id") % 3).cast("int")).alias("counts"))
    return usage.usage_trend(e).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


NAMES = (
    "leak_findings leak_findings_pages leak_dir_scoped leak_by_repo leak_rule_table redacted_text content_edges mention_edges in_degree orphans orphans_by_repo orphans_at_ref broken_links broken_edges frontmatter_findings frontmatter_docs untracked "
    "metadata_edges metadata_degree disconnected cycle_members cycle_paths part_of_tree cross_refs doc_index index_markdown stale_docs covers_of covers_drift covers_drift_paths graph_json graph_lines index_lines audit_summary "
    "diff_paths removed_symbols_texts footgun_added_texts removed_symbols changed_constants dangling_refs value_drift added_lines footgun_added footguns nearest_base push_ranges head_guard usage_record usage_trend"
).split()
