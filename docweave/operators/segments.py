"""Views of repositories of any size as ordered lines: (repo, order columns, text), never a repository in one row or task.

The lines of a repository, in order and joined by line feeds, are the view that `graph_json` and `index_markdown` hold in one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.session import spool
from docweave.operators.graph import Ignores, graph_parts
from docweave.operators.views import entry_line, index_entries

#: Lines of a written file at most.
FILE_LINES = 1_000_000


def placed(items: DataFrame, within: list[str], by: list[str]) -> DataFrame:
    """`items` with `pos`, the place of a row from 0 among those equal in `within`, in the order of `by`; nulls first, ties in any order.

    Rows are cut into ranges of (within, by), so a large group lies in many tasks. They are counted within a task's range, then over the ranges: only
    a count for each range and group is seen together.
    """
    cut = items.repartitionByRange(*within, *by).sortWithinPartitions(*within, *by)
    rows = spool(cut.withColumns({"block": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), "placed")
    counts = rows.groupBy("block", *within).agg(F.min("nth").alias("start"), F.count("*").alias("n"))
    ahead = F.sum("n").over(W.partitionBy(*within).orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("block").alias("b"), *[F.col(c).alias(f"w{i}") for i, c in enumerate(within)], "start", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"w{i}")) for i, c in enumerate(within)], F.col("block") == F.col("b"))
    return rows.join(starts, same).select(*items.columns, (F.col("nth") - F.col("start") + F.col("ahead")).alias("pos"))


def graph_lines(files: DataFrame, docs: DataFrame, content: DataFrame, metadata: DataFrame, islands: DataFrame, loose: DataFrame, ignores: Ignores = ()) -> DataFrame:
    """(repo, section, pos, text): the graph view of a repository as lines of JSON, one for each element of its lists.

    Even sections hold what stands around the lists, odd ones their elements in order. Every repository has all even sections.
    """
    inner = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    keys = {"nodes": ["item.path"], "contentEdges": ["item.from", "item.to", "item.kind"], "metadataEdges": ["item.from", "item.to", "item.rel", "item.note"]}
    parts = graph_parts(files, docs, content, metadata, islands, loose, ignores)
    frames = []
    for i, (name, part) in enumerate(parts.items()):
        own = [F.col(k) for k in keys.get(name, ["item"])]
        sort = [(own[j] if j < len(own) else F.lit(None)).cast("string").alias(f"k{j}") for j in range(4)]
        frames.append(part.select("repo", F.lit(2 * i + 1).alias("section"), *sort, inner("item").alias("text")))
    listed = placed(reduce(DataFrame.unionByName, frames), ["repo", "section"], ["k0", "k1", "k2", "k3", "text"])
    elements = listed.select("repo", "section", "pos", F.concat(F.when(F.col("pos") > 0, ",").otherwise(""), "text").alias("text"))
    around = F.array(F.concat(F.lit('{"schemaVersion":1,"repoRoot":'), inner("repo"), F.lit(',"nodes":[')), *map(F.lit, ('],"contentEdges":[', '],"metadataEdges":[', '],"islands":{"content":[', '],"metadata":[', "]}}")))
    frame = files.select("repo").distinct().select("repo", F.posexplode(around).alias("i", "text"))
    return elements.unionByName(frame.select("repo", (2 * F.col("i")).alias("section"), F.lit(0).cast("long").alias("pos"), "text"))


def index_lines(docs: DataFrame) -> DataFrame:
    """(repo, rank, type, pos, text): the index of a repository as lines of markdown; a section begins with its heading at 0, before which all but the first have an empty line at -1."""
    e = index_entries(docs)
    entries = placed(e.select("repo", "rank", "type", "path", entry_line().alias("text")), ["repo", "rank", "type"], ["path", "text"])
    sections = e.groupBy("repo", "rank", "type").agg(F.count("*").alias("n"))
    first = sections.groupBy("repo").agg(F.min(F.struct("rank", "type")).alias("first"))
    above = F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("text")), F.struct(F.lit(0).alias("pos"), F.concat(F.lit("## "), "type").alias("text")))
    heads = sections.join(first, "repo").select("repo", "rank", "type", F.explode(F.when(F.struct("rank", "type") == F.col("first"), F.slice(above, 2, 1)).otherwise(above)).alias("h"))
    return entries.select("repo", "rank", "type", (F.col("pos") + 1).alias("pos"), "text").unionByName(heads.select("repo", "rank", "type", F.col("h.pos").cast("long").alias("pos"), "h.text"))


def write_lines(lines: DataFrame, path: str, file_lines: int = FILE_LINES) -> None:
    """Write ordered lines (repo, order columns, text) to the folders repo=<name> below `path`: the files of a folder in the order of their names are its view.

    Tasks write ranges of lines, so one repository is written by many.
    """
    order = [c for c in lines.columns if c != "text"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("repo", "text").write.partitionBy("repo").option("maxRecordsPerFile", file_lines).text(path)
