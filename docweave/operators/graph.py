"""The two graphs of a repository's documents, and what is loose in them.

files: (repo, path, content, tracked). Every operator works over many repositories at once; joins are on
(repo, path), so one large repository spreads over all tasks.
"""

from __future__ import annotations

from functools import reduce
from posixpath import normpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import markdown as M
from docweave.functions import paths as P
from docweave.functions.session import release, spool

#: Candidates for roots, relations that do not connect documents, relations that must not run in circles.
ROOTS = ("CLAUDE.md", "README.md", "AGENTS.md", "docs/index.md")
NOT_STRUCTURAL = ("covers", "source")
HIERARCHY = ("part-of", "supersedes")


#: What ignores documents: globs for all repositories, or a table (repo, glob) with those of each; the default globs always hold.
Ignores = tuple[str, ...] | DataFrame
#: The file of a repository that holds its own globs.
IGNORE_FILE = ".docignore"


def ignore_globs(files: DataFrame, name: str = IGNORE_FILE) -> DataFrame:
    """(repo, glob): the globs in the ignore file at the root of every repository: trimmed lines, without blank ones and comments."""
    lines = files.where((F.col("path") == name) & F.col("content").isNotNull()).select("repo", F.explode(F.split(F.col("content").cast("string"), "\n", -1)).alias("line"))
    return lines.select("repo", M.trimmed(F.col("line")).alias("glob")).where((F.col("glob") != "") & ~F.col("glob").startswith("#")).distinct()


def without_ignored(files: DataFrame, ignores: Ignores) -> DataFrame:
    """Files that no glob matches. Those of a table are one expression for each repository, made where the globs are."""
    if not isinstance(ignores, DataFrame):
        return files.where(~P.matches_any(F.col("path"), [*P.DEFAULT_IGNORES, *ignores]))

    def regexes(globs: pd.Series) -> pd.Series:
        return globs.map(P.glob_regex)

    regexes.__annotations__ = {"globs": pd.Series, "return": pd.Series}
    each = ignores.select("repo", "glob").distinct().withColumn("regex", F.pandas_udf(regexes, "string")("glob"))
    own = each.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list("regex")), lambda r: F.concat(F.lit("(?:"), r, F.lit(")"))), "|").alias("__ignored"))
    kept = files.where(~P.matches_any(F.col("path"), list(P.DEFAULT_IGNORES)))
    # paths alone meet the globs of their repository; what else the files have is looked at by path
    ignored = kept.select("repo", "path").join(own, "repo").where(F.rlike("path", F.col("__ignored"))).select("repo", "path").distinct()
    return kept.join(ignored, ["repo", "path"], "left_anti").select(*files.columns)


def markdown_nodes(files: DataFrame, ignores: Ignores = ()) -> DataFrame:
    """Tracked markdown files, without ignored ones."""
    return without_ignored(tracked_markdown(files), ignores)


def tracked_markdown(files: DataFrame) -> DataFrame:
    return files.where(F.col("tracked") & P.is_markdown(F.col("path")))


def link_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, src, dst, kind = link): links in bodies of nodes to tracked markdown, ignored files too."""
    found = M.links(nodes.where("content is not null").select("repo", F.col("path").alias("src"), M.body_text(F.col("content")).alias("body")), F.col("body")).where(P.is_local_markdown(F.col("target")))
    ends = found.select("repo", "src", P.link_path(F.col("src"), F.col("target")).alias("dst")).where("src <> dst").distinct()
    return ends.join(tracked_markdown(files).select("repo", F.col("path").alias("dst")).distinct(), ["repo", "dst"], "left_semi").select("repo", "src", "dst", F.lit("link").alias("kind"))


def mention_edges(nodes: DataFrame) -> DataFrame:
    """(repo, src, dst, kind = mention): bodies that name the path of another node."""
    found = nodes.where("content is not null").select("repo", F.col("path").alias("src"), F.explode(M.mentioned_paths(M.body_text(F.col("content")))).alias("dst")).where("src <> dst")
    plain = r"\A[A-Za-z0-9./_-]+\z"
    ends = nodes.select("repo", F.col("path").alias("dst")).distinct()
    exact = found.join(ends.where(F.col("dst").rlike(plain)), ["repo", "dst"], "left_semi")
    # names with other characters: the text before them must not end in a path character. Such a name holds a run of path characters with the
    # character behind it, or else one before it, which the body holds just so: by these they are joined
    odd = spool(ends.where(~F.col("dst").rlike(plain)), "odd")
    if odd.isEmpty():  # no body is looked at for them
        return exact.select("repo", "src", "dst").distinct().withColumn("kind", F.lit("mention"))
    lead, pair = r"[A-Za-z0-9./_-]+[^A-Za-z0-9./_-]", r"[^A-Za-z0-9./_-][A-Za-z0-9./_-]"
    first = F.regexp_extract("dst", lead, 0)
    keyed = odd.withColumn("key", F.when(first != "", first).otherwise(F.regexp_extract("dst", pair, 0)))
    bodies = nodes.where("content is not null").join(odd.select("repo").distinct(), "repo", "left_semi").select("repo", F.col("path").alias("src"), M.body_text(F.col("content")).alias("body"))
    # pairs overlap, so they are read from both parities
    pairs = F.concat(F.regexp_extract_all("body", F.lit(pair), F.lit(0)), F.regexp_extract_all(F.regexp_replace("body", r"\A(?s:.)", ""), F.lit(pair), F.lit(0)))
    tokens = bodies.select("repo", "src", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("body", F.lit(lead), F.lit(0)), pairs))).alias("key"))
    quoted = F.concat(F.lit(r"(?s)(?:\A|[^A-Za-z0-9./_-])\Q"), F.replace("dst", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    # bodies join the few pairs that are left
    asked = tokens.join(keyed, ["repo", "key"]).where("src <> dst").select("repo", "src", "dst").distinct()
    rare = asked.join(bodies, ["repo", "src"]).where(F.contains("body", "dst") & F.rlike("body", quoted))
    return exact.select("repo", "src", "dst").unionByName(rare.select("repo", "src", "dst")).distinct().withColumn("kind", F.lit("mention"))


def content_edges(files: DataFrame, ignores: Ignores = ()) -> DataFrame:
    """Link and mention edges, distinct."""
    nodes = markdown_nodes(files, ignores)
    return link_edges(files, nodes).unionByName(mention_edges(nodes)).distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    """(repo, path, n_in): distinct edges by target; a link and a mention count apart."""
    return edges.distinct().groupBy("repo", F.col("dst").alias("path")).agg(F.count("*").alias("n_in"))


def roots(files: DataFrame, extra: tuple[str, ...] | DataFrame = ()) -> DataFrame:
    """(repo, path) of the root candidates that are tracked. extra: more candidates, for all repositories or as a table (repo, path); their paths are cleaned."""
    found = tracked_markdown(files).select("repo", "path").distinct()
    if isinstance(extra, DataFrame):
        own = extra.select("repo", P.normal_path(F.col("path")).alias("path")).distinct()
        return found.where(F.col("path").isin(*ROOTS)).unionByName(found.join(own, ["repo", "path"], "left_semi")).distinct()
    return found.where(F.col("path").isin(*ROOTS, *map(normpath, extra)))


def orphans(files: DataFrame, edges: DataFrame, ignores: Ignores = (), extra_roots: tuple[str, ...] | DataFrame = ()) -> DataFrame:
    """(repo, path) of nodes that are neither roots nor the target of an edge."""
    nodes = markdown_nodes(files, ignores).select("repo", "path").distinct()
    found = roots(files, extra_roots).unionByName(edges.select("repo", F.col("dst").alias("path"))).distinct()
    return nodes.join(found, ["repo", "path"], "left_anti")


def existing_paths(files: DataFrame) -> DataFrame:
    """(repo, path) of all files, tracked or not, of the folders above them, and `.`."""
    up = files.select("repo", F.explode(F.concat(P.ancestors(F.col("path")), F.array(F.lit(".")))).alias("path"))
    return up.distinct()


def broken_links(files: DataFrame, ignores: Ignores = ()) -> DataFrame:
    """(repo, path, line, target): local markdown links of nodes, frontmatter included, whose target does not exist."""
    nodes = markdown_nodes(files, ignores).where("content is not null")
    found = M.links(nodes.select("repo", "path", "content"), F.col("content")).where(P.is_local_markdown(F.col("target")))
    ends = found.select("repo", "path", "line", P.link_path(F.col("path"), F.col("target")).alias("target"))
    return ends.join(existing_paths(files).withColumnRenamed("path", "target"), ["repo", "target"], "left_anti").select("repo", "path", "line", "target")


def typed_edges(docs: DataFrame) -> DataFrame:
    """(repo, path, pos, rel, to, note, kind) of the frontmatter links of well-formed docs."""
    rows = docs.where("has_frontmatter and error is null").select("repo", "path", F.posexplode("links").alias("pos", "e"))
    return rows.select("repo", "path", "pos", F.coalesce("e.rel", F.lit("")).alias("rel"), F.coalesce("e.to", F.lit("")).alias("to"), F.coalesce("e.note", F.lit("")).alias("note")).withColumn("kind", P.edge_kind(F.col("to")))


def broken_edges(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(repo, path, rel, target): doc and code edges to what is neither file nor folder."""
    ends = typed_edges(docs).where(F.col("kind").isin("doc", "code")).select("repo", "path", "rel", F.regexp_replace(P.edge_path(F.col("to")), r"\A/(?=.)", "").alias("target"))
    return ends.join(existing_paths(files).withColumnRenamed("path", "target"), ["repo", "target"], "left_anti").select("repo", "path", "rel", "target")


def frontmatter_findings(docs: DataFrame) -> DataFrame:
    """(repo, path, problem): at most one of malformed, missing (README.md exempt), no type."""
    readme = F.col("path").rlike(r"(?:\A|/)README\.md\z")
    problem = F.when(F.col("error").isNotNull(), "malformed").when(~F.col("has_frontmatter"), F.when(~readme, "missing")).when(M.trimmed(F.col("type")) == "", "no type")
    return docs.select("repo", "path", problem.alias("problem")).where("problem is not null")


def untracked(files: DataFrame, ignores: Ignores = ()) -> DataFrame:
    """(repo, path) of markdown that is not tracked and not ignored."""
    return without_ignored(files.where(~F.col("tracked") & P.is_markdown(F.col("path"))), ignores).select("repo", "path").distinct()


def is_structural(rel: Column, kind: Column) -> Column:
    """Edges between documents that tie them together."""
    return (kind == "doc") & ~rel.isin(*NOT_STRUCTURAL)


def metadata_edges(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(repo, src, dst, rel, note): structural frontmatter edges to other tracked markdown, distinct."""
    ends = typed_edges(docs).where(is_structural(F.col("rel"), F.col("kind"))).select("repo", F.col("path").alias("src"), P.edge_path(F.col("to")).alias("dst"), "rel", "note").where("src <> dst").distinct()
    return ends.join(tracked_markdown(files).select("repo", F.col("path").alias("dst")).distinct(), ["repo", "dst"], "left_semi").select("repo", "src", "dst", "rel", "note")


def ends_of(edges: DataFrame) -> DataFrame:
    return edges.select("repo", F.explode(F.array("src", "dst")).alias("path"))


def metadata_degree(edges: DataFrame) -> DataFrame:
    """(repo, path, degree): edges in and out."""
    return ends_of(edges).groupBy("repo", "path").agg(F.count("*").alias("degree"))


def disconnected(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, path) of well-formed frontmatter docs that no metadata edge touches."""
    return docs.where("has_frontmatter and error is null").select("repo", "path").join(ends_of(edges).distinct(), ["repo", "path"], "left_anti")


def hierarchy_arcs(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(repo, src, dst, pos): part-of and supersedes arcs to tracked markdown, loops included."""
    ends = typed_edges(docs).where(F.col("rel").isin(*HIERARCHY) & (F.col("kind") == "doc")).select("repo", F.col("path").alias("src"), P.edge_path(F.col("to")).alias("dst"), "pos")
    return ends.join(tracked_markdown(files).select("repo", F.col("path").alias("dst")).distinct(), ["repo", "dst"], "left_semi").select("repo", "src", "dst", "pos")


def spread_least(colors: DataFrame, arcs: DataFrame) -> DataFrame:
    """(repo, path, color): every node takes the least color of the nodes that lead to it, until none changes. arcs: repo, src, dst."""
    steps, held = arcs.select("repo", F.col("src").alias("path"), "dst"), None
    while True:
        led = colors.join(steps, ["repo", "path"]).select("repo", F.col("dst").alias("path"), "color")
        new = colors.select("repo", "path", "color", F.col("color").alias("own")).unionByName(led.withColumn("own", F.lit(None).cast("string"))).groupBy("repo", "path").agg(F.min("color").alias("color"), F.min("own").alias("own"))
        old, held = held, spool(new.select("repo", "path", "color", (F.col("color") != F.col("own")).alias("moved")), "colors")
        release(old)
        colors = held.drop("moved")
        if held.where("moved").isEmpty():
            return colors


def spread_labels(arcs: DataFrame) -> DataFrame:
    """(repo, path, label) of nodes on cycles, the label the least node of all that reach each other. One round for each arc of the longest way.

    The least node that leads to each node is its color, the nodes that lead back to that node within the color lie on cycles with it; what is left is looked at again.
    """
    found, core = [], arcs
    while not core.isEmpty():
        own = core.select("repo", F.explode(F.array("src", "dst")).alias("path")).distinct()
        colors = spread_least(own.withColumn("color", F.col("path")), core)
        named = lambda c: colors.select("repo", F.col("path").alias(c), F.col("color").alias(f"{c}_color"))  # noqa: B023, E731
        inside = spool(core.join(named("src"), ["repo", "src"]).join(named("dst"), ["repo", "dst"]).where("src_color = dst_color").select("repo", "src", "dst", F.col("src_color").alias("color")), "inside")
        # back from the node that gave the color: a node on the way has color '', which is less than any path
        back = inside.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
        marks = spread_least(colors.select("repo", "path", F.when(F.col("path") == F.col("color"), "").otherwise("x").alias("color")), back)
        heads = marks.where("color = ''").select("repo", "path")
        # the node that gave the color counts if something leads back to it
        on = heads.join(inside.select("repo", F.col("src").alias("path")), ["repo", "path"], "left_semi").join(inside.select("repo", F.col("dst").alias("path")), ["repo", "path"], "left_semi")
        found.append(spool(on.join(colors, ["repo", "path"]).select("repo", "path", F.col("color").alias("label")), "on-cycles"))
        left = core.join(heads.withColumnRenamed("path", "src"), ["repo", "src"], "left_anti").join(heads.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_anti")
        core = spool(left, "core")
    return reduce(DataFrame.unionByName, found)


def jumps(steps: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Where chains end, in rounds that grow with the logarithm of their length. steps: (repo, path, to, hit), one row for each node with a single arc.

    Returns the jumps of 1, 2, 4, .. steps that end at nodes of `steps` (repo, path, to), and (repo, path, to, low, hit, open) of every node: the end of its chain, the least node
    and whether a node on it is hit, itself included. open: the chain runs into a circle and has no end; then `to` lies on the circle.
    """
    own = steps.select("repo", F.col("path").alias("to"), F.lit(True).alias("known"))
    now = spool(steps.withColumn("low", F.col("path")).join(own, ["repo", "to"], "left").select("repo", "path", "to", "low", "hit", F.coalesce("known", F.lit(False)).alias("open")), "jumps")
    length, levels = 1, []
    while most := now.where("open").groupBy("repo").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]:
        levels.append(now.where("open").select("repo", "path", "to"))
        further = now.select(F.col("repo").alias("r"), F.col("path").alias("at"), F.col("to").alias("next"), F.col("low").alias("next_low"), F.col("hit").alias("next_hit"), F.col("open").alias("next_open"))
        on = now.where("open").join(further, (F.col("repo") == F.col("r")) & (F.col("to") == F.col("at"))).select("repo", "path", F.col("next").alias("to"), F.least("low", "next_low").alias("low"), (F.col("hit") | F.col("next_hit")).alias("hit"), F.col("next_open").alias("open"))
        now = spool(now.where("not open").unionByName(on), "jumps")
        if length >= most:  # an end is at most `most` steps behind the old jumps, and circles and the ways into them are not longer
            break
        length *= 2
    return levels, now


def contracted(arcs: DataFrame, hits: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame, DataFrame] | None:
    """The arcs without the nodes that have a single arc: (the jumps of these, the ends of their chains, (repo, src, via, dst, hit)), None if no node has.

    Each arc of another node, by way of `via`, leads to where the chain there ends; arcs that lead to no node with arcs are left out, as are those into circles of single arcs. hits: (repo, path) of
    nodes to look for on the chains; `hit` tells whether one is there.
    """
    out = arcs.groupBy("repo", "src").agg(F.count("*").alias("n"), F.min("dst").alias("to"))
    marked = (hits if hits is not None else arcs.where(F.lit(False)).select("repo", F.col("src").alias("path"))).select(F.col("repo").alias("r"), F.col("path").alias("__hit")).distinct()
    steps = out.where("n = 1").select("repo", F.col("src").alias("path"), "to")
    steps = spool(steps.join(marked, (F.col("repo") == F.col("r")) & (F.col("path") == F.col("__hit")), "left").select("repo", "path", "to", F.col("__hit").isNotNull().alias("hit")), "steps")
    if steps.isEmpty():
        return None
    levels, ends = jumps(steps)
    hubs = out.where("n > 1").select("repo", F.col("src").alias("hub"))
    chains = ends.select("repo", F.col("path").alias("dst"), F.col("to").alias("end"), "hit", "open")
    far = arcs.join(hubs.withColumnRenamed("hub", "src"), ["repo", "src"], "left_semi").join(chains, ["repo", "dst"], "left")
    return levels, ends, spool(far.select("repo", "src", F.col("dst").alias("via"), F.coalesce("end", "dst").alias("dst"), F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("open", F.lit(False)).alias("open")), "contracted")


def turned(arcs: DataFrame) -> DataFrame:
    return arcs.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))


def cycle_labels(arcs: DataFrame, stuck: int = 0) -> DataFrame:
    """(repo, path, label) of the nodes on cycles of distinct arcs without loops; nodes that reach each other share a label.

    Chains of nodes with one arc are passed in a round for each doubling of their length; what is left are the nodes with several arcs and the ways between them, taken the same way, forward and backward by
    turns. Only where every node has several arcs in and out are labels spread arc by arc.
    """
    arcs = spool(arcs, "arcs")
    has_arcs = arcs.select("repo", F.col("src").alias("dst")).distinct()
    if arcs.isEmpty():
        return arcs.select("repo", F.col("src").alias("path"), F.col("dst").alias("label"))
    less = contracted(arcs)
    if less is None:
        return cycle_labels(turned(arcs), 1) if not stuck else spread_labels(arcs)
    levels, ends, far = less
    circles = ends.where("open").select("repo", F.col("to").alias("path")).distinct()
    found = [circles.join(ends.select("repo", "path", "low"), ["repo", "path"]).select("repo", "path", F.col("low").alias("label"))]
    far = far.where("not open").join(has_arcs, ["repo", "dst"], "left_semi")
    inner = cycle_labels(turned(far.where("src <> dst").select("repo", "src", "dst").distinct()))
    alone = far.where("src = dst").select("repo", F.col("src").alias("path")).distinct().join(inner, ["repo", "path"], "left_anti")
    hubs = spool(inner.unionByName(alone.withColumn("label", F.col("path"))), "hubs")
    named = lambda c: hubs.select("repo", F.col("path").alias(c), F.col("label").alias(f"{c}_label"))
    inside = far.join(named("src"), ["repo", "src"]).join(named("dst"), ["repo", "dst"]).where("src_label = dst_label and via <> dst")
    marked = spool(inside.select("repo", F.col("via").alias("path"), F.col("src_label").alias("label")).distinct(), "marked")
    for level in levels:  # all places of the chains behind the marked ones, as sums of the jumps
        marked = spool(marked.unionByName(marked.join(level, ["repo", "path"]).select("repo", F.col("to").alias("path"), "label")).distinct(), "marked")
    return reduce(DataFrame.unionByName, [*found, hubs, marked])


def cycle_members(arcs: DataFrame) -> DataFrame:
    """(repo, path) of nodes that reach themselves. Rounds grow with the logarithm of the longest chain; nothing of the size of all reachable pairs is made."""
    distinct = spool(arcs.select("repo", "src", "dst").distinct(), "arcs")
    loops = distinct.where("src = dst").select("repo", F.col("src").alias("path"))
    return loops.unionByName(cycle_labels(distinct.where("src <> dst")).select("repo", "path")).distinct()


def leading(arcs: DataFrame, targets: DataFrame) -> DataFrame:
    """(repo, path) of the nodes from which one of the targets (repo, path) can be reached, these included; in rounds like those of `cycle_labels`."""
    arcs, targets = spool(arcs, "arcs"), spool(targets.distinct(), "targets")
    less = contracted(arcs, targets) if not arcs.isEmpty() else None
    if less is None:
        seen = fresh = targets
        while not fresh.isEmpty():
            into = arcs.join(fresh.withColumnRenamed("path", "dst"), ["repo", "dst"]).select("repo", F.col("src").alias("path")).distinct()
            fresh = spool(into.join(seen, ["repo", "path"], "left_anti"), "leading")
            seen = seen.unionByName(fresh)
        return seen
    _, ends, far = less
    # a hub leads there if one of its chains does, or the hub at the end of one
    own = targets.unionByName(far.where("hit").select("repo", F.col("src").alias("path")))
    hubs = spool(leading(far.where("src <> dst and not open").select("repo", "src", "dst").distinct(), own), "hubs")
    by_end = ends.where("not open").join(hubs.withColumnRenamed("path", "to"), ["repo", "to"], "left_semi").select("repo", "path")
    return hubs.unionByName(ends.where("hit").select("repo", "path")).unionByName(by_end).distinct()


def cycle_paths(arcs: DataFrame) -> DataFrame:
    """(repo, cycle): one path a, b, .., a for each arc back into the path of a depth-first walk.

    Nodes are visited in order of their paths, arcs in declared order. Where a walk enters a cycle depends on what leads to it, so the
    arcs by which a cycle can be reached are walked, for each repository with a cycle in one task; no other arc bears on the result.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        for src, dst in rows.sort_values(["src", "pos", "dst"])[["src", "dst"]].itertuples(index=False):
            out.setdefault(src, []).append(dst)
        done, found = set(), []
        for start in sorted(out):
            if start in done:
                continue
            path, at, todo = [start], {start: 0}, [iter(out[start])]
            while todo:
                nxt = next(todo[-1], None)
                if nxt is None:
                    todo.pop()
                    done.add(path[-1])
                    del at[path.pop()]
                elif nxt in at:
                    found.append([*path[at[nxt] :], nxt])
                elif nxt not in done and nxt in out:
                    at[nxt] = len(path)
                    path.append(nxt)
                    todo.append(iter(out[nxt]))
        return pd.DataFrame({"repo": [rows["repo"].iloc[0]] * len(found), "cycle": [" -> ".join(f) for f in found]})

    # the arcs by which a cycle can be reached; all arcs are read several times, the files they come from once
    arcs = spool(arcs.select("repo", "src", "dst", "pos"), "arcs")
    seen = leading(arcs.select("repo", "src", "dst").distinct(), cycle_members(arcs))
    return arcs.join(seen.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_semi").select("repo", "src", "dst", "pos").groupBy("repo").applyInPandas(walk, "repo string, cycle string")


def part_of_tree(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, root, path, depth, trail): the part-of hierarchy from docs without a parent; children of several parents repeat.

    A document that is already on its own trail is not entered again, which ends the walk. Ways of 1, 2, 4, .. steps are joined to the trails found so far, so the rounds grow with the
    logarithm of the depth.
    """
    part = edges.where("rel = 'part-of' and src <> dst").select("repo", F.col("dst").alias("head"), F.col("src").alias("last")).distinct()
    ways = spool(part.withColumn("steps", F.array("last")), "ways")
    heads = docs.where("has_frontmatter and error is null").select("repo", "path").distinct().join(part.select("repo", F.col("last").alias("path")), ["repo", "path"], "left_anti")
    out, length = spool(heads.select("repo", F.col("path").alias("root"), "path", F.lit(0).alias("depth"), F.array("path").alias("trail")), "trails"), 1
    while True:
        on = out.join(ways.select(F.col("repo").alias("r"), "head", "last", "steps"), (F.col("repo") == F.col("r")) & (F.col("path") == F.col("head"))).where(~F.arrays_overlap("trail", "steps"))
        more = spool(on.select("repo", "root", F.col("last").alias("path"), (F.col("depth") + length).alias("depth"), F.concat("trail", "steps").alias("trail")), "trails")
        if more.isEmpty():
            return out
        out, length = out.unionByName(more), 2 * length
        behind = ways.select(F.col("repo").alias("r"), F.col("head").alias("middle"), F.col("last").alias("end"), F.col("steps").alias("more"))
        twice = ways.join(behind, (F.col("repo") == F.col("r")) & (F.col("last") == F.col("middle"))).where(~F.arrays_overlap("steps", "more") & (F.col("head") != F.col("end")) & ~F.array_contains("more", F.col("head")))
        ways = spool(twice.select("repo", "head", F.col("end").alias("last"), F.concat("steps", "more").alias("steps")), "ways")


def cross_references(edges: DataFrame) -> DataFrame:
    """Metadata edges other than part-of."""
    return edges.where("rel <> 'part-of'")


def graph_parts(files: DataFrame, docs: DataFrame, content: DataFrame, metadata: DataFrame, islands: DataFrame, loose: DataFrame, ignores: Ignores = ()) -> dict[str, DataFrame]:
    """The lists of a graph view by name, each as (repo, item). Blank fields of nodes and notes are null."""
    field = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    fine = docs.where("has_frontmatter and error is null").select("repo", "path", "type", "title", "description", "heading", F.lit(True).alias("parsed"))
    nodes = markdown_nodes(files, ignores).select("repo", "path").distinct().join(fine, ["repo", "path"], "left")
    ends = [F.col("src").alias("from"), F.col("dst").alias("to")]
    return {
        "nodes": nodes.select("repo", F.struct("path", F.coalesce("parsed", F.lit(False)).alias("hasFrontmatter"), field("type"), field("title"), field("description"), field("heading")).alias("item")),
        "contentEdges": content.select("repo", F.struct(*ends, "kind").alias("item")),
        "metadataEdges": metadata.select("repo", F.struct(*ends, "rel", field("note")).alias("item")),
        "c": islands.select("repo", F.col("path").alias("item")),
        "m": loose.select("repo", F.col("path").alias("item")),
    }


def graph_json(files: DataFrame, docs: DataFrame, content: DataFrame, metadata: DataFrame, islands: DataFrame, loose: DataFrame, ignores: Ignores = ()) -> DataFrame:
    """(repo, json): one graph view per repository. Lists are empty, never null; blank fields of nodes and notes are left out.

    A repository is one value; `segments.graph_lines` gives the same view in lines, for repositories too large for that.
    """
    parts = graph_parts(files, docs, content, metadata, islands, loose, ignores)
    out = files.select("repo").distinct()
    for name, p in parts.items():
        out = out.join(p.groupBy("repo").agg(F.array_sort(F.collect_list("item")).alias(name)), "repo", "left")
    filled = {k: F.coalesce(k, F.array().cast(f"array<{p.schema['item'].dataType.simpleString()}>")) for k, p in parts.items()}
    view = F.struct(F.lit(1).alias("schemaVersion"), F.col("repo").alias("repoRoot"), *[filled[k].alias(k) for k in ("nodes", "contentEdges", "metadataEdges")], F.struct(filled["c"].alias("content"), filled["m"].alias("metadata")).alias("islands"))
    return out.select("repo", F.to_json(view).alias("json"))


def audit_summary(files: DataFrame, findings: dict[str, DataFrame], ignores: Ignores = ()) -> DataFrame:
    """(repo, tracked_md, nodes, reachable, and a count for each named findings frame with column repo)."""
    nodes = markdown_nodes(files, ignores).groupBy("repo").agg(F.count("*").alias("nodes"))
    out = tracked_markdown(files).groupBy("repo").agg(F.count("*").alias("tracked_md")).join(nodes, "repo", "left").na.fill(0, ["nodes"])
    for name, f in findings.items():
        out = out.join(f.groupBy("repo").agg(F.count("*").alias(name)), "repo", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out.withColumn("reachable", F.col("nodes") - F.col("orphans")) if "orphans" in findings else out


def latest_per_repo(runs: DataFrame) -> DataFrame:
    """The last run of each repository by time, of those at the same time the one with the greatest head."""
    return runs.withColumn("__n", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("ts"), F.desc("head")))).where("__n = 1").drop("__n")
