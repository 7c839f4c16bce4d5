"""Decoding of frontmatter blocks: the one place where YAML needs Python, in Arrow batches over the block text only."""

from __future__ import annotations

import json
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import markdown as M

FIELDS = ("type", "title", "description", "verified", "review")
DECODED = "error string, type string, title string, description string, tags array<string>, verified string, review string, links array<struct<rel:string,to:string,note:string>>, extra map<string,string>"


def scalar(value) -> str | None:
    return value if isinstance(value, str) else None


@cache
def loader():
    """The YAML loader: scalars stay strings; repeated keys are an error. Made once in each process, in C where it can be."""
    import yaml

    class Loader(getattr(yaml, "CBaseLoader", yaml.BaseLoader)):
        pass

    def mapping(own, node, deep=False):
        keys = [own.construct_object(k, deep=True) for k, _ in node.value]
        if len({str(k) for k in keys}) < len(keys):
            raise yaml.YAMLError("repeated key")
        return {k: own.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return Loader


def decode(text: str | None) -> tuple:
    """One row of DECODED. Malformed: bad YAML, a top level that is no mapping, fields of a wrong shape, repeated keys."""
    import yaml

    bad = ("malformed", None, None, None, None, None, None, None, None)
    if text is None:
        return (None, *bad[1:])
    try:
        d = yaml.load(text, Loader=loader())
    except (yaml.YAMLError, TypeError, ValueError, RecursionError):
        return bad
    if d in (None, ""):
        d = {}
    if not isinstance(d, dict):
        return bad
    if any(not isinstance(d.get(k, ""), str) for k in FIELDS):
        return bad
    tags, links = d.get("tags") or [], d.get("links") or []
    if not isinstance(tags, list) or not all(isinstance(x, str) for x in tags):
        return bad
    if not isinstance(links, list) or not all(isinstance(x, dict) and all(isinstance(x.get(k, ""), str) for k in ("rel", "to", "note")) for x in links):
        return bad
    extra = {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in d.items() if k not in (*FIELDS, "tags", "links")}
    edges = [{k: x.get(k, "") for k in ("rel", "to", "note")} for x in links]
    return (None, d.get("type", ""), d.get("title", ""), d.get("description", ""), tags, d.get("verified", ""), d.get("review", ""), edges, extra)


def decoded(blocks: Column) -> Column:
    """The DECODED struct of a column of frontmatter texts."""

    def run(batch: pd.Series) -> pd.DataFrame:
        names = ["error", "type", "title", "description", "tags", "verified", "review", "links", "extra"]
        return pd.DataFrame([decode(b) for b in batch], columns=names)

    run.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, DECODED)(blocks)


def docs_of(files: DataFrame) -> DataFrame:
    """The docs table of markdown `files` (repo, path, content): decoded frontmatter, heading and body.

    Files without content are left out. error is `malformed` for a block that is no YAML of the expected shape; fields are
    null without a block. An empty block has empty fields.
    """
    content = F.col("content")
    rows = files.where(content.isNotNull()).select("repo", "path", "content", M.block_head(content).alias("__head"))
    has = F.col("__head") != ""
    rows = rows.select("repo", "path", "content", has.alias("has_frontmatter"), F.when(has, M.head_text(F.col("__head"))).alias("__fm"), M.behind(content, F.col("__head")).alias("body"))
    return rows.withColumn("__d", decoded(F.col("__fm"))).select("repo", "path", "has_frontmatter", "__d.*", F.when(F.col("has_frontmatter"), M.first_heading(F.col("body"))).alias("heading"), "body", "content")
