"""The corpus pipeline over documents: language identification, near-duplicate removal, benchmark
decontamination, replacement of personal data, mixing of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one.

What holds for every stage: rows count by themselves. A row's number within the stage, not its doc_id, says which row an operator
speaks of, so rows with a null or repeated id are judged by their own text. Extra columns are kept, whatever they are called. Texts of any
length are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.session import release, spool, table, unused
from docweave.llm.decontaminate import contaminated
from docweave.llm.language_id import identify, is_held_out
from docweave.llm.mixing import mixture
from docweave.llm.near_dup import near_duplicates
from docweave.llm.pii import replace_entities

#: A document stays if its language is recognised with at least this mean probability.
LEAST_SCORE = 0.5


def aside(docs: DataFrame) -> DataFrame:
    """The columns of `docs` under the names c0, c1, .., beside which an operator's own columns are safe."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """The name of a column of `docs` in `aside(docs)`."""
    return f"c{docs.columns.index(name)}"


def numbered(docs: DataFrame) -> DataFrame:
    """`aside(docs)` and a number for every row, written so that the numbers hold."""
    return spool(aside(docs).withColumn("row", F.monotonically_increasing_id()), "rows")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null or empty text, no letter, or a mean probability below LEAST_SCORE.

    Repeated rows stay or go together. If nothing can be learned (no labelled text), all documents go.
    """
    rows, own = aside(docs), {"id_col": place(docs, "doc_id"), "text_col": place(docs, "text"), "lang_col": place(docs, "lang")}
    seen = identify(rows, rows.where(~is_held_out(own["id_col"])), **own)
    kept = seen.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*rows.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates (five-word shingles, similarity 0.8) one row stays: that of the smallest id, null last.

    Rows that agree in text, and so repeated rows, are near duplicates, whatever their ids; of those with the smallest id
    one stays. Null texts and texts without a word stay, each by itself.
    """
    rows = numbered(docs)
    found = near_duplicates(rows.select("row", F.col(place(docs, "text")).alias("text")), id_col="row")
    shared = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    ids = F.col(place(docs, "doc_id"))
    members = found.join(shared, "component_id").select("row", "component_id").join(rows.select("row", ids.isNull().alias("none"), ids.alias("id")), "row")
    first = members.groupBy("component_id").agg(F.min(F.struct("none", "id", "row")).alias("first")).select("component_id", F.col("first.row").alias("first"))
    gone = members.join(first, "component_id").where("row <> first").select("row")
    return rows.join(gone, "row", "left_anti").drop("row").toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay. Repeated rows stay or go together."""
    rows = aside(docs)
    text = F.col(place(docs, "text"))
    # equal texts are judged alike, so a text's digest names it
    named = lambda c: F.md5(c.cast("binary"))
    hit = contaminated(rows.select(named(text).alias("digest"), text.alias("text")), table(spark, sf_dir, "benchmark"), id_col="digest").select("digest").distinct()
    return rows.join(hit, named(text) == F.col("digest"), "left_anti").toDF(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced in every row; n_chars follows the new text. No row goes."""
    out = replace_entities(aside(docs), id_col=place(docs, "doc_id"), text_col=place(docs, "text"))
    if "n_chars" in docs.columns:
        n = place(docs, "n_chars")
        out = out.withColumn(n, F.when(F.col("n_entities") > 0, F.length(place(docs, "text")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.drop("n_entities").toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row per repetition (`copy`, from 1), the last one of a source's
    border document cut to the words taken. `words` is the number of words of the row; documents taken 0 times go, and
    so do null texts and texts without a word.

    Every row is taken by itself, rows with the same id, too. Where `docs` has columns `copy` or `words` already, the new ones have
    underscores behind their names.
    """
    rows = aside(docs)
    text = F.col(place(docs, "text"))
    taken = mixture(rows, id_col=place(docs, "doc_id"), text_col=place(docs, "text"), source_col=place(docs, "source"), keep=tuple(rows.columns)).where("taken > 0")
    copies = F.transform(F.sequence(F.lit(1), (F.col("whole") + (F.col("part") > 0).cast("int")).cast("int")), lambda i: F.struct(i.alias("copy"), F.when(i <= F.col("whole"), F.col("size")).otherwise(F.col("part")).alias("words")))
    out = taken.withColumn("copies", F.explode(copies)).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(rows.columns)], "size", "copies.*")
    # words with the space behind them; space before the first word is a piece of its own
    pieces = F.regexp_extract_all(text, F.lit(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    head = F.array_join(F.slice(pieces, F.lit(1), (F.col("words") + lead).cast("int")), "")
    cut = F.col("words") < F.col("size")
    out = out.withColumn(place(docs, "text"), F.when(cut, head).otherwise(text))
    if "n_chars" in docs.columns:
        n = place(docs, "n_chars")
        out = out.withColumn(n, F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.drop("size").toDF(*docs.columns, unused("copy", docs.columns), unused("words", docs.columns))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("mixing", mixing_stage),
]
#: A trained network, surrogates and templates have no SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, spool(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return docs
