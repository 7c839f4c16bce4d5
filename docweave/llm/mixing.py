"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets: every source has a weight and may be repeated at most `epochs` times. Sources whose share
of the total would exceed their cap are clamped to it, and the rest is shared anew by weight, until
no source exceeds its cap. Repetitions: all documents of a source are taken floor(r)
times, r being target / size; for the fraction left, the documents of the source are put in a
seeded order and taken once more from the start until the target is reached; the document on the
border is taken in part. The order is a hash order: its prefix sums come
from sums of hash buckets, so no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a source, over which prefix sums run.
BUCKETS = 1 << 12


def n_words(text: Column) -> Column:
    """Number of words in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """weight 1, 2, 3, repeating, over the sources by code point, null last. One row per source comes in."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))


def water_filling(sources: DataFrame, epochs: float = 3.0) -> DataFrame:
    """Add target to (source, source_size, weight), one row per source: targets share the sum of all sizes by weight, none above epochs * source_size.

    Rounds of the filling end at the same level as one pass over the sources by cap / weight: the level is the
    first at which the sources not yet clamped all stay below their caps. Sources of weight 0 or less get 0. If all caps
    together are below the total (epochs below 1), every source gets its cap.
    """
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("w", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    live = s.where("w > 0").withColumns(
        {"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("w").over(rest), "total": F.sum("source_size").over(W.partitionBy())}
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    fits = live.withColumn("reached", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(W.partitionBy()))
    target = F.when(F.col("reached").isNull(), F.col("cap")).otherwise(F.least(F.col("reached.level") * F.col("w"), F.col("cap")))
    found = fits.select("source", target.alias("target"))
    return s.alias("s").join(found.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left").select("s.source", "source_size", "weight", F.coalesce("f.target", F.lit(0.0)).alias("target"))


def mixture(
    docs: DataFrame, weights=cyclic_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: float = 3.0, seed: str = "mix", keep: tuple[str, ...] = ()
) -> DataFrame:
    """What the mix takes of each document: id, size (words), source_size, target, taken (words, repetitions counted), whole (full repetitions) and part (words of the last, partial one).

    `weights` adds a column weight to the frame of sources. Sources are few against documents: one row each is
    handled in one task. Null sources form one source; null or empty texts have size 0 and are taken 0 words. The
    order of documents is md5(seed, id), ties (repeated or null ids) by size; rows that agree in both take their turns one
    after the other, in no fixed order, by which the words taken change hands among equals only. `keep`: columns that are carried along into the
    result, as k0, k1, ..; a hash of theirs breaks the ties. The words taken from a source sum to its target, rounded down.
    Texts of any length count by all their words. Other columns are not looked at. An empty table gives an empty result.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    carried = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    kept = [f"k{i}" for i in range(len(keep))]
    tie = ["tie"] if keep else []
    # a text of no words has no place in the order: however many there are, they stay out of the windows
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), draw.alias("draw"), *carried)
    sized = sized.withColumn("tie", F.xxhash64(*kept)) if keep else sized
    sized = sized.withColumn("bucket", F.when(F.col("size") > 0, F.conv(F.substring("draw", 1, 3), 16, 10).cast("int")).otherwise(F.pmod(F.xxhash64("draw", *tie), F.lit(BUCKETS)).cast("int") + BUCKETS))
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = water_filling(weights(sources), epochs)
    starts = totals.withColumn("start", F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("bucket_size")
    plan = starts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "bucket", "start", "source_size", "target")
    # no more rows than sources times buckets
    inside = W.partitionBy("source", "bucket").orderBy("draw", "size", *tie)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    j = placed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - F.col("whole") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("before")))
    return (
        j.withColumn("whole", whole).withColumn("rest", rest).withColumn("part", part)
        .select(
            F.col("id").alias(id_col), F.col("d.source").alias(source_col), "size", F.col("source_size").cast("long").alias("source_size"), "target",
            (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), "whole", "part", *kept,
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: what a mix of all `documents` takes, sources weighing 1, 2, 3 in turn, at most 3 epochs each."""
    from docweave.functions.session import spread, table

    return mixture(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
v AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(v.level * w, cap)::DOUBLE AS target FROM l, v),
p AS (SELECT d.*, t.source_size, t.target, (floor(floor(t.target) / nullif(t.source_size, 0)))::BIGINT AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (coalesce(whole, 0) * size + greatest(0, least(size, floor(target)::BIGINT - coalesce(whole, 0) * source_size - before)))::BIGINT AS taken
FROM p
"""
