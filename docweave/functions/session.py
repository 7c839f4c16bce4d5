"""Session helpers: reading the given tables, the shared folder, and tables written to it on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, read by Spark from any store that Spark can reach."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most: int = 32) -> DataFrame:
    """`df`, dealt out where its source gives fewer partitions than the session has cores, as a single small file does."""
    n = min(df.sparkSession.sparkContext.defaultParallelism, most)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (all tasks in one process) takes a temporary folder; on a cluster that is an error, as
    no folder of one machine can be read by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/docweave/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spooled_at = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete what `spool` wrote for these frames, once everything made from them has been written itself.

    Frames that were not spooled, and None, are passed over.
    """
    for f in frames:
        path = getattr(f, "spooled_at", None) if f is not None else None
        if path:
            spark = f.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(name: str, *taken: list[str]) -> str:
    """`name`, with underscores behind it until no column is called so, whatever the case."""
    have = {c.lower() for names in taken for c in names}
    while name.lower() in have:
        name += "_"
    return name
