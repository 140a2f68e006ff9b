"""Small helpers of the operators: cut lineage, dealt rows, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='llm-')}"
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """The rows of ``frame``, kept in the shared folder, so that lost executors cost no earlier step."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """The rows of ``frame``, written to the shared folder as Parquet: smaller than what ``cut`` keeps, for many or wide rows."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b bigint): one row per node with the least node it reaches.

    Alternates the large-star and small-star steps. Each step is a minimum per node and a join back, so a node
    with many links costs a split join, never one task's memory. Ends when a round changes nothing.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    )
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("b"))
        small = large.join(least.withColumnRenamed("b", "m"), "a")
        small = small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
