"""File inventory layout that lets a small audit read a small part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.lookup import sifted

BUCKET = "repo_bucket"
BUCKETS = 1024


def bucket(repository: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(repository), F.lit(buckets)).cast("int")


def write_inventory(
    rows: DataFrame, folder: str, buckets: int = BUCKETS, spread: int = 8
) -> None:
    """Writes files (or commits) partitioned by a hash of the repository.

    Position and path take part in the shuffle, so a commit that holds a large
    share of all rows is still written by many tasks.
    """
    own = [name for name in ("sha", "seq", "path") if name in rows.columns]
    part = F.pmod(F.xxhash64(*own), F.lit(spread))
    (
        rows.withColumn(BUCKET, bucket("repository", buckets))
        .repartition(F.col(BUCKET), part)
        .write.mode("overwrite")
        .partitionBy(BUCKET)
        .parquet(folder)
    )


def read_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def restrict_to(rows: DataFrame, targets: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the target commits (``repository, sha``).

    If the table has the bucket column it joins the key, and Spark prunes the
    partitions without targets when the query runs. Other rows are sifted where they are read, so that few but those of the
    target commits are shuffled.
    """
    keys = ["repository", "sha"]
    wanted = targets.select(*keys).distinct()
    if BUCKET in rows.columns:
        wanted = wanted.withColumn(BUCKET, bucket("repository", buckets))
        keys = [BUCKET, *keys]
    else:
        rows = sifted(rows, wanted, keys)
    return rows.join(wanted, keys, "left_semi")
