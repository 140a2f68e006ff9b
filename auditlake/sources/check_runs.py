"""Check-run table: the runs of every audited commit, safe to write again.

Two layers below one folder, both per source:

* ``recent``: one partition for each batch. A batch that is repeated replaces itself and nothing else;
* ``merged``: spans of older batches, written once, partitioned by a hash of the repository, so that the runs of
  a few commits are read from a few buckets.

``merge_check_runs`` turns the recent batches of a source but the newest into a span, and equally long spans into
longer ones, so that the number of files stays small. A span counts once its ``_SUCCESS`` file is there, and from
then on the batches and spans that it covers don't; they are deleted by the next merge. A merge that fails
half-way so changes nothing, and one that is repeated does the same again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake import schemas
from auditlake.session import freed
from auditlake.sources.inventory import bucket

SOURCE, BATCH, TIME = "run_source", "batch_id", "published_at"
KEY, SPAN, BUCKET = "run_key", "run_span", "run_bucket"
BUCKETS = 256
#: So many batches of a source are merged into a span, so many spans of a size into a longer one.
MERGE_BATCHES, MERGE_SPANS = 16, 8
_SPREAD = 8

_ROWS = T.StructType([*schemas.CHECK_RUNS.fields, T.StructField(TIME, T.TimestampType()), T.StructField(SOURCE, T.StringType())])
_RECENT = T.StructType([*_ROWS.fields, T.StructField(KEY, T.StringType()), T.StructField(BATCH, T.LongType())])
_MERGED = T.StructType(
    [*_ROWS.fields, T.StructField(BATCH, T.LongType()), T.StructField(KEY, T.StringType())]
    + [T.StructField(SPAN, T.StringType()), T.StructField(BUCKET, T.IntegerType())]
)
_COLUMNS = [*_ROWS.fieldNames(), BATCH]


def source_key(source: str) -> str:
    """The folder name of a source."""
    return hashlib.sha256(source.encode()).hexdigest()[:16]


class _Files:
    """Names in folders of any file system that Spark can read."""

    def __init__(self, spark: SparkSession):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._configuration = spark.sparkContext._jsc.hadoopConfiguration()

    def _of(self, path: str):
        place = self._path(path)
        return place.getFileSystem(self._configuration), place

    def names(self, path: str) -> list[str]:
        system, place = self._of(path)
        return sorted(status.getPath().getName() for status in system.listStatus(place)) if system.exists(place) else []

    def exists(self, path: str) -> bool:
        system, place = self._of(path)
        return system.exists(place)

    def delete(self, path: str) -> None:
        system, place = self._of(path)
        system.delete(place, True)


@dataclass
class Layout:
    """What the folders of one source hold: batches and spans (first and last batch) that count, and folders that don't any more."""

    batches: list[int] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    covered: list[str] = field(default_factory=list)

    @property
    def merged_up_to(self) -> int | None:
        return max((last for _, last in self.spans), default=None)


def _recent(folder: str, key: str, batch: int) -> str:
    return f"{folder}/recent/{KEY}={key}/{BATCH}={batch}"


def _merged(folder: str, key: str, span: tuple[int, int]) -> str:
    return f"{folder}/merged/{KEY}={key}/{SPAN}={span[0]}-{span[1]}"


def layout(spark: SparkSession, folder: str, key: str) -> Layout:
    files, found = _Files(spark), Layout()
    complete = []
    for name in files.names(f"{folder}/merged/{KEY}={key}"):
        if name.startswith(f"{SPAN}="):
            first, last = map(int, name.removeprefix(f"{SPAN}=").split("-"))
            if files.exists(f"{_merged(folder, key, (first, last))}/_SUCCESS"):
                complete.append((first, last))
    for span in complete:
        wider = any(other != span and other[0] <= span[0] and span[1] <= other[1] for other in complete)
        if wider:
            found.covered.append(_merged(folder, key, span))
        else:
            found.spans.append(span)
    found.spans.sort()
    for name in files.names(f"{folder}/recent/{KEY}={key}"):
        if name.startswith(f"{BATCH}="):
            batch = int(name.removeprefix(f"{BATCH}="))
            if found.merged_up_to is None or batch > found.merged_up_to:
                found.batches.append(batch)
            else:
                found.covered.append(_recent(folder, key, batch))
    found.batches.sort()
    return found


def _keys(spark: SparkSession, folder: str) -> list[str]:
    files = _Files(spark)
    names = {name for layer in ("recent", "merged") for name in files.names(f"{folder}/{layer}")}
    return sorted(name.removeprefix(f"{KEY}=") for name in names if name.startswith(f"{KEY}="))


def write_check_runs(
    check_runs: DataFrame,
    folder: str,
    source: str,
    batch_id: int,
    published_at: Column | None = None,
) -> None:
    """Writes one batch of a source; writing the same batch again replaces it.

    ``source`` names what publishes: a job, or a streaming query. Its batch ids only grow; one that has been merged
    can't be written any more. ``published_at`` orders the runs
    of a commit; the default is the time of the write.  A batch without rows
    leaves the table as it is.
    """
    spark, key = check_runs.sparkSession, source_key(source)
    merged = layout(spark, folder, key).merged_up_to
    if merged is not None and batch_id <= merged:
        raise ValueError(f"batch {batch_id} of {source} has been merged; later ones go on from {merged + 1}")
    when = F.current_timestamp() if published_at is None else published_at
    (
        check_runs.withColumn(TIME, when)
        .withColumn(SOURCE, F.lit(source))
        .withColumn(KEY, F.lit(key))
        .withColumn(BATCH, F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(KEY, BATCH)
        .parquet(f"{folder}/recent")
    )
    freed(spark)


def _read(spark: SparkSession, folder: str, layer: str, schema: T.StructType, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/{layer}").parquet(*paths)


def _layers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Recent batches and merged spans that count."""
    found = {key: layout(spark, folder, key) for key in _keys(spark, folder)}
    recent = [_recent(folder, key, batch) for key, one in found.items() for batch in one.batches]
    merged = [_merged(folder, key, span) for key, one in found.items() for span in one.spans]
    return _read(spark, folder, "recent", _RECENT, recent), _read(spark, folder, "merged", _MERGED, merged)


def read_all_check_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run ever published, with ``run_source``, ``batch_id`` and ``published_at``; none if nothing was written."""
    recent, merged = _layers(spark, folder)
    return recent.select(_COLUMNS).unionByName(merged.select(_COLUMNS))


def read_check_runs_of(spark: SparkSession, folder: str, commits: DataFrame) -> DataFrame:
    """Every run of some commits (``repository, head_sha``).

    Of the spans only the buckets of their repositories are read; the buckets, at most ``BUCKETS`` numbers, come to the
    driver.
    """
    recent, merged = _layers(spark, folder)
    buckets = [row[0] for row in commits.select(bucket("repository", BUCKETS)).distinct().collect()]
    merged = merged.filter(F.col(BUCKET).isin(buckets)) if buckets else merged.limit(0)
    runs = recent.select(_COLUMNS).unionByName(merged.select(_COLUMNS))
    return runs.join(commits.select("repository", "head_sha"), ["repository", "head_sha"], "left_semi")


def read_check_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The latest check run of each (repository, head_sha), by time."""
    rows = read_all_check_runs(spark, folder)
    kept = [name for name in rows.columns if name not in (SOURCE, BATCH, TIME)]
    keys = ["repository", "head_sha"]
    order = F.struct(TIME, SOURCE, BATCH)
    values = F.struct(*[name for name in kept if name not in keys])
    latest = rows.groupBy(*keys).agg(F.max_by(values, order).alias("_run"))
    return latest.select(*keys, "_run.*").select(*kept)


def _merge(rows: DataFrame, folder: str, key: str, span: tuple[int, int]) -> None:
    spread = F.pmod(F.xxhash64("head_sha"), F.lit(_SPREAD))  # a repository with most of the runs is written by many tasks
    (
        rows.select(_COLUMNS)
        .withColumn(BUCKET, bucket("repository", BUCKETS))
        .repartition(F.col(BUCKET), spread)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy(BUCKET)
        .parquet(_merged(folder, key, span))
    )


def _size_class(span: tuple[int, int], batches: int, spans: int) -> int:
    length, found = span[1] - span[0] + 1, 0
    while length >= batches * spans:
        length //= spans
        found += 1
    return found


def merge_check_runs(
    spark: SparkSession,
    folder: str,
    source: str,
    batches: int = MERGE_BATCHES,
    spans: int = MERGE_SPANS,
) -> None:
    """Merges old batches of a source, to be called by what publishes under its name.

    The newest batch stays as it is, for a stream may repeat it. What an earlier merge covered is deleted first: whoever
    read by the layout before that merge has had a whole round to end.
    """
    key = source_key(source)
    files, found = _Files(spark), layout(spark, folder, key)
    for path in found.covered:
        files.delete(path)
    old = found.batches[:-1]
    if len(old) >= batches:
        paths = [_recent(folder, key, batch) for batch in old]
        span = (found.merged_up_to + 1 if found.spans else old[0], old[-1])
        _merge(_read(spark, folder, "recent", _RECENT, paths), folder, key, span)
        found.spans.append(span)
    while found.spans:
        last = _size_class(found.spans[-1], batches, spans)
        alike = 0
        while alike < len(found.spans) and _size_class(found.spans[-1 - alike], batches, spans) == last:
            alike += 1
        if alike < spans:
            return
        parts = found.spans[-alike:]
        span = (parts[0][0], parts[-1][1])
        paths = [_merged(folder, key, part) for part in parts]
        _merge(_read(spark, folder, "merged", _MERGED, paths), folder, key, span)
        found.spans[-alike:] = [span]
