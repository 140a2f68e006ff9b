"""Continuous audits: webhook deliveries in, check runs out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake import catalog
from auditlake.operators.events import ACCEPTED, event_status
from auditlake.operators.publishing import check_runs, previous_scores
from auditlake.plans.audit import audit
from auditlake.sources.check_runs import (
    BATCH,
    MERGE_BATCHES,
    SOURCE,
    TIME,
    merge_check_runs,
    read_check_runs_of,
    write_check_runs,
)
from auditlake.sources.inventory import restrict_to


def audit_batch(
    deliveries: DataFrame,
    files: DataFrame,
    policies: DataFrame | None = None,
    dialect: str = "py",
    title: str = catalog.REPORT_TITLE,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Check runs of the commits that accepted deliveries point to.

    The files table is first cut down to these commits (with partition pruning
    if it is laid out by ``write_inventory``); a commit without files still
    gets its check run.
    """
    targets = (
        deliveries.filter(F.col("status") == ACCEPTED)
        .select("repository", F.col("head_sha").alias("sha"))
        .distinct()
    )
    wanted = restrict_to(files, targets)
    report = audit(wanted, targets, policies, dialect)
    return check_runs(report, dialect, title, wanted, previous)


def stream_audit(
    raw_events: DataFrame,
    files: DataFrame,
    folder: str,
    checkpoint: str,
    secret: str,
    policies: DataFrame | None = None,
    dialect: str = "py",
    title: str = catalog.REPORT_TITLE,
    commits: DataFrame | None = None,
    available_now: bool = False,
    source: str | None = None,
    merge_batches: int = MERGE_BATCHES,
) -> StreamingQuery:
    """Starts a query that audits every accepted delivery of a stream.

    Routing is stateless; each micro-batch then runs the batch audit and writes
    its own partition of the check-run table, under the name ``source`` (the checkpoint's, if none is given), so a
    batch that is repeated after a failure replaces itself and a query with a new
    checkpoint replaces nothing.  With ``commits`` (and their parents) the js
    dialect compares each score with the parents' check runs of other batches;
    of what was published before, only the buckets of their repositories are read.
    Every ``merge_batches`` batches the older ones are merged.
    """
    statuses = event_status(raw_events, secret, dialect)
    source = source or checkpoint

    def earlier(batch: DataFrame, batch_id: int) -> DataFrame | None:
        if dialect != "js" or commits is None:
            return None
        targets = batch.select("repository", F.col("head_sha").alias("sha"))
        audited = restrict_to(commits, targets)
        first = F.expr("try_element_at(parents, 1).sha").alias("head_sha")
        parents = audited.select("repository", first).distinct()
        own = (F.col(SOURCE) == source) & (F.col(BATCH) >= batch_id)
        runs = read_check_runs_of(batch.sparkSession, folder, parents).filter(~own)
        order = F.struct(TIME, SOURCE, BATCH).alias("run_seq")
        runs = runs.select("repository", "head_sha", "name", "output.title", order)
        return previous_scores(audited, runs, title)

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            previous = earlier(batch, batch_id)
            rows = audit_batch(batch, files, policies, dialect, title, previous)
            write_check_runs(rows, folder, source, batch_id)
        finally:
            batch.unpersist()
        if batch_id % merge_batches == 0:
            merge_check_runs(batch.sparkSession, folder, source, merge_batches)

    writer = statuses.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

