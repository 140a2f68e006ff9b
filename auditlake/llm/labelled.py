"""What the classifiers share: bounded samples of labelled documents, scores, filters by score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm import words
from auditlake.llm.shared import remainder

SAMPLE_ROWS = 12_000


def held_out(divisor: int, left: int) -> Column:
    """True for documents whose labels no classifier may see; false for a NULL id, which has no labels."""
    return F.coalesce(remainder("doc_id", divisor) == left, F.lit(False))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, divisor: int, left: int, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled documents that are not held out.

    The sample is the least by a hash of the id, so it is the same whatever the partitions, and ``rows`` bounds
    what one task sees. Rows with a NULL id or label are left out; of labels that contradict each other the greater
    counts.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(divisor, left))
    usable = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # at most ``rows`` rows of two numbers
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def with_scores(documents: DataFrame, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """doc_id and score for each row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {"doc_id": batch.column(0), "score": pa.array(score(words.text_column(batch)), pa.float64())}
            yield pa.RecordBatch.from_pydict(columns)

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id bigint, score double")


def filtered(documents: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``documents`` whose text ``keep`` tells to keep; all columns stay, whatever their names."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            yield batch.filter(pa.array(keep(pc.fill_null(column, "") if column.null_count else column), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
