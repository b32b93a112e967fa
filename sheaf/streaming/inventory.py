"""Paragraph bags of a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.scalars import delete_space


def streamed_paragraphs(documents: DataFrame, late: str = "1 day") -> DataFrame:
    """day, norm, n: how often each paragraph arrived on each day; documents later than the watermark are dropped.

    documents is a stream with text and captured_at. The state holds the days within the watermark only.
    """
    lines = documents.withWatermark("captured_at", late).select("captured_at", F.explode(F.split("text", "\n")).alias("line"))
    norm = lines.select("captured_at", delete_space(F.col("line")).alias("norm")).where(F.length("norm") > 1)
    return norm.groupBy(F.window("captured_at", "1 day").alias("w"), "norm").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "norm", "n")
