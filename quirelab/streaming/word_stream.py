"""Word counts kept up to date over a stream of lines; S7 and S6 can be read off at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelab.functions.grammar import line_words


def _once(lines: DataFrame, late: str) -> DataFrame:
    """Each line of a stream once, as long as it is delivered again within ``late`` of event time."""
    timed = lines.where("line_id is not null").withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).withWatermark("recorded_at", late)
    return timed.dropDuplicatesWithinWatermark(["line_id"])


def stream_counts(lines: DataFrame, late: str = "30 days") -> DataFrame:
    """``word, c`` of a stream of line_records; a line delivered again within ``late`` of event time counts once.

    Use with output mode complete or update; the counts are the state, partitioned by word.
    """
    return _once(lines, late).select(F.explode(line_words()).alias("word")).groupBy("word").agg(F.count("*").alias("c"))


def windowed_counts(lines: DataFrame, width: str = "30 days", late: str = "30 days") -> DataFrame:
    """``window, word, c`` in tumbling windows of recording time, final once the watermark has passed; repeated deliveries count as above."""
    words = _once(lines, late).select("recorded_at", F.explode(line_words()).alias("word"))
    return words.groupBy(F.window("recorded_at", width), "word").agg(F.count("*").alias("c"))
