"""Pages as they arrive, sessions of use, and speed statistics kept in state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

PAGES = "book_id string, page_no int, text string"


def cleaned_pages(spark: SparkSession, path: str, output: str, checkpoint: str):
    """A query that cleans pages as their files arrive and appends them to `output`, each file once: resuming continues where
    the checkpoint stands."""
    pages = spark.readStream.schema(PAGES).parquet(path)
    return pages.withColumn("text", T.clean_page(T.text("text"))).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "8 hours", late: str | None = None) -> DataFrame:
    """user_id, start, end, events: stretches of use without a pause of `gap`; the same for a table and for a stream, where
    `late` bounds how late an event may come."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def speed_state(samples: DataFrame) -> DataFrame:
    """key, pages, total_sec after each micro-batch of samples (key, pages, seconds): the running mean that forgets, as state of a
    few bytes for each key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from ..functions.folds import decayed_speed

    def update(key, frames, state: GroupState):
        pages, seconds = state.get if state.exists else (0, 0.0)
        for f in frames:
            pages, seconds = decayed_speed([(pages, seconds), *zip(f["pages"], f["seconds"], strict=True)])
        state.update((int(pages), float(seconds)))
        yield pd.DataFrame({"key": [key[0]], "pages": [pages], "total_sec": [seconds]})

    return samples.groupBy("key").applyInPandasWithState(update, "key string, pages long, total_sec double", "pages long, total_sec double", "update", GroupStateTimeout.NoTimeout)
