"""Pages as they come: answers once, results kept by page, spending capped."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

C = F.col


def stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files of a folder, as they are added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(calls: DataFrame, keys: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """calls without repetitions of keys (such as model, image hash and text hash) within `late`, which bounds the state."""
    return calls.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def spent_by(calls: DataFrame, window: str = "1 hour", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """(start, book, calls, usd): what each book's calls cost by window, emitted when no later row can change it."""
    g = calls.withWatermark(at, late).groupBy(F.window(at, window), "book").agg(F.count(F.lit(1)).alias("calls"), F.sum("usd").alias("usd"))
    return g.select(C("window.start").alias("start"), "book", "calls", "usd")


def capped(calls: DataFrame, cap: float, key: str = "book", order: str = "seq") -> DataFrame:
    """calls until a key's summed usd reaches cap: a call is let through while what was spent before it is below. The state is one sum a key."""
    schema = calls.schema

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        before = spent + rows["usd"].cumsum() - rows["usd"]
        kept = rows[before < cap]
        # What was not let through was not spent; nothing after the first refusal is let through either.
        state.update((float(spent + kept["usd"].sum()),))
        yield kept

    return calls.groupBy(key).applyInPandasWithState(step, schema, "spent double", "append", GroupStateTimeout.NoTimeout)


def keep_pages(pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write each batch of pages under its number, so that a batch that runs again replaces itself, all that is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_pages(spark: SparkSession, folder: str, keys: tuple[str, ...] = ("book", "pno")) -> DataFrame:
    """The latest kept row of each page: a good one rather than a failed one, then the last batch's."""
    d = spark.read.parquet(folder)
    cols = [c for c in d.columns if c not in (*keys, "batch")]
    rank = F.struct(C("error").isNull() if "error" in cols else F.lit(True), "batch")
    g = d.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("v"))
    return g.select(*keys, *[C(f"v.{c}").alias(c) for c in cols])
