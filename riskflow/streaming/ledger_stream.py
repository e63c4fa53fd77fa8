"""A ledger that arrives as a stream: micro-batches are upserted into the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskflow.operators import kb


def upsert_stream(stream: DataFrame, store: kb.Store, checkpoint: str, sequence: str | None = None) -> StreamingQuery:
    """Each micro-batch of scored transactions replaces or adds its rows; a batch that is repeated after a failure
    changes nothing more.  Of rows with the same id in a batch the last one by ``sequence`` counts, without one that with the highest day, then
    hash, so a repeated batch chooses alike."""

    def batch(df: DataFrame, _: int) -> None:
        last = F.col(sequence) if sequence else F.struct(F.col("date").cast("string"), F.xxhash64(*df.columns))
        store.write(kb.project(df.withColumn("_seq", last)))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_totals(stream: DataFrame, ts: str = "ts", party: str = "user_id", value: str = "value", late: str = "1 day") -> DataFrame:
    """Totals of each party and day of an event stream, final once the watermark has passed the day."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), party).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(party, F.to_date("window.start").alias("date"), "total", "n")
