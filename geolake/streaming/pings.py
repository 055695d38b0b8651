"""Streams of position reports and of live status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.clock import date_key
from ..operators.windows import RUN_COLS, _keep_sorted
from ..session import ROCKSDB, scratch_path
from ..sources.sinks import _try_read

PING_SCHEMA = "entity_id long, ping_id long, t long, lon double, lat double"


class KeepPlausible(StatefulProcessor):
    """Reports wait until the watermark has passed them, then they meet the last kept
    report of their entity in time order: the order of arrival does not matter."""

    def __init__(self, limit: float, metric: str):
        self.limit, self.metric = limit, metric

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "lon double, lat double, t double")
        self.waiting = handle.getListState("waiting", "ping_id long, t long, lon double, lat double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList([(int(p), int(t), float(x), float(y)) for p, t, x, y in pdf[["ping_id", "t", "lon", "lat"]].itertuples(index=False)])
                self.handle.registerTimer(int(pdf["t"].min()) * 1000)
        yield pd.DataFrame({c: [] for c in ("entity_id", "ping_id", "t", "lon", "lat")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if r[1] * 1000 <= now), key=lambda r: (r[1], r[0]))
        rest = [r for r in held if r[1] * 1000 > now]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[1] for r in rest) * 1000)
        else:
            self.waiting.clear()
        pdf = pd.DataFrame(due, columns=["ping_id", "t", "lon", "lat"])
        if len(pdf):
            pos = pdf[RUN_COLS].to_numpy(dtype="float64")
            keep = _keep_sorted(self.metric, self.limit, pos, tuple(self.last.get()) if self.last.exists() else None)
            if keep.any():
                x = pos[np.flatnonzero(keep)[-1]]
                self.last.update((float(x[0]), float(x[1]), float(x[2])))
            pdf = pdf.loc[keep]
        yield pdf.assign(entity_id=key[0])[["entity_id", "ping_id", "t", "lon", "lat"]]

    def close(self) -> None:
        pass


def clean_stream(pings: DataFrame, limit: float = 40.0, metric: str = "haversine", delay: str = "1 hour") -> DataFrame:
    """Continuous form of the speed filter. ``pings`` has ts (timestamp) and the
    columns of PING_SCHEMA. A report is decided once the watermark, ``delay`` behind
    the latest one, has passed it; up to that it may arrive in any order. State per
    entity: the last kept report and the undecided ones of one delay. Needs the
    RocksDB state store, which is the session's choice."""
    conf = pings.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKSDB:
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return pings.withWatermark("ts", delay).groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=KeepPlausible(limit, metric), outputStructType=PING_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def latest_status(stream: DataFrame, key: str, value: str, order) -> DataFrame:
    """Latest value per key; run in update mode."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias("at"))


def day_trails(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Trail per entity and UTC+8 day: its points in time order, their number and
    the first and last time. ``stream`` has ts (timestamp), entity_id, ping_id, t, lon,
    lat. In append mode a day appears once, when the watermark has passed its end,
    and is never revised. A trail holds one entity's points of one day."""
    point = F.struct("t", "ping_id", "lon", "lat")
    w = F.window("ts", "1 day", "1 day", "16 hours")
    g = stream.withWatermark("ts", delay).groupBy("entity_id", w).agg(
        F.sort_array(F.collect_list(point)).alias("trail")
    )
    return g.select(
        "entity_id",
        date_key(F.unix_seconds("window.start")).alias("date_key"),
        F.size("trail").cast("long").alias("points"),
        F.element_at("trail", 1)["t"].alias("t_first"),
        F.element_at("trail", -1)["t"].alias("t_last"),
        "trail",
    )


def commit_days(path: str, day: str = "date_key") -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that stores closed days below ``path``, each once.

    A batch's rows go to partitions of their day and the batch's number, then the
    number is noted. A batch that is noted is passed over; one that was lost half-way
    replaces its own partitions only. So neither a repeated batch nor a query that
    starts again from the first one stores a row twice or touches a stored day."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        noted = _try_read(spark, f"{path}/commits")
        if noted is not None and not noted.where(F.col("batch") == number).isEmpty():
            # the stream's own state wants the batch to be read to its end
            batch.write.format("noop").mode("overwrite").save()
            return
        # pieces follow the size of a day
        w = batch.withColumn("batch", F.lit(number).cast("long")).hint("rebalance", day).write.mode("overwrite")
        w.option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch").parquet(f"{path}/days")
        spark.range(1).select(F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(f"{path}/commits")

    return put


def stored_days(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all noted batches; ``schema`` is that of the stored rows."""
    noted = spark.read.parquet(f"{path}/commits").distinct()
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/days").join(noted, "batch", "left_semi").drop("batch")


def bake_stream(closed: DataFrame, path: str, checkpoint: str, day: str = "date_key") -> None:
    """Run a stream of closed days (:func:`day_trails`) into stored days over what is
    available now. A run with the same ``checkpoint`` goes on where the last one ended."""
    q = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit_days(path, day)).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now and return its rows. State and
    output live in the shared folder. In update mode every batch is written to
    its own folder, so a repeated batch replaces itself."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    out = f"{base}/out"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:

        def put(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        q = w.foreachBatch(put).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(out)
