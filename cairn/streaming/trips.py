"""Keyed streams: stateful truncation of trips, live segment states, deduplicated buses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from cairn.operators.sequential import metres

TRUNCATE_M, IDLE_MS = 200.0, 300_000
_POINT = StructType([StructField("cum", DoubleType()), StructField("id", LongType()), StructField("t", LongType()), StructField("lon", DoubleType()), StructField("lat", DoubleType())])
_STATE = StructType([StructField("cum", DoubleType()), StructField("lon", DoubleType()), StructField("lat", DoubleType()), StructField("t", LongType()), StructField("pending", ArrayType(_POINT))])
_OUT = StructType([StructField("trip", StringType()), StructField("id", LongType()), StructField("t", LongType()), StructField("outcome", StringType())])


def truncate_stream(fixes: DataFrame, metres_cut: float = TRUNCATE_M, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """(trip, id, t, outcome) of a stream of fixes (trip, id, t, lon, lat): committed, head_truncated, out_of_order or tail_truncated.

    A fix is committed once the trip has gone metres_cut beyond it; what is pending when a trip goes idle is
    its tail and is never committed. Fixes older than the trip's frontier are refused. The state of a trip
    is its frontier and the fixes of its last metres_cut.
    """
    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            pending = state.get[4]
            state.remove()
            yield pd.DataFrame([(key[0], p[1], p[2], "tail_truncated") for p in pending], columns=_OUT.names)
            return
        cum, lon, lat, last, pending = state.get if state.exists else (0.0, None, None, None, [])
        pending = [tuple(p) for p in pending]
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        out = []
        for r in rows.itertuples(index=False):
            if last is not None and r.t < last:
                out.append((key[0], r.id, r.t, "out_of_order"))
                continue
            cum += metres(lon, lat, r.lon, r.lat) if lon is not None else 0.0
            lon, lat, last = float(r.lon), float(r.lat), int(r.t)
            if cum < metres_cut:
                out.append((key[0], r.id, r.t, "head_truncated"))
            else:
                pending.append((cum, int(r.id), int(r.t), lon, lat))
        out += [(key[0], p[1], p[2], "committed") for p in pending if cum - p[0] >= metres_cut]
        state.update((cum, lon, lat, last, [p for p in pending if cum - p[0] < metres_cut]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=_OUT.names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    good = fixes.where("trip is not null and t is not null and id is not null and lon is not null and lat is not null").select("trip", "id", "t", "lon", "lat")
    return good.groupBy("trip").applyInPandasWithState(step, _OUT, _STATE, "append", timeout)


def unique_envelopes(envelopes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of envelopes (id, at, ...) without those delivered again within the delay."""
    return envelopes.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def upsert_sink(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row per key, one version of the table for each batch.

    A batch that is run again writes the same version anew, so that a restart loses and doubles nothing.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        rows = batch
        if epoch > 0:
            rows = spark.read.parquet(f"{path}/version={epoch - 1}").select(*batch.columns).unionByName(batch)
        top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_top"))
        top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in rest]).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return write


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a table and read it."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
