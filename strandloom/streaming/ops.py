"""Streaming twins of the batch operators: stateful ones hold bounded state per key, late rows go by the watermark."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandloom.session import cut_lineage, ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's parquet file or folder as a stream of files; the schema is taken from the table."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    path = os.path.join(sf_dir, f"{name}.parquet")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def in_turns(spark: SparkSession, sf_dir: str, name: str, order: str, batches: int, closing: dict[str, Column] | None = None) -> DataFrame:
    """A table as a stream of ``batches`` files in ``order``, one a micro-batch, written to the shared folder first.

    closing: values (column -> constant) of one last row in a file of its own, which closes what waits for later rows: give it a
    time beyond every watermark. It is the caller's to leave it out of the result.
    """
    import uuid

    rows = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    base = os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    files = cut_lineage(rows.repartitionByRange(batches, order).sortWithinPartitions(order).withColumn("_turn", F.spark_partition_id()))
    for turn in range(batches):  # one after the other, as files are taken by their age
        files.filter(F.col("_turn") == turn).drop("_turn").write.parquet(f"{base}/_turn={turn}")
    if closing is not None:
        last = spark.range(1).select(*(closing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))
        last.coalesce(1).write.parquet(f"{base}/_turn={batches}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{base}/_turn=*")


def tumbling_counts(stream: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """(start, key, n, total) per window, final once the watermark has passed it."""
    w = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), key, "n", "total")


def session_counts(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    w = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def exactly_once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each idempotency key once, within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def count_flush(stream: DataFrame, key: str, order: str, text: str, size: int, time: str | None = None, late: str = "1 day") -> DataFrame:
    """(key, batch, n, text): tokens of a key joined in batches of ``size``, in order of arrival and, within a trigger, ``order``.

    State is the open batch of a key. With a ``time`` column it is flushed with fewer tokens once the watermark (``late`` behind the
    latest time) has passed the key's last token, so that nothing stays in the state for good; tokens after that start a new batch.
    Without one, open batches wait for further tokens.
    """
    kinds = dict(stream.dtypes)

    def flush(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, held = state.get if state.exists else (0, [])
        held = list(held)
        out = []
        if state.hasTimedOut:
            if held:
                out.append((keys[0], n, len(held), " ".join(held)))
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values(order)
            for t in rows[text]:
                held.append(str(t))
                if len(held) == size:
                    out.append((keys[0], n, size, " ".join(held)))
                    n, held = n + 1, []
            state.update((n, held))
            if time is not None:
                latest = int(rows[time].max().timestamp() * 1000) if rows[time].notna().any() else 0
                state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "batch", "n", "text"])

    if time is None:
        rows, timeout = stream.select(key, order, text), "NoTimeout"
    else:
        rows, timeout = stream.select(key, order, text, F.col(time).cast("timestamp").alias(time)).withWatermark(time, late), "EventTimeTimeout"
    return rows.groupBy(key).applyInPandasWithState(flush, f"{key} {kinds[key]}, batch long, n long, text string", "n long, held array<string>", "append", timeout)


def rate_limit(stream: DataFrame, key: str, time: str, order: str, limit: int, seconds: float) -> DataFrame:
    """(key, order, allowed) as in the batch operator; state is the times of the allowed calls in the window, at most ``limit``."""
    kinds = dict(stream.dtypes)

    def decide(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["_us", order])
        allowed = []
        for t in rows["_us"].to_numpy():
            recent = [x for x in recent if x > t - seconds * 1e6]
            ok = len(recent) < limit
            recent += [int(t)] if ok else []
            allowed.append(ok)
        state.update((recent,))
        yield pd.DataFrame({key: rows[key], order: rows[order], "allowed": allowed})

    timed = stream.select(key, order, F.unix_micros(F.col(time).cast("timestamp")).alias("_us"))
    return timed.groupBy(key).applyInPandasWithState(decide, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean", "recent array<long>", "append", "NoTimeout")


def drained(stream: DataFrame, name: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run the stream over what is there now. Rows go to parquet in the shared folder and are read back; with ``sink`` each
    micro-batch goes there instead (exactly once, if it is idempotent by batch number)."""
    import uuid

    spark = stream.sparkSession
    base = os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", base + "/state").trigger(availableNow=True)
    if sink is not None:
        writer.foreachBatch(sink).start().awaitTermination()
        return None
    writer.format("parquet").option("path", base + "/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/rows")


def upsert_sink(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that keeps the latest row of each key as numbered snapshots below ``path``; a repeated batch number
    writes the same snapshot again."""

    def write(batch: DataFrame, number: int) -> None:
        from strandloom.operators.logs import latest

        spark = batch.sparkSession
        rows = batch
        if number:
            rows = spark.read.parquet(f"{path}/{number - 1}").unionByName(batch)
        latest(rows, keys, F.col(order)).write.mode("overwrite").parquet(f"{path}/{number}")

    return write
