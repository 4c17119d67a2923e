"""Online twins of the ordered operators, on Structured Streaming.

Rows of a key are released in event-time order once the watermark has passed
them, so a stream that arrives out of order gives the same answer as the batch
operator on the same rows.  What is still ahead of the watermark is not yet
final and stays in state.  State holds the rows that wait and a few numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FILES_PER_BATCH = 64
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enable_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table of the folder as a stream; event time becomes a timestamp in UTC.

    A table is one file or a folder of part files.  A batch takes at most
    ``files_per_batch`` files (FILES_PER_BATCH unless given), so a backlog does not
    arrive as one batch.
    """
    table = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(table).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch or FILES_PER_BATCH))
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        out = reader.parquet(table)
    else:
        out = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    for f in schema.fields:
        if f.dataType == T.TimestampNTZType():
            out = out.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return out


# --- windows ---


def sliding_windows(stream: DataFrame, ts: str, delay: str, size: str, slide: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Sliding event-time windows, each emitted once, after its end has passed the watermark."""
    out = stream.withWatermark(ts, delay).groupBy(F.window(ts, size, slide), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def tumbling_metrics(stream: DataFrame, ts: str, delay: str, size: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Tumbling metrics, for the update mode: the latest version of a window replaces earlier ones."""
    return sliding_windows(stream, ts, delay, size, size, keys, aggs)


def segment_bursts(stream: DataFrame, ts: str, delay: str, gap: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Bursts: runs of rows with no gap longer than ``gap``."""
    out = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(*aggs)
    return out.select(
        F.col("session_window.start").alias("burst_start"), F.col("session_window.end").alias("burst_end"),
        *[c for c in out.columns if c != "session_window"],
    )


# --- ordered state ---

Step = Callable[[list[float], tuple], tuple[list[float], tuple]]


def _ordered_processor(
    keys: Sequence[str], columns: Sequence[str], column_types: Sequence[T.DataType], ts: str, tie: str, state_size: int,
    out_names: Sequence[str], step: Step,
):
    waiting_type = T.StructType([T.StructField(c, t) for c, t in zip(columns, column_types, strict=True)])
    state_type = T.StructType([T.StructField(f"s{i}", T.DoubleType()) for i in range(state_size)])

    class Ordered(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", waiting_type)
            self.state = handle.getValueState("state", state_type)

        def _numbers(self) -> list[float]:
            return [float(x) for x in self.state.get()] if self.state.exists() else [0.0] * state_size

        def _release(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
            rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
            at, by = columns.index(ts), columns.index(tie)
            ready = sorted((r for r in rows if _micros(r[at]) <= watermark_ms * 1000), key=lambda r: (r[at], r[by]))
            left = [r for r in rows if _micros(r[at]) > watermark_ms * 1000]
            state, out = self._numbers(), []
            for row in ready:
                state, made = step(state, row)
                out.append((*key, *row, *made))
            if ready:
                self.state.update(tuple(state))
                if left:
                    self.waiting.put(left)
                else:
                    self.waiting.clear()
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if left:
                self.handle.registerTimer(min(_micros(r[at]) for r in left) // 1000 + 1)
            if out:
                yield pd.DataFrame(out, columns=[*keys, *columns, *out_names])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            fresh = [tuple(_plain(v) for v in r) for pdf in rows for r in pdf[list(columns)].itertuples(index=False, name=None)]
            if fresh:
                self.waiting.appendList(fresh)
            yield from self._release(key, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield from self._release(key, timerValues.getCurrentWatermarkInMs())

        def close(self) -> None:
            pass

    return Ordered()


def _micros(t) -> int:
    return int(pd.Timestamp(t).tz_localize("UTC").value // 1000) if pd.Timestamp(t).tzinfo is None else int(pd.Timestamp(t).value // 1000)


def _plain(v):
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v.item() if hasattr(v, "item") else v


def ordered_stream(
    stream: DataFrame, keys: Sequence[str], ts: str, tie: str, delay: str, inputs: Sequence[str], state_size: int,
    out_fields: Sequence[tuple[str, T.DataType]], step: Callable[[list[float], dict], tuple[list[float], tuple]],
) -> DataFrame:
    """Carry a few numbers along every key in event-time order.

    ``step`` gets the state and the row as a dict; its state starts at zero.
    """
    enable_state(stream.sparkSession)
    columns = list(dict.fromkeys([ts, tie, *inputs]))
    kinds = [stream.schema[c].dataType for c in columns]
    names = [n for n, _ in out_fields]

    def on_row(state, row):
        return step(state, dict(zip(columns, row, strict=True)))

    schema = T.StructType(
        [*[stream.schema[k] for k in keys], *[stream.schema[c] for c in columns], *[T.StructField(n, t) for n, t in out_fields]]
    )
    marked = stream.select(*keys, *columns).withWatermark(ts, delay)
    return marked.groupBy(*keys).transformWithStateInPandas(
        _ordered_processor(keys, columns, kinds, ts, tie, state_size, names, on_row), schema, "append", "eventtime"
    )


def latest_available(
    stream: DataFrame, keys: Sequence[str], ts: str, tie: str, delay: str, is_value: str, value: str, latency_s: float
) -> DataFrame:
    """Probe rows with the newest value usable at their time.

    Values become usable ``latency_s`` after they were produced, so they are
    given that time first; a value and a probe at the same instant meet.
    """
    if latency_s < 0:
        raise ValueError("latency must not be negative")
    usable = F.timestamp_micros(F.unix_micros(ts) + F.when(F.col(is_value), F.lit(int(latency_s * 1_000_000))).otherwise(0))
    # Values sort before probes on equal time through the tie column.
    order = F.when(F.col(is_value), F.lit(-1)).otherwise(F.lit(1)) * (F.col(tie) + 1)
    ready = stream.withColumn("usable_at", usable).withColumn("order_key", order.cast("bigint"))

    def step(state, row):
        if row[is_value]:
            return [1.0, float(row[value])], (None,)
        return state, (state[1] if state[0] else None,)

    out = ordered_stream(
        ready, keys, "usable_at", "order_key", delay, [is_value, value, tie], 2, [("latest", T.DoubleType())], step
    )
    return out.where(~F.col(is_value)).select(*keys, tie, "latest")


def moving_standardise(stream: DataFrame, keys: Sequence[str], ts: str, tie: str, delay: str, value: str, alpha: float, eps: float) -> DataFrame:
    """Exponentially weighted mean and standardised value, with the weighted sums as state."""
    d = 1.0 - alpha

    def step(state, row):
        num, den, var_num, var_den = state
        x = float(row[value])
        num, den = d * num + x, d * den + 1.0
        dev = x - num / den
        var_num, var_den = d * var_num + dev * dev, d * var_den + 1.0
        return [num, den, var_num, var_den], (num / den, dev / max(eps, math.sqrt(var_num / var_den)))

    return ordered_stream(
        stream, keys, ts, tie, delay, [value], 4, [("mean", T.DoubleType()), ("z", T.DoubleType())], step
    )


def accumulate_evidence(
    stream: DataFrame, keys: Sequence[str], ts: str, tie: str, delay: str, probabilities: Sequence[str], gamma: float = 0.8,
    theta: float = -1.0, epsilon: float = 1e-6, hold_s: float = 0.5,
) -> DataFrame:
    """Leaky evidence with threshold and reset; ``held`` is the class still inside its hold time, or -1."""
    n = len(probabilities)

    def step(state, row):
        e = [gamma * s + math.log(float(row[p]) + epsilon) for s, p in zip(state[:n], probabilities, strict=True)]
        held, since, any_yet = state[n:]
        now = _micros(row[ts]) / 1e6
        top, emitted = max(e), -1
        if top > theta:
            emitted = e.index(top)
            e, held, since, any_yet = [0.0] * n, float(emitted), now, 1.0
        active = int(held) if any_yet and now - since < hold_s else -1
        return [*e, held, since, any_yet], (emitted, active, top)

    return ordered_stream(
        stream, keys, ts, tie, delay, list(probabilities), n + 3,
        [("emitted", T.IntegerType()), ("held", T.IntegerType()), ("evidence_max", T.DoubleType())], step,
    )


# --- late rows ---


def late_policy(stream: DataFrame, keys: Sequence[str], arrival: str, ts: str, delay_s: float) -> DataFrame:
    """Mark rows that come more than ``delay_s`` behind the newest time of their key, in arrival order.

    Late rows are kept, so they can be counted or written aside; nothing is
    dropped on the way.
    """
    enable_state(stream.sparkSession)
    columns = [arrival, ts]
    schema = T.StructType([*[stream.schema[k] for k in keys], *[stream.schema[c] for c in columns], T.StructField("is_late", T.BooleanType())])
    limit = int(delay_s * 1_000_000)

    class Late(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.newest = handle.getValueState("newest", T.StructType([T.StructField("us", T.LongType())]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(rows)).sort_values(arrival, kind="stable")
            newest = self.newest.get()[0] if self.newest.exists() else None
            flags = []
            for t in pdf[ts]:
                us = _micros(t)
                flags.append(newest is not None and us < newest - limit)
                newest = us if newest is None else max(newest, us)
            self.newest.update((int(newest),))
            out = pdf[columns].assign(is_late=flags)
            for i, k in enumerate(keys):
                out.insert(i, k, key[i])
            yield out

        def close(self) -> None:
            pass

    return stream.select(*keys, *columns).groupBy(*keys).transformWithStateInPandas(Late(), schema, "append", "none")


# --- running to completion ---


def run_append(df: DataFrame, folder: str) -> DataFrame:
    """Process what is available, append to Parquet, and return the result."""
    q = (
        df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def run_aside(df: DataFrame, flag: str, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Process what is available and return (rows, rows set aside by ``flag``, counts per batch).

    Each batch writes both kinds in one pass, under its number: a batch that is tried
    again, or that runs again after a restart, replaces itself.  Counts are observed in
    that same pass; ``dropped`` is what the engine left out behind the watermark, so
    rows in = rows + aside + dropped.
    """
    spark = df.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(flag)).alias("n_aside"))
        counted.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        got = seen.get
        spark.createDataFrame([(got["n_rows"] - got["n_aside"], got["n_aside"])], "n_kept bigint, n_aside bigint").write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    q = df.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    lost = [(p["batchId"], sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])) for p in q.recentProgress]
    for number, n in dict(sorted(lost)).items():
        spark.createDataFrame([(n,)], "n_dropped bigint").write.mode("overwrite").parquet(f"{folder}/dropped/batch={number}")

    def table(name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/{name}")
        except AnalysisException:  # no batch yet
            return spark.createDataFrame([], f"{schema}, batch bigint")

    rows = table("rows", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)).drop("batch")
    counts = table("counts", "n_kept bigint, n_aside bigint").join(table("dropped", "n_dropped bigint"), "batch", "full").na.fill(0)
    return rows.where(~F.col(flag)).drop(flag), rows.where(F.col(flag)).drop(flag), counts


def run_update(df: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Process what is available in update mode and return the last version of every key."""

    def save(batch: DataFrame, number: int) -> None:
        # One folder per batch number: a batch that is tried again replaces itself.
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = df.sparkSession.read.parquet(f"{folder}/out").drop("batch")
    values = [c for c in rows.columns if c not in (*keys, "version")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("x"))
    return last.select(*keys, "x.*")
