"""Live file events: Structured Streaming and its batch equivalents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from stackroom.functions.paths import live_excluded
from stackroom.session import cut

# Bits of an event that mean events were lost.
MUST_SCAN, USER_DROPPED, KERNEL_DROPPED, HISTORY_DONE, ROOT_CHANGED = 1, 2, 4, 16, 32
DROPPED = MUST_SCAN | USER_DROPPED | KERNEL_DROPPED | HISTORY_DONE | ROOT_CHANGED
MAX_PENDING, MAX_BATCH, DEBOUNCE = 4096, 2000, "800 milliseconds"
RESCAN = "rescan"
SPAN = 4096  # pieces of time in a task of the batch form of debounced


def dropped(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(DROPPED)) != 0


def read_events(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A stream of events from a folder that fills."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def relevant(events: DataFrame, roots: list[str], excluded: list[str]) -> DataFrame:
    from functools import reduce

    from stackroom.functions.paths import under

    inside = reduce(lambda a, b: a | b, (under(F.col("path"), r) for r in roots), F.lit(False)) if roots else F.lit(True)
    return events.where(inside & ~live_excluded(F.col("path"), excluded))


def debounced(events: DataFrame, gap: str = DEBOUNCE, watermark: str | None = None) -> DataFrame:
    """Bursts: a session over all paths, which a pause of ``gap`` closes.

    ``(start, end, events, paths, dropped)``. Of a stream this is a session window, whose key is
    constant because any event re-arms the timer; its paths are counted by eight bytes each. Of a
    table it is aggregates and joins on pieces of time, so that no task has to see all events.
    """
    if not events.isStreaming:
        return _bursts(events, gap)
    src = events.withWatermark("ts", watermark) if watermark else events
    one = F.substring("path", 1, 0)  # a constant that the optimiser keeps: streaming sessions need a key
    w = src.groupBy(one.alias("all"), F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.size(F.collect_set(F.xxhash64("path"))).alias("paths"), F.bool_or(dropped(F.col("flags"))).alias("dropped"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "paths", "dropped")


def _bursts(events: DataFrame, gap: str) -> DataFrame:
    """:func:`debounced` of a table.

    Events of one piece of time, as long as the gap, are of one burst, and a burst goes on into the
    next piece alone. Where bursts begin is carried over ``SPAN`` pieces in a task, and from span
    to span by one row a span.
    """
    spark = events.sparkSession
    width = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{gap}') AS w").first()["w"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where("ts is not null").select(at.alias("at"), "path", dropped(F.col("flags")).alias("lost"))
    rows = rows.select("at", F.expr(f"(at - pmod(at, {width}L)) div {width}L").alias("piece"), "path", "lost")
    seen = cut(rows.groupBy("piece", "path").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.bool_or("lost").alias("lost")), "seen")
    pieces = seen.groupBy("piece").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("lost").alias("lost"))
    both = pieces.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("on"))  # each piece for itself and as what the next one follows
    own = lambda name: F.max(F.when(F.col("on") == 0, F.col(name))).alias(name)
    met = both.groupBy((F.col("piece") + F.col("on")).alias("piece")).agg(own("n"), own("low"), own("high"), own("lost"), F.max(F.when(F.col("on") == 1, F.col("high"))).alias("before")).where("n is not null")
    begins = F.when(F.col("before").isNull() | (F.col("low") - F.col("before") >= width), F.col("low"))
    local = Window.partitionBy("span").orderBy("piece")
    known = cut(met.withColumn("span", F.expr(f"(piece - pmod(piece, {SPAN})) div {SPAN}")).withColumn("begun", F.max(begins).over(local)), "pieces")
    carried = known.groupBy("span").agg(F.max("begun").alias("begun")).select("span", F.max("begun").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    placed = cut(known.join(carried, "span").select("piece", F.coalesce("begun", "carried").alias("begun"), "n", "high", "lost"), "placed")
    paths = seen.where("path is not null").join(placed.select("piece", "begun"), "piece").select("begun", "path").distinct().groupBy("begun").agg(F.count("*").alias("paths"))
    out = placed.groupBy("begun").agg(F.max("high").alias("high"), F.sum("n").alias("events"), F.bool_or("lost").alias("dropped")).join(paths, "begun", "left")
    kind = dict(events.dtypes)["ts"]
    time = lambda micros: F.timestamp_micros(micros).cast(kind)
    return out.select(time(F.col("begun")).alias("start"), time(F.col("high") + width).alias("end"), "events", F.coalesce("paths", F.lit(0)).cast("int").alias("paths"), "dropped")


def coalesce(batch: DataFrame, *, max_pending: int = MAX_PENDING, max_batch: int = MAX_BATCH, keys: tuple[str, ...] = ()) -> DataFrame:
    """One batch's work: ``(kind, path, flags, event_id)``.

    The last event of each path, or a single rescan marker if events were dropped or there are
    more paths than may be pending or drained. ``keys`` name several batches at once.
    """
    by = list(keys)
    last = batch.where(~dropped(F.col("flags"))).groupBy(*by, "path").agg(F.max_by(F.struct("flags", "event_id"), "event_id").alias("e"))
    state = batch.groupBy(*by).agg(F.bool_or(dropped(F.col("flags"))).alias("lost"), F.max("event_id").alias("last_id"))
    counts = last.groupBy(*by).agg(F.count("*").alias("paths"))
    facts = state.join(counts, by, "left") if by else state.crossJoin(counts)  # one row each
    facts = facts.withColumn("collapse", F.coalesce("lost", F.lit(False)) | (F.coalesce("paths", F.lit(0)) > min(max_pending, max_batch)))
    markers = facts.where("collapse").select(*by, F.lit(RESCAN).alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("flags"), F.col("last_id").alias("event_id"))
    calm = facts.where("not collapse").select(*by) if by else facts.where("not collapse").select(F.lit(1).alias("calm"))
    rows = last.join(calm, by, "left_semi") if by else last.withColumn("calm", F.lit(1)).join(calm, "calm", "left_semi")
    return rows.select(*by, F.lit("path").alias("kind"), "path", F.col("e.flags").alias("flags"), F.col("e.event_id").alias("event_id")).unionByName(markers)


def batch_metrics(batch: DataFrame, *, max_pending: int = MAX_PENDING, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(events, pending, peak, collapsed, dropped)`` of each batch."""
    by = list(keys)
    per = batch.groupBy(*by).agg(F.count("*").alias("events"), F.count_distinct("path").alias("pending"), F.bool_or(dropped(F.col("flags"))).alias("dropped"))
    return per.select(*by, "events", "pending", F.least("pending", F.lit(max_pending)).alias("peak"), (F.col("pending") > max_pending).alias("collapsed"), "dropped")


def start(events: DataFrame, sink: Callable[[DataFrame, int], None], *, checkpoint: str, excluded: list[str] = (), available_now: bool = False, **limits):
    """Run the coalescer: every micro-batch becomes work, handed to ``sink`` once per batch id."""

    def each(batch: DataFrame, number: int) -> None:
        sink(coalesce(relevant(batch, [], list(excluded)), **limits), number)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def reconcile_plan(requests: DataFrame, cooldown: float = 60.0) -> DataFrame:
    """Batch form of the rate limit: requests ``(ts)`` in seconds to the times at which scans run.

    A request runs at once if the last scan is ``cooldown`` ago, else one deferred scan runs when
    that time is over, however many requests wait. Requests are few: markers, not events.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, deferred = [], None
        for t in sorted(pdf["ts"]):
            if deferred is not None and t >= deferred:
                runs.append(deferred)
                deferred = None
            if not runs or t - runs[-1] >= cooldown:
                runs.append(t)
            elif deferred is None:
                deferred = runs[-1] + cooldown
        if deferred is not None:
            runs.append(deferred)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "scan_at": runs})

    return requests.groupBy("key").applyInPandas(run, "key string, scan_at double")


class Reconciler(StatefulProcessor):
    """Streaming form of the rate limit: state is the last scan, a timer fires the deferred one."""

    def __init__(self, cooldown_ms: int = 5000):
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))
        self.waiting = handle.getValueState("waiting", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        waiting = self.waiting.get()[0] if self.waiting.exists() else None
        timer, scans = waiting, []
        for now in sorted(int(ts.timestamp() * 1000) for pdf in rows for ts in pdf["ts"]):
            if waiting is not None and now >= waiting:  # its time came before the timer fired
                scans.append(waiting)
                last, waiting = waiting, None
            if last is None or now - last >= self.cooldown:
                scans.append(now)
                last = now
            elif waiting is None:
                waiting = last + self.cooldown
        if waiting != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
                self.waiting.clear()
            if waiting is not None:
                self.waiting.update((waiting,))
                self.handle.registerTimer(waiting)
        if scans:
            self.last.update((last,))
            yield pd.DataFrame({"key": [key[0]] * len(scans), "scan_at": [t / 1000 for t in scans]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.waiting.exists():
            at = self.waiting.get()[0]
            self.waiting.clear()
            self.last.update((at,))
            yield pd.DataFrame({"key": [key[0]], "scan_at": [at / 1000]})

    def close(self) -> None:
        pass


def wake(spark: SparkSession, at: float, event_id: int = 0) -> DataFrame:
    """The event that stands for whatever was missed while the machine slept: a scan must follow."""
    return spark.createDataFrame([(None, MUST_SCAN, event_id, at)], "path string, flags int, event_id long, at double").select("path", "flags", "event_id", F.timestamp_seconds("at").alias("ts"))


def reconcile_stream(requests: DataFrame, cooldown_ms: int = 5000) -> DataFrame:
    """Scans ``(key, scan_at)`` of a stream of markers ``(key, ts)``; needs the RocksDB state store."""
    schema = StructType([StructField("key", requests.schema["key"].dataType), StructField("scan_at", DoubleType())])
    return requests.withWatermark("ts", "1 second").groupBy("key").transformWithStateInPandas(Reconciler(cooldown_ms), outputStructType=schema, outputMode="append", timeMode="eventTime")
