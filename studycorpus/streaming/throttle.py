"""At most one progress event per resource and gap.

The first event of a resource only starts its clock; a later one passes when the
gap has gone by since the last passed one. Events without a resource or a time never
pass. Every resource is cut into time ranges that Spark sorts, so one very busy resource is
worked on by many tasks; the ranges are chained by composing their step functions
``FAN`` at a time, so no task sees all ranges of a resource either. The stream form is the
batch form on each trigger, with a table of clocks from the triggers before.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as S

from ..functions import fixed_values as V
from ..plans import scale

NEVER = np.iinfo(np.int64).min
ROWS = 250_000      # rows of a range
FAN = 64            # step functions that are composed in one task


def _passed(times: np.ndarray, last: int, gap: int) -> list[int]:
    """Positions of the events that pass, for sorted times and the last passed one."""
    out = []
    at = int(np.searchsorted(times, last + gap))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + gap))
    return out


class _Steps:
    """Short step function of a range: last passed time before it -> the one behind it.

    Fed with sorted times, piece by piece. The last passed event before a range lies before
    its first time, so the next one to pass is in its first gap or the first one behind that;
    each of these is followed to the end, and those that meet become one. ``ends[0]`` holds
    for a clock that starts with the first time; without ``whole`` only that one is followed.
    """

    def __init__(self, first: int, gap: int, whole: bool):
        self.gap, self.reach, self.open = gap, first + gap, whole
        self.bounds = self.ends = np.array([first], np.int64)

    def add(self, times: np.ndarray) -> None:
        if self.open:
            n = int(np.searchsorted(times, self.reach, side="right"))
            self.open = n == len(times)
            new = np.unique(times[:n + 1])
            new = new[new > self.bounds[-1]]
            self.bounds, self.ends = np.r_[self.bounds, new], np.r_[self.ends, new]
        while (go := self.ends <= times[-1] - self.gap).any():
            ends = self.ends.copy()
            ends[go] = times[np.searchsorted(times, ends[go] + self.gap)]
            keep = np.r_[ends[1:] != ends[:-1], True]
            self.bounds, self.ends = self.bounds[keep], ends[keep]


def _stepped(bounds: np.ndarray, ends: np.ndarray, last: np.ndarray | int, gap: int):
    """Last passed time behind a range, from the one before it (``NEVER``: there is none)."""
    at = np.searchsorted(bounds, np.asarray(last) + gap)
    return np.where(at < len(ends), np.append(ends, NEVER)[at], last)


def _composed(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of two neighbouring ranges. Behind its last bound ``first`` leaves a time
    as it is, so there the steps of ``then`` go on."""
    more = then[0] > first[0][-1]
    bounds = np.concatenate([first[0], then[0][more]])
    ends = np.concatenate([_stepped(*then, first[1], gap), then[1][more]])
    keep = np.append(ends[1:] != ends[:-1], True)
    return bounds[keep], ends[keep]


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, object], int, int]]:
    """((range, key), from, to) of a batch sorted by range and key."""
    if not batch.num_rows:
        return
    keys, parts = batch.column("_key"), batch.column("_part").to_numpy()
    new = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False).astype(bool) | (parts[1:] != parts[:-1])
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield (int(parts[a]), keys[a].as_py()), a, b


def _starts(told: DataFrame, ranges: int, gap: int) -> DataFrame:
    """``_key, _part, _last``: the last passed time before each range that is not its key's first.

    ``told``: ``_key, _part, _bounds, _ends``. A tree over the range numbers: going up, the
    functions of ``FAN`` neighbours become one; going down, each node hands its start value to
    its children. Each step groups by (key, node), so it has at most ``FAN`` rows in a group.
    """
    key = told.schema["_key"]
    node = S.StructField("_part", S.LongType())
    longs = S.ArrayType(S.LongType())
    function = S.StructType([key, node, S.StructField("_bounds", longs), S.StructField("_ends", longs)])
    value = S.StructType([key, node, S.StructField("_last", S.LongType())])

    def in_order(table: pa.Table) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        rows = zip(*(table.column(c).to_pylist() for c in ("_part", "_bounds", "_ends")))
        return sorted(((p, (np.array(b, np.int64), np.array(e, np.int64))) for p, b, e in rows), key=lambda r: r[0])

    def up(at, table):
        steps = in_order(table)
        whole = steps[0][1]
        for _, step in steps[1:]:
            whole = _composed(whole, step, gap)
        return pa.table([table.column("_key").slice(0, 1), pa.array([at[1].as_py()], pa.int64()),
                         pa.array([whole[0]], pa.list_(pa.int64())), pa.array([whole[1]], pa.list_(pa.int64()))], names=function.names)

    def down(at, table):
        last, nodes, values = max(table.column("_before").to_pylist()), [], []
        for part, step in in_order(table):
            nodes.append(part)
            values.append(last)
            last = int(_stepped(*step, last, gap))
        return pa.table([pa.concat_arrays([table.column("_key").slice(0, 1).combine_chunks()] * len(nodes)), pa.array(nodes, pa.int64()), pa.array(values, pa.int64())],
                        names=value.names)

    parent = F.expr(f"_part div {FAN}").alias("_node")
    levels = [scale.checkpointed(told.select("_key", F.col("_part").cast("long"), "_bounds", "_ends"))]
    width = ranges
    while width > FAN:
        width = -(-width // FAN)
        levels.append(scale.checkpointed(levels[-1].groupBy("_key", parent).applyInArrow(up, function)))
    before = None
    for level in reversed(levels):
        rows = level.select("*", parent)
        if before is None:
            rows = rows.withColumn("_before", F.lit(int(NEVER)))
        else:
            rows = rows.join(before.select("_key", F.col("_part").alias("_node"), F.col("_last").alias("_before")), ["_key", "_node"])
        before = rows.groupBy("_key", "_node").applyInArrow(down, value)
    return before.filter(F.col("_last") != int(NEVER)).withColumn("_part", F.col("_part").cast("int"))


def throttle_batch(events: DataFrame, key: str, ts: str, order: str, gap_seconds: float = V.THROTTLE_SECONDS) -> DataFrame:
    """Events that pass; columns key, ts, order.

    1. Rows are range partitioned on (key, time), about ``ROWS`` a range. 2. Only the first
    and the last key of a range can go on in another one; for these the range tells as a short
    step function how the last passed time changes across it. 3. The steps are chained by a tree
    of compositions. 4. Each range marks its rows from its start values. Steps 2 to 4 read rows that
    Spark has sorted, and carry only the last passed time (step 2: the step function).
    """
    gap = int(gap_seconds * 1_000_000)
    width = scale.shuffle_width(events.sparkSession)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = (events.select(F.col(key).alias("_key"), micros.alias("_t"), F.col(order).alias("_o"))
                  .filter("_key is not null and _t is not null"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    by_order = F.col("_o").asc_nulls_last()
    ranges = max(width, -(-rows.count() // ROWS))
    parts = scale.checkpointed(rows.repartitionByRange(ranges, "_key", "_t", by_order).withColumn("_part", F.spark_partition_id()))
    key_field, part_field = S.StructField("_key", kinds["_key"]), S.StructField("_part", S.IntegerType())
    longs = S.ArrayType(S.LongType())
    steps = S.StructType([key_field, part_field, S.StructField("_bounds", longs), S.StructField("_ends", longs)])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(kind) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[1]], kind), pa.array([at[0]], pa.int32()), pa.array([now.bounds], pa.list_(pa.int64())),
                                               pa.array([now.ends], pa.list_(pa.int64()))], names=steps.names)

        at, now, first, kind = None, None, True, None
        for batch in batches:
            kind = batch.schema.field("_key").type
            times = batch.column("_t").to_numpy()
            found = list(_segments(batch))
            for i, (name, a, b) in enumerate(found):
                if name != at:
                    other = at is None or name[0] != at[0]
                    if now and (first or other):
                        yield told(kind)
                    at, now, first = name, None, other
                    # a key between the first and the last one of its range has no steps
                    if first or i + 1 == len(found) or found[i + 1][0][0] != name[0]:
                        now = _Steps(int(times[a]), gap, first)
                if now:
                    now.add(times[a:b])
        if now:
            yield told(kind)

    told = parts.repartition(ranges, "_part").sortWithinPartitions("_part", "_key", "_t").mapInArrow(describe, steps)
    starts = _starts(told, ranges, gap)
    marked = S.StructType([key_field, S.StructField("_t", S.LongType()), S.StructField("_o", kinds["_o"])])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, NEVER
        for batch in batches:
            times, known = (batch.column(c).fill_null(NEVER).to_numpy() for c in ("_t", "_last"))
            hits = []
            for name, a, b in _segments(batch):
                if name != at:
                    at, last = name, NEVER
                if known[a] != NEVER:
                    last, a = int(known[a]), a + 1
                if a < b:
                    found = _passed(times[a:b], int(times[a]) if last == NEVER else last, gap)
                    hits += [a + i for i in found]
                    last = int(times[hits[-1]]) if found else int(times[a]) if last == NEVER else last
            yield batch.select(marked.names).take(pa.array(hits, pa.int64()))

    # the start value of a range's first key comes before its rows
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    dealt = parts.withColumn("_last", F.lit(None).cast("long")).unionByName(starts.select("_key", none("_t"), none("_o"), "_part", "_last"))
    out = dealt.repartition(ranges, "_part").sortWithinPartitions("_part", "_key", "_t", by_order).mapInArrow(mark, marked)
    same = events.schema[ts].dataType
    return out.select(F.col("_key").alias(key), F.timestamp_micros("_t").cast(same).alias(ts), F.col("_o").alias(order))


def throttle_trigger(rows: DataFrame, number: int, path: str, key: str, ts: str, order: str, gap_seconds: float = V.THROTTLE_SECONDS,
                     ttl_seconds: int | None = 86_400) -> None:
    """One trigger: events that pass go to ``path/events/batch=<number>``, the last passed time of each
    resource to ``path/clocks/batch=<number>``.

    Clocks come from the trigger before. A clock stands as an event of its resource before the
    new ones, and events within its gap are left out, so the batch form goes on from it. A
    resource that was silent for ``ttl_seconds`` of event time is forgotten. A repeated trigger reads
    the same clocks and overwrites what it wrote.
    """
    spark = rows.sparkSession
    rows = rows.select(key, ts, order).filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    clocks = _clocks(spark, path, number)
    if clocks is not None:
        known = clocks.select(F.col("resource").alias(key), F.col("last").alias("_clock"))
        gap = F.make_interval(secs=F.lit(gap_seconds))
        new = (scale.lookup_join(rows, known, [key]).filter(F.col("_clock").isNull() | (F.col(ts) >= F.col("_clock") + gap)).drop("_clock"))
        rows = new.unionByName(known.select(key, F.col("_clock").cast(rows.schema[ts].dataType).alias(ts), F.lit(None).cast(rows.schema[order].dataType).alias(order)))
    rows = scale.checkpointed(rows)
    passed = throttle_batch(rows, key, ts, order, gap_seconds)
    passed.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
    passed = spark.read.schema(passed.schema).parquet(f"{path}/events/batch={number}")
    # the first event of a resource, or its clock, is what stays if nothing passed
    last = (rows.groupBy(key).agg(F.min(ts).alias("t")).unionAll(passed.groupBy(key).agg(F.max(ts).alias("t")))
                .groupBy(F.col(key).alias("resource")).agg(F.max("t").alias("last")))
    if ttl_seconds:
        now = rows.agg(F.max(ts)).first()[0]
        last = last.filter(F.col("last") >= F.lit(now) - F.make_interval(secs=F.lit(ttl_seconds))) if now is not None else last
    last.write.mode("overwrite").parquet(f"{path}/clocks/batch={number}")


def _clocks(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Clocks of the latest trigger before a number. Only that one's folder is read."""
    try:
        rows = spark.read.parquet(f"{path}/clocks")
    except AnalysisException:
        return None
    number = rows.filter(F.col("batch") < before).agg(F.max("batch")).first()[0]
    return None if number is None else rows.filter(F.col("batch") == number).drop("batch")


def start(events: DataFrame, path: str, checkpoint: str, key: str, ts: str, order: str, gap_seconds: float = V.THROTTLE_SECONDS,
          ttl_seconds: int | None = 86_400, available_now: bool = False):
    """Throttle a stream of events into tables below ``path``; see ``throttle_trigger``."""
    writer = (events.writeStream.foreachBatch(lambda rows, number: throttle_trigger(rows, number, path, key, ts, order, gap_seconds, ttl_seconds))
                    .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def passed_events(spark: SparkSession, path: str) -> DataFrame:
    """The events that passed in all triggers."""
    return spark.read.parquet(f"{path}/events").drop("batch")
