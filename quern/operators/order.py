"""Running sums and bin packing over a total order, without a task for a whole group where the order allows it."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import ship


def running(rows: DataFrame, group: list[str], order: list[str], value: Column, part: Column, into: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group.

    ``part`` is a coarse key that the order refines (equal parts are neighbours in the order): sums of parts are
    added up first, so that a group that holds most rows is still many tasks.
    """
    keyed = rows.withColumn("_part", part).withColumn("_value", value)
    sums = keyed.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_before", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return placed.join(starts, [*group, "_part"]).withColumn(into, F.col("_start") + F.col("_before")).drop("_part", "_value", "_start", "_before")


def next_fit(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Bins in order of arrival: a bin closes when the next row would overflow it; a larger row has its own bin.

    Adds ``bin`` (from 0 in each group). The rule makes each bin depend on the one before, so a group is one sorted
    stream of narrow rows (``rows`` holds no texts), of which a batch at a time is in memory; from one bin to the next
    it jumps by a search in the running sums. Repeated rows are rows of their own.
    """

    def run(batches):
        last, number, used = None, 0, 0
        for batch in batches:
            keys = batch.column(group)
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype("i8")
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes)].astype("i8")
            bins = np.zeros(len(codes), "i4")
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if low == high:
                    continue
                if (key := keys[low].as_py()) != last or low:
                    last, number, used = key, 0, 0
                sums = np.cumsum(sizes[low:high])
                at, done = 0, 0
                while at < high - low:
                    stop = int(np.searchsorted(sums, done + budget - used, side="right"))
                    if stop == at and used == 0:
                        stop = at + 1  # larger than a bin
                    bins[low + at : low + stop] = number
                    if stop > at:
                        used += int(sums[stop - 1]) - done
                        done = int(sums[stop - 1])
                    at = stop
                    if at < high - low:
                        number, used = number + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins)], [*batch.schema.names, "bin"])

    return _by_group(rows, group, [group, order], run)


def best_fit(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Best-fit decreasing: rows by falling size go to the fullest bin with room, the earliest at a tie. Adds ``bin``.

    As in ``next_fit`` a group is one sorted stream of narrow rows; in memory are only the rooms of its open bins.
    """

    def run(batches):
        last, rooms, count = None, [], 0
        for batch in batches:
            bins = []
            for g, n in zip(batch.column(group).to_pylist(), batch.column(size).to_pylist()):
                if g != last:
                    last, rooms, count = g, [], 0
                at = bisect.bisect_left(rooms, (n, -1))
                if at < len(rooms):
                    room, number = rooms.pop(at)
                else:
                    room, number = budget, count
                    count += 1
                if room > n:
                    bisect.insort(rooms, (room - n, number))
                bins.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int32())], [*batch.schema.names, "bin"])

    return _by_group(rows, group, [F.col(group), F.col(size).desc(), F.col(order)], run)


def _by_group(rows: DataFrame, group: str, ordering, run) -> DataFrame:
    ship(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(group).sortWithinPartitions(*ordering).mapInArrow(run, f"{fields}, bin int")
