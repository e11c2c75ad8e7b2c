"""Problem 5: the most frequent values of a column, by external sort and run-length counting."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of values a map task holds before it writes out a sorted run.
RUN_BYTES = 64 << 20

_PAIR = pa.schema([("value", pa.large_string()), ("n", pa.int64())])


def _count(tables: list[pa.RecordBatch]) -> pa.Table:
    t = pa.Table.from_batches(tables).group_by("value", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"value": t["value"].cast(pa.large_string()), "n": t["n_sum"]})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combined counts of what one map task holds at a time."""
    held, size = [], 0
    for b in batches:
        v = b.column(0).cast(pa.large_string())
        held.append(pa.RecordBatch.from_arrays([v, pa.array(np.ones(len(v), np.int64))], schema=_PAIR))
        size += b.nbytes
        if size > RUN_BYTES:
            yield from _count(held).to_batches(max_chunksize=20_000)
            held, size = [], 0
    if held:
        yield from _count(held).to_batches(max_chunksize=20_000)


def _top(k: int):
    """Run-length counts over a sorted range; a heap keeps the k largest. Also emits how many rows the range had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[int, str]] = []
        last, count = None, 0

        def close() -> None:
            if last is not None:
                if len(heap) < k:
                    heapq.heappush(heap, (count, last))
                elif (count, last) > heap[0]:
                    heapq.heapreplace(heap, (count, last))

        for b in batches:
            v, n = b.column(0), b.column(1).to_numpy()
            if not len(v):
                continue
            starts = np.flatnonzero(np.concatenate(([True], pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False))))
            sums = np.add.reduceat(n, starts)
            first = v[0].as_py()
            if first == last:
                count, starts, sums = count + int(sums[0]), starts[1:], sums[1:]
                if not len(starts):
                    continue
            close()
            # all runs but the last one are complete here
            done, done_at = sums[:-1], starts[:-1]
            floor = heap[0][0] if len(heap) >= k else 0
            best = np.flatnonzero(done >= floor)
            if len(best) > k:
                cut = np.partition(done[best], -k)[-k]
                best = best[done[best] >= cut]
            for i in best:
                last, count = v[int(done_at[i])].as_py(), int(done[i])
                close()
            last, count = v[int(starts[-1])].as_py(), int(sums[-1])
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for _, x in heap], pa.string()), pa.array([c for c, _ in heap], pa.int64())], names=["value", "n"])

    return run


def heavy_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """A superset of the ``k`` most frequent values of ``col`` with exact counts: value, n.

    Map tasks emit combined counts (a value that is a third of all rows leaves a task once per run, not once
    per row), the pairs are range-partitioned and sorted by value (Spark's external sort merges and spills),
    runs of equal values are summed while the range streams by, and a heap of ``k`` pairs is all a task
    holds. Equal values always share a range, so counts are exact. Ties at the k-th place go to the larger
    text. Nulls are no value and are left out; the empty text is one.
    """
    values = df.select(F.col(col).alias("value")).where("value is not null")
    pairs = values.mapInArrow(_runs, "value string, n long")
    return pairs.repartitionByRange("value").sortWithinPartitions("value").mapInArrow(_top(k), "value string, n long")


def values_above(df: DataFrame, col: str, share: float) -> DataFrame:
    """All values that make up at least ``share`` of all rows of ``df`` (rows with a null value count): value, n.

    At most ``1 / share`` values can, so that many places in each range's heap lose none.
    """
    total = df.select(F.count("*").alias("t"))
    return heavy_values(df, col, int(1 / share) + 1).where(F.col("n") >= F.lit(share) * total.scalar())


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by text: value, n."""
    return heavy_values(df, col, k).orderBy(F.desc("n"), F.desc("value")).limit(k)
