"""Cache spans (F5): which requests of a key are misses, in a fixed number of shuffles.

A miss opens a span of the time to live; the next miss is the first request at or behind the
span's end.  Time is cut into cells, ``PHASES`` of them in a span, so a span that begins
in a cell ends in the cell ``PHASES`` further on, the cell of the same phase.  Hence:

1. Rows are sorted by key and phase.  From the first request of every cell a path of misses is
   followed from cell to cell of its phase, as long as the cell in which a span ends
   has a request behind that end.  Paths that meet go on as one, that of the latest cell.
2. A path that leaves its phase goes on with the next request of its key, which is the first of
   its cell, so the start of another path.  The chain of a key that is true begins with its first
   path, and one pass over the key's cells follows it.
3. The steps of the true paths are the misses.

All requests of a hot key are thus spread over its phases, and memory grows with the spans covered
by the data, never with the number of requests.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PHASES = 256
MICROS_PER_DAY = 86_400_000_000

Batches = Iterator[pa.RecordBatch]
_LONGS = ("path", "step", "link", "link_step", "gone")


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a run of equal values begins; the first row always does."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _paths(width: int) -> Callable[[Batches], Batches]:
    """Rows ``(key, phase, at, row)`` in that order to the steps and the ends of paths."""

    def run(batches: Batches) -> Batches:
        span = width * PHASES
        current, here, waiting = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key_column, at_column, row_column = batch.column(0), batch.column(2), batch.column(3)
            times = at_column.to_numpy()
            cells = times // width
            at = times.tolist()
            bounds = [*_starts(key_column, pa.array(cells)).tolist(), len(at)]
            steps, ends = [], []

            def leave(walkers: list, key: object, cell: int) -> None:
                ends.extend((key, path, None, None, cell) for _, path, _ in walkers)

            for start, end in zip(bounds, bounds[1:]):
                key, cell = key_column[start].as_py(), int(cells[start])
                arrivals = []
                if (key, cell) != current:
                    if current is not None:
                        leave(waiting, *current)
                        waiting, here = here, []
                        if (key, cell) != (current[0], current[1] + PHASES):
                            leave(waiting, current[0], current[1] + PHASES)
                            waiting = []
                    current = (key, cell)
                    arrivals.append((start, cell, 0))
                # Both the waiting and what they find are in the order of time.
                found = 0
                for since, path, step in waiting:
                    i = bisect_left(at, since + span, start, end)
                    if i == end:
                        break
                    arrivals.append((i, path, step + 1))
                    found += 1
                waiting = waiting[found:]
                for i, met in groupby(arrivals, itemgetter(0)):
                    met = sorted(met, key=itemgetter(1))
                    _, path, step = met.pop()
                    ends.extend((key, other, path, step, None) for _, other, _ in met)
                    steps.append((i, path, step))
                    here.append((at[i], path, step))
            yield _steps(key_column, row_column, steps)
            if ends:
                yield _ends(key_column.type, row_column.type, ends)
        if current is not None:
            key, cell = current
            ends = [(key, path, None, None, cell) for _, path, _ in waiting]
            ends += [(key, path, None, None, cell + PHASES) for _, path, _ in here]
            yield _ends(key_column.type, row_column.type, ends)

    return run


def _steps(keys: pa.Array, rows: pa.Array, steps: list[tuple]) -> pa.RecordBatch:
    places = pa.array([s[0] for s in steps], pa.int64())
    longs = [pa.array([s[k] for s in steps], pa.int64()) for k in (1, 2)]
    longs += [pa.nulls(len(steps), pa.int64())] * 3
    return pa.RecordBatch.from_arrays([keys.take(places), rows.take(places), *longs], ["key", "row", *_LONGS])


def _ends(key_type: pa.DataType, row_type: pa.DataType, ends: list[tuple]) -> pa.RecordBatch:
    key, path, link, link_step, gone = zip(*ends)
    none = pa.nulls(len(ends), pa.int64())
    longs = [pa.array(v, pa.int64()) for v in (path, link, link_step, gone)]
    arrays = [pa.array(key, key_type), pa.nulls(len(ends), row_type), longs[0], none, *longs[1:]]
    return pa.RecordBatch.from_arrays(arrays, ["key", "row", *_LONGS])


def _true_paths(batches: Batches) -> Batches:
    """Ends ``(key, path, link, link_step, gone)`` by key and path, to ``(key, path, since)``."""
    current, wanted, since, exact = None, None, 0, False
    for batch in batches:
        keys = batch.column(0)
        rows = zip(*(batch.column(k).to_pylist() for k in range(5)))
        places, found, steps = [], [], []
        for i, (key, path, link, link_step, gone) in enumerate(rows):
            if current is None or key != current[0]:
                current, wanted, since, exact = (key,), path, 0, False
            if path == wanted if exact else path >= wanted:
                places.append(i)
                found.append(path)
                steps.append(since)
                exact = link is not None
                wanted, since = (link, link_step) if exact else (gone + 1, 0)
        longs = [pa.array(v, pa.int64()) for v in (found, steps)]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), *longs], ["key", "path", "since"])


def misses(
    requests: DataFrame, key: str, ts: str, row_id: str, ttl_days: int, written: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The ``row_id`` of every request that is a miss; of equal times the least id.

    Rows without key or time are never one.  ``written`` stores a table in the shared folder, since
    the paths are read twice.
    """
    width = ttl_days * MICROS_PER_DAY // PHASES
    at = F.unix_micros(ts)
    phase = F.pmod(F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width)), F.lit(PHASES))
    narrow = requests.select(
        F.col(key).alias("key"), phase.cast("int").alias("phase"), at.alias("at"), F.col(row_id).alias("row")
    ).where("key IS NOT NULL AND at IS NOT NULL")
    ordered = narrow.repartition("key", "phase").sortWithinPartitions("key", "phase", "at", "row")
    key_type, row_type = narrow.schema["key"].dataType, narrow.schema["row"].dataType
    longs = [T.StructField(n, T.LongType()) for n in _LONGS]
    walked = T.StructType([T.StructField("key", key_type), T.StructField("row", row_type), *longs])
    paths = written(ordered.mapInArrow(_paths(width), walked))
    ends = paths.where("step IS NULL").select("key", "path", "link", "link_step", "gone")
    chosen = T.StructType([T.StructField("key", key_type), longs[0], T.StructField("since", T.LongType())])
    true = ends.repartition("key").sortWithinPartitions("key", "path").mapInArrow(_true_paths, chosen)
    taken = paths.where("step IS NOT NULL").join(true, ["key", "path"]).where("step >= since")
    return taken.select(F.col("row").alias(row_id)).distinct()
