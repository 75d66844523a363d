"""One contract for applications that take a recording's rows in order (L3): a state at the start, and a step over a row.

The same fold runs over a table (`run_batch`) and in a stream (`run_stream`), and gives the same rows. Over a table Spark
partitions by recording and sorts, and a task walks its rows with the state of one recording in memory. In a stream the state is
kept for each recording between micro-batches; within one, rows wait only while an earlier one is missing, and what is still
missing at its end is lost, so that what a task holds is bounded by the disorder of one micro-batch, never by a recording.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

R = "recording_id"
ROWS, BYTES = 2000, 16 << 20


@dataclass(frozen=True)
class Fold:
    """An application: `step(state, row)` gives the next state and output rows (without the recording).

    A row holds the `order` columns and then `columns`. `save` and `load` turn the state into a row of `state` and back.
    `finish(state)` gives what a table's end adds; a stream has no end.
    """

    name: str
    order: tuple[str, ...]
    columns: tuple[str, ...]
    output: str
    state: str
    start: Callable[[], Any]
    step: Callable[[Any, tuple], tuple[Any, list[tuple]]]
    finish: Callable[[Any], list[tuple]] | None = None
    save: Callable[[Any], tuple] = tuple
    load: Callable[[tuple], Any] = tuple


#: Applications by name: each entry makes a fold from its parameters.
APPS: dict[str, Callable[..., Fold]] = {}


def register(make: Callable[..., Fold]) -> Callable[..., Fold]:
    """Enters an application under the name of the function that makes it."""
    APPS[make.__name__] = make
    return make


def _size(row: tuple) -> int:
    return sum(len(x) for x in row if isinstance(x, bytes))


def run_batch(fold: Fold, rows: DataFrame) -> DataFrame:
    """The fold over every recording of a table."""
    names = [R, *fold.order, *fold.columns]
    schema = T.StructType.fromDDL(f"{R} long, {fold.output}")
    arrow = to_arrow_schema(schema)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recording, state, out, held, begun = None, None, [], 0, False

        def end() -> list[tuple]:
            return [(recording, *g) for g in fold.finish(state)] if begun and fold.finish else []

        for b in batches:
            for rec, *row in zip(*(c.to_pylist() for c in b.columns)):
                if not begun or rec != recording:
                    out += end()
                    recording, state, begun = rec, fold.start(), True
                state, got = fold.step(state, tuple(row))
                for g in got:
                    out.append((rec, *g))
                    held += _size(g)
                    if len(out) >= ROWS or held >= BYTES:
                        yield batch(out)
                        out, held = [], 0
        yield batch(out + end())

    return rows.select(*names).repartition(R).sortWithinPartitions(R, *fold.order).mapInArrow(run, schema)


def run_stream(fold: Fold, stream: DataFrame) -> DataFrame:
    """The fold in a stream; its order is one whole-number column that counts a recording's rows from 0."""
    if len(fold.order) != 1:
        raise ValueError(f"{fold.name} has no single order column")
    names = [*fold.order, *fold.columns]
    schema = T.StructType.fromDDL(f"{R} long, {fold.output}")
    fields = T.StructType.fromDDL(fold.output).fieldNames()

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        expected, state = 0, None
        if group.exists:
            expected, *saved = group.get
            state = fold.load(tuple(saved))
        else:
            state = fold.start()
        waiting: list[tuple] = []
        arrived = 0

        def frame(out: list[tuple]) -> pd.DataFrame:
            cols = list(zip(*out)) or [()] * len(fields)
            return pd.DataFrame({R: pd.Series([key[0]] * len(out), dtype="int64")} | {f: pd.Series(list(c), dtype=object) for f, c in zip(fields, cols)})

        def take(row: tuple, out: list[tuple]) -> None:
            nonlocal expected, state
            state, got = fold.step(state, row)
            out += got
            expected = max(expected, row[0] + 1)

        for pdf in batches:
            out: list[tuple] = []
            for row in zip(*(pdf[c].tolist() for c in names)):
                row = tuple(None if isinstance(x, float) and x != x else x for x in row)
                if row[0] <= expected:
                    take(row, out)
                else:
                    heapq.heappush(waiting, (row[0], arrived, row))
                    arrived += 1
                while waiting and waiting[0][0] <= expected:
                    take(heapq.heappop(waiting)[2], out)
                if len(out) >= ROWS:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)
        out = []
        while waiting:  # what was missing is lost
            take(heapq.heappop(waiting)[2], out)
        if out:
            yield frame(out)
        group.update((expected, *fold.save(state)))

    return stream.select(R, *names).groupBy(R).applyInPandasWithState(step, schema, f"expected long, {fold.state}", "append", GroupStateTimeout.NoTimeout)


def source(spark: SparkSession, path: str, schema: T.StructType, files: int = 8) -> DataFrame:
    """A stream over a folder of Parquet files in the order they were written, `files` a micro-batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def staged(rows: DataFrame, order: str, path: str, pieces: int = 3, files: int = 4, key: str | None = R) -> DataFrame:
    """A table as a stream: written in `pieces` by `order`, one after the other, `files` files each, read two pieces a
    micro-batch at most. Within a piece the rows of one `key` are in one file (of none: dealt round). The table is computed once,
    into a folder beside `path`, and divided from there."""
    spark, schema = rows.sparkSession, rows.schema
    rows.write.parquet(f"{path}-whole")
    rows = spark.read.schema(schema).parquet(f"{path}-whole")
    # cut points by the whole table: a fixed number of quantiles
    cuts = rows.approxQuantile(order, [k / pieces for k in range(1, pieces)], 0.01) if pieces > 1 else []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = rows
        if low is not None:
            part = part.where(part[order] >= low)
        if high is not None:
            part = part.where(part[order] < high)
        (part.repartition(files, key) if key else part.repartition(files)).write.mode("append").parquet(path)
    return source(spark, path, schema, 2 * files if key else files)
