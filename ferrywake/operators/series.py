"""Bounded pieces of long time series.

A source (bus, vessel, gauge) may hold a third of all rows, so no operator here windows over a
whole source. A series is cut into *chunks* of fixed duration; every row goes to its own chunk and,
when it lies within the halo of a neighbouring chunk, to that one too. A task then sees at most
``chunk + halo`` seconds of one source, a number of rows bounded by the source's reporting rate, since
copies of one reading are collapsed before (by a map-side combined aggregate).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere of 6,371,000 m; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))  # least() would turn a null into 1


def np_haversine(lat1, lon1, lat2, lon2):
    """The same for numpy arrays."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def floor_div(value: Column, by: int) -> Column:
    """Integer division towards minus infinity (times before 1970 are negative)."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def with_halo(df: DataFrame, us: str, chunk_us: int, before_us: int, after_us: int = 0, chunk: str = "chunk", core: str = "core") -> DataFrame:
    """Every row once per chunk that needs it: its own (``core`` true) and those whose halo it lies in."""
    first, last = floor_div(F.col(us) - F.lit(after_us), chunk_us), floor_div(F.col(us) + F.lit(before_us), chunk_us)
    return df.withColumn(chunk, F.explode(F.sequence(first, last))).withColumn(core, F.col(chunk) == floor_div(F.col(us), chunk_us))


def map_whole_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str, block_rows: int = 100_000) -> DataFrame:
    """Hash-partition by ``keys``, sort by ``keys + order``, and hand ``fn`` Arrow tables that hold whole groups only.

    ``fn`` works on many groups at once with vectorised code; there is no Python call per group or row.
    Memory is bounded by ``block_rows`` plus one group.
    """
    key_names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows and (out := fn(t.combine_chunks())) is not None and out.num_rows:
                yield from out.to_batches(max_chunksize=20_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < block_rows:
                continue
            t = pa.concat_tables(held)
            cut = last_group_start(t, key_names)
            if cut:
                yield from flush(t.slice(0, cut))
                held, rows = [t.slice(cut)], t.num_rows - cut
        if held:
            yield from flush(pa.concat_tables(held))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def scan_in_order(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple], outputs: list[tuple[str, pa.DataType]], columns: list[str]) -> DataFrame:
    """Fold each group in order with a small state, for recursions that windows can't express.

    ``step(state, row)`` returns (state, output values); ``row`` is a dict of ``columns``. Rows stream through in Arrow batches and only the state is held, so
    memory doesn't grow with a group; the result has ``keys``, ``order``, ``columns`` and the ``outputs``.
    """
    names = list(dict.fromkeys([*keys, *order, *columns]))
    sql = {pa.float64(): "double", pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{n}` {sql[t]}" for n, t in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for values in zip(*[b.column(c).to_pylist() for c in names]):
                key = values[: len(keys)]
                if state is None or key != last:
                    state, last = start(), key
                state, result = step(state, dict(zip(names, values)))
                out.append(result)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[pa.array(c, t) for c, (_, t) in zip(zip(*out), outputs)]], [*names, *[n for n, _ in outputs]])

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def last_group_start(t: pa.Table, keys: list[str]) -> int:
    """Row at which the last run of equal keys begins; 0 if all rows are one group."""
    n = t.num_rows
    same = np.ones(n, bool)
    for k in keys:
        column = t.column(k)
        same &= np.asarray(pc.equal(column, column[n - 1]).fill_null(False))
    different = np.flatnonzero(~same)
    return int(different[-1]) + 1 if len(different) else 0


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """True on the first row of each run of equal keys."""
    n = t.num_rows
    start = np.zeros(n, bool)
    if n:
        start[0] = True
    for k in keys:
        column = t.column(k).combine_chunks() if isinstance(t.column(k), pa.ChunkedArray) else t.column(k)
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            column = column.dictionary_encode().indices
        v = column.to_numpy(zero_copy_only=False)
        start[1:] |= v[1:] != v[:-1]
    return start
