"""Per-key ordered results without a task per key.

Rows are range-partitioned on the composite (key, order columns), with bounds
from Spark's sampled quantiles, so a key that holds a third of all rows is split
over as many partitions as it needs. A partition is read batch by batch with the
state of its current (key, run) carried along, so a worker holds two batches
whatever the length of the partition. The partial states at the two ends of each
partition are stitched on the driver (two rows a partition); whole-key results
come from the partial states alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import cut, shuffle_parts

#: Rows a range partition should hold.
PER_PART = 150_000


def _differs(col: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls equal nulls, NaN equals NaN."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    ne = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(col.type):
        ne = pc.and_not(ne, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    nulls = pc.not_equal(a.is_null(), b.is_null())
    return pc.or_(ne, nulls).to_numpy(zero_copy_only=False).astype(bool)


class _Step:
    """One batch with the figures of its rows inside (partition, key)."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch, self.size = batch, batch.num_rows
        self.new_key = self.upto = self.less = self.runs = self.key_start = None
        self.prev: pa.Array = None
        self.carried_first: pa.Array = None


class _Walk:
    """State carried from batch to batch of one sorted partition."""

    def __init__(self, keys: Sequence[str], value: str, weight: str | None) -> None:
        self.cols, self.value, self.weight = [*keys, value], value, weight
        self.last: pa.RecordBatch | None = None
        self.first: pa.Array | None = None
        self.upto = self.less = self.runs = 0

    def step(self, batch: pa.RecordBatch) -> _Step:
        s, n = _Step(batch), batch.num_rows
        here = batch.select(self.cols)
        both = pa.Table.from_batches([here.slice(0, 1) if self.last is None else self.last, here]).combine_chunks()
        cols = {c: both.column(c).combine_chunks() if both.column(c).num_chunks != 1 else both.column(c).chunk(0) for c in self.cols}
        s.new_key = np.logical_or.reduce([_differs(cols[c]) for c in self.cols[:-1]]) if len(self.cols) > 1 else np.zeros(n, bool)
        if self.last is None:
            s.new_key[0] = True
        new_run = s.new_key | _differs(cols[self.value])
        at = np.arange(n)
        weight = np.ones(n, np.int64) if self.weight is None else batch.column(self.weight).to_numpy(zero_copy_only=False).astype(np.int64)
        total, run_no = np.cumsum(weight), np.cumsum(new_run)
        s.key_start = np.maximum.accumulate(np.where(s.new_key, at, -1))
        run_start = np.maximum.accumulate(np.where(new_run, at, -1))
        inside = s.key_start >= 0
        s.upto = np.where(inside, total - total[s.key_start] + weight[s.key_start], total + self.upto)
        s.runs = np.where(inside, run_no - run_no[s.key_start] + 1, run_no + self.runs)
        s.less = np.where(run_start >= 0, s.upto[run_start] - weight[run_start], self.less)
        before = cols[self.value].slice(0, n)
        s.prev = pc.if_else(pa.array(s.new_key), pa.scalar(None, before.type), before)
        s.carried_first = self.first
        self.first = here.column(self.value).take(pa.array([s.key_start[-1]])) if s.key_start[-1] >= 0 else self.first
        self.last = here.take(pa.array([n - 1]))
        self.upto, self.less, self.runs = int(s.upto[-1]), int(s.less[-1]), int(s.runs[-1])
        return s


def _ends(steps: Iterator[_Step]) -> Iterator[tuple[_Step, np.ndarray, bool]]:
    """Each step with the positions where a key ends, one batch late, and whether it is the last."""
    held = None
    for s in steps:
        if held is not None:
            yield held, np.flatnonzero(np.append(held.new_key[1:], s.new_key[0])), False
        held = s
    if held is not None:
        yield held, np.flatnonzero(np.append(held.new_key[1:], True)), True


def _firsts(s: _Step, value: str, at: np.ndarray) -> pa.Array:
    """The first value of the keys of the rows at these positions."""
    col = s.batch.column(value)
    out = [col[int(s.key_start[i])] if s.key_start[i] >= 0 else s.carried_first[0] for i in at]
    return pa.array([x.as_py() for x in out], col.type)


def _local_ranks(keys: Sequence[str], value: str, weight: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, first_done = _Walk(keys, value, weight), False
        for s, ends, last in _ends(walk.step(b) for b in batches if b.num_rows):
            edge = np.zeros(s.size, bool)
            if len(ends) and not first_done:
                edge[ends[0]] = first_done = True
            if last:
                edge[-1] = True
            kind = s.batch.column(value).type
            at = np.flatnonzero(edge)
            first = pc.replace_with_mask(pa.nulls(s.size, kind), pa.array(edge), _firsts(s, value, at)) if len(at) else pa.nulls(s.size, kind)
            arrays = [*s.batch.columns, pa.array(s.upto), pa.array(s.less), s.prev, pa.array(edge), first]
            yield pa.RecordBatch.from_arrays(arrays, [*s.batch.schema.names, "_upto", "_less", "_prev", "_edge", "_first"])

    return run


def _local_states(keys: Sequence[str], value: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(keys, value, None)
        for s, ends, _ in _ends(walk.step(b) for b in batches if b.num_rows):
            at = pa.array(ends)
            cols = [s.batch.column(c).take(at) for c in ("_pid", *keys)]
            arrays = [*cols, pa.array(s.upto[ends]), _firsts(s, value, ends), s.batch.column(value).take(at), pa.array(s.runs[ends])]
            yield pa.RecordBatch.from_arrays(arrays, ["_pid", *keys, "_n", "_first", "_last", "_values"])

    return run


def _ranged(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], rows: int | None) -> DataFrame:
    """Rows sorted inside range partitions of (key, value, ties); ``rows`` are counted where they are not given."""
    parts = shuffle_parts(df.sparkSession, df.count() if rows is None else rows, PER_PART)
    order = [F.col(c) for c in [*keys, value, *ties]]
    return df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()).sortWithinPartitions(*order)


def ordered_partials(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str] = (), rows: int | None = None, weight: str | None = None) -> DataFrame:
    """The rows with ``_upto`` and ``_less`` inside (partition, key), ``_prev``, and the states of both ends marked ``_edge``.

    The result is a cut table, so partition numbers stay what they were.
    """
    ranged = _ranged(df, keys, value, ties, rows)
    kind = ranged.schema[value].dataType
    more = [("_upto", T.LongType()), ("_less", T.LongType()), ("_prev", kind), ("_edge", T.BooleanType()), ("_first", kind)]
    schema = T.StructType(ranged.schema.fields + [T.StructField(c, t) for c, t in more])
    return cut(ranged.mapInArrow(_local_ranks(list(keys), value, weight), schema))


def _same(a, b) -> bool:
    return a == b or (a is None and b is None) or (a != a and b != b)


def boundary_states(partials: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (partition, key) at a partition's ends: what to add to its local figures.

    Only the marked rows, two a partition at most, reach the driver: a key that
    spans partitions is the last of one and the first of the next.
    """
    edges = partials.filter("_edge").select("_pid", *keys, "_upto", "_less", "_first", F.col(value).alias("_last")).collect()
    by_key: dict[tuple, list] = {}
    for r in edges:
        by_key.setdefault(tuple(r[k] for k in keys), []).append(r)
    out = []
    for key, parts in by_key.items():
        parts.sort(key=lambda r: r["_pid"])
        carry, run, last = 0, 0, None
        for i, r in enumerate(parts):
            joins = i > 0 and _same(r["_first"], last)
            same = run if joins else 0
            if i:
                out.append((r["_pid"], *key, carry, same, r["_first"], last))
            run = r["_upto"] - r["_less"] + (same if _same(r["_first"], r["_last"]) else 0)
            carry, last = carry + r["_upto"], r["_last"]
    kinds = {f.name: f.dataType for f in partials.schema.fields}
    schema = T.StructType(
        [T.StructField("_pid", T.IntegerType())]
        + [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField(c, T.LongType()) for c in ("_carry", "_same")]
        + [T.StructField(c, kinds[value]) for c in ("_run", "_before")]
    )
    return partials.sparkSession.createDataFrame(out, schema)


def stitched_ranks(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str] = (), rows: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact ranks of every row inside its key.

    Adds ``row_no`` (1-based, by value then ties), ``n_less`` (rows of the key
    with a smaller value) and ``previous`` (value of the row before, null at the
    first). With ``weight`` a row stands for that many equal ones, and both are
    counted in these. Null keys and null values are groups of their own, nulls
    sort first; an empty input gives an empty result. Columns of ``df`` other
    than keys, value and ties pass through; their names must not start with an
    underscore. ``df`` is read for its bounds and for its rows, and once more
    where ``rows`` is not given: pass a scan or a cut table.
    """
    part = ordered_partials(df, keys, value, ties, rows, weight)
    states = boundary_states(part, keys, value)
    p, s = part.alias("p"), F.broadcast(states).alias("s")  # one row a partition at most
    cond = F.col("p._pid") == F.col("s._pid")
    for k in keys:
        cond &= F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}"))
    carry = F.coalesce(F.col("s._carry"), F.lit(0))
    carried_run = F.col("s._pid").isNotNull() & F.col(f"p.{value}").eqNullSafe(F.col("s._run"))
    starts = (F.col("p._upto") == (F.lit(1) if weight is None else F.col(f"p.{weight}"))) & F.col("s._pid").isNotNull()
    return p.join(s, cond, "left").select(
        *[F.col(f"p.{c}").alias(c) for c in df.columns],
        (F.col("p._upto") + carry).alias("row_no"),
        (F.col("p._less") + carry - F.when(carried_run, F.col("s._same")).otherwise(0)).alias("n_less"),
        F.when(starts, F.col("s._before")).otherwise(F.col("p._prev")).alias("previous"),
    )


def key_totals(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Rows, first and last value in order and number of distinct values per key.

    A task sends one state per key it holds, so a heavy key contributes one state
    per partition it spans and never its rows; states of one key are stitched in
    the order of their partitions, a value that goes on over a bound counting
    once. Nulls are the smallest value. An empty input gives an empty result.
    """
    ranged = _ranged(df.select(*dict.fromkeys([*keys, value, *ties])), keys, value, ties, rows)
    kind = ranged.schema[value].dataType
    schema = T.StructType(
        [T.StructField("_pid", T.IntegerType())]
        + [ranged.schema[k] for k in keys]
        + [T.StructField("_n", T.LongType()), T.StructField("_first", kind), T.StructField("_last", kind), T.StructField("_values", T.LongType())]
    )
    states = ranged.mapInArrow(_local_states(list(keys), value), schema)
    along = Window.partitionBy(*keys).orderBy("_pid")
    goes_on = (F.row_number().over(along) > 1) & F.lag("_last").over(along).eqNullSafe(F.col("_first"))
    return states.withColumn("_on", goes_on.cast("int")).groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.min_by("_first", "_pid").alias("first_value"),
        F.max_by("_last", "_pid").alias("last_value"),
        (F.sum("_values") - F.sum("_on")).alias("n_values"),
    )
