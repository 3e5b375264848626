"""Places in a distributed order: range-sort, running sums within tasks, sums of the tasks before.

No group is gathered in one task: the order is cut into ranges by what it sorts on, and a last sorting column of row
numbers lets even a group of equal rows be cut anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelore.llm.common import discard, stage

TIE = "_tie"


def group_key(value: Column, nulls: str) -> Column:
    """A string without nulls that sorts by code point, with null ``first`` or ``last``."""
    null, other = {"first": ("0", "1"), "last": ("1", "0")}[nulls]
    return F.when(value.isNull(), F.lit(null)).otherwise(F.concat(F.lit(other), value))


def _running(batches: Iterator[pa.RecordBatch], group: str, amount: str) -> Iterator[pa.RecordBatch]:
    part, open_group, so_far = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        codes = b.column(group).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        v = b.column(amount).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(v) - v
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        lengths = np.diff(np.append(starts, len(v)))
        local = before - np.repeat(before[starts], lengths)
        if b.column(group)[0].as_py() == open_group:
            local[: lengths[0]] += so_far
        open_group, so_far = b.column(group)[-1].as_py(), int(local[-1] + v[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(local)], names=[*b.schema.names, "part", "local"])


def running_sums(rows: DataFrame, group: str, order: list[str], amount: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with part and local, and the table of part, group, base, total.

    ``base + local`` is the sum of ``amount`` over the rows before this one in its group, by ``order``; ``total`` the
    group's sum. ``rows`` is a staged table (it is read twice, for the ranges and for the sort); rows that are equal by
    ``order`` must be interchangeable. The result is staged, the table has a row for each group and range at most.
    """
    tied = rows.withColumn(TIE, F.monotonically_increasing_id())
    keys = [group, *order, TIE]
    cut = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(TIE)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, local long"
    out = stage(cut.mapInArrow(lambda it: _running(it, group, amount), schema), "ordered")
    here = out.groupBy("part", group).agg(F.sum(amount).alias("here"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = here.select("part", group, F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("base"), F.sum("here").over(Window.partitionBy(group)).alias("total"))
    return out, stage(bases, "bases")


def group_places(bases: DataFrame, group: str) -> DataFrame:
    """Every group of :func:`running_sums` with its total and its place (from 0) among the groups, staged.

    A group is counted in the range where it begins, so only the table of ranges (one row for each) is in one task.
    """
    groups = stage(bases.groupBy(group).agg(F.max("total").alias("total"), F.min("part").alias("first")), "groups")
    begun = groups.groupBy("first").agg(F.count("*").alias("n"))
    begun = begun.select("first", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("first").orderBy(group)) - 1
    placed = stage(groups.withColumn("within", within).join(begun, "first").select(group, "total", (F.col("earlier") + F.col("within")).alias("place")), "places")
    discard(groups)
    return placed
