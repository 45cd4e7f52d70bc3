"""The first few distinct values of each group, as an aggregate that every task computes partly.

A task keeps, for each group, the ``k`` values with the least first sight so far.  That is exact, whatever the order of rows: a value
leaves only when ``k`` others were seen before its own first sight, and returns if it is seen earlier still.  So a task
sends at most ``k`` rows a group to the shuffle, however many distinct values there are; partial results of tasks, or of batches of
a stream, merge by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task holds before it sends what it has and starts again; the result is the same.
HELD = 200_000


def _least(table: pa.Table, group: list[str], value: str, order: str, k: int) -> pa.Table:
    """Each group's ``k`` values of ``table`` with the least ``order``, of equal ones the least value."""
    table = table.group_by([*group, value], use_threads=False).aggregate([(order, "min")]).rename_columns([*group, value, order])
    table = table.sort_by([(c, "ascending") for c in (*group, order, value)])
    if not table.num_rows:
        return table
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in group:
        column = table.column(c).combine_chunks()
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    at = np.arange(table.num_rows)
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    return table.filter(pa.array(rank < k))


def partly(rows: DataFrame, group: list[str], value: str, order: str, k: int) -> DataFrame:
    """(group, value, order): of each task at most ``k`` rows a group, among which are all that belong to the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now.filter(pc.is_valid(now.column(order)))
            held = _least(now if held is None else pa.concat_tables([held, now]), group, value, order, k)
            if held.num_rows > HELD:
                yield from held.combine_chunks().to_batches()
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()

    rows = rows.select(*group, value, order)
    return rows.mapInArrow(run, rows.schema)


def merged(rows: DataFrame, group: list[str], value: str, order: str, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` values of each group of partial results, numbered from 1 in ``rank``."""
    first = rows.groupBy(*group, value).agg(F.min(order).alias(order))
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(order, value))).where(F.col(rank) <= k)


def first_distinct(rows: DataFrame, group: list[str], value: str, order: str, k: int, rank: str = "rank") -> DataFrame:
    """(group, value, order, rank) of the first ``k`` distinct values of each group by ``order``."""
    return merged(partly(rows, group, value, order, k), group, value, order, k, rank)
