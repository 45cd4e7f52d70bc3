"""Vectors as integer rows, and sums over all of them that leave a task as one row a cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True for a vector without null or non-finite entries, null or false otherwise."""
    return F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def scaled(vector: str, factor: int, most: int) -> Column:
    """floor(factor * c) of every entry c as double, held within -most and most."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * factor, F.lit(float(most))), F.lit(-float(most)))))


def matrix(column: pa.Array, width: int, fill: int = 0) -> np.ndarray:
    """Rows of a list column; a row shorter than ``width`` is filled up."""
    lengths = np.diff(at := np.asarray(column.offsets, dtype=np.int64))
    values = np.asarray(column.values, dtype=np.int64)[at[0] : at[-1]] if len(column) else np.zeros(0, np.int64)
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.full((len(column), width), fill, np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def summed(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], cells: int, integers: bool = False) -> np.ndarray:
    """The sum over all batches of ``df`` of what ``of`` gives for each, an array of ``cells`` values.

    A task sends one row for each cell that isn't zero, and Spark adds them up, so that the driver gets
    ``cells`` rows however many tasks there are.  With ``integers`` the sums are exact, of any size below 38 digits.
    """
    from decimal import Decimal

    kind, sql = (pa.decimal128(38, 0), "decimal(38,0)") if integers else (pa.float64(), "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, object if integers else np.float64)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        some = np.flatnonzero(total)
        values = pa.array([Decimal(int(v)) for v in total[some]] if integers else total[some], kind)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), values], ["cell", "value"])

    out = np.zeros(cells, object if integers else np.float64)
    for row in df.mapInArrow(run, f"cell long, value {sql}").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[row["cell"]] = int(row["value"]) if integers else row["value"]
    return out
