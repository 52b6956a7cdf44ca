"""Vectors on an integer grid, exact squared distances, and tables that replace one another from round to round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import fresh_path

SCALE = 1024
# Grid coordinates stay below this, so that squared distances of up to 64 coordinates fit 64 bits.
LARGEST = 1 << 27


def sound(vector: str) -> Column:
    """Neither NULL nor with NULL or non-finite components."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.col(vector).isNotNull() & finite


def to_grid(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 32-bit integers; a coordinate whose distances would not fit a long is an error."""
    grid = np.floor(values * scale)
    if len(grid) and np.abs(grid).max(initial=0) >= LARGEST:
        raise ValueError(f"a component times {scale} is {LARGEST} or more: squared distances would not fit a long")
    return grid.astype("<i4")


def on_grid(vectors: DataFrame, columns: dict[str, Column], vector: str, scale: int = SCALE) -> DataFrame:
    """``columns`` and ``code``, the vector's grid coordinates as little-endian 32-bit integers. All vectors are sound and of one length."""
    rows = vectors.select(*[c.alias(name) for name, c in columns.items()], F.col(vector).cast("array<double>").alias("code"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["code binary"])

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                last = batch.column(batch.num_columns - 1)
                grid = to_grid(np.asarray(last.flatten(), np.float64), scale).reshape(batch.num_rows, -1)
                arrays = [*batch.columns[:-1], pa.array([row.tobytes() for row in grid], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return rows.mapInArrow(encode, schema)


def matrix(codes: pa.Array) -> np.ndarray:
    """Rows of grid coordinates as 64-bit integers."""
    values = codes.to_pylist()
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), -1).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices."""
    apart = a - b
    return np.einsum("nd,nd->n", apart, apart)


class Rounds:
    """Tables of which each replaces the one before.

    A table is dropped when the one made from it has been written whole, so a loop holds two of them at most however many rounds it
    makes, and a lost executor finds the input of its task in the shared folder.
    """

    def __init__(self, label: str):
        self.label, self.path = label, None

    def put(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, fresh_path(df.sparkSession, self.label)
        df.write.parquet(self.path)
        if before is not None:
            store, root = fs.FileSystem.from_uri(before)
            store.delete_dir(root)
        return df.sparkSession.read.schema(df.schema).parquet(self.path)
