"""Shared plumbing of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that one output batch holds at most.
OUT_ROWS = 2000


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` that an operator's own outputs ``names`` do not replace (case-insensitively, as Spark resolves)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of ``df`` as c0, c1 and so on, so that no name of an operator's own can clash with theirs."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n.lower() not in {c.lower() for c in df.columns}]
    if missing:
        raise ValueError(f"columns {missing} are missing from {df.columns}")


def map_rows(df: DataFrame, inputs: list[str], outputs: list[T.StructField], kernel: Callable[[Iterator[tuple]], Iterator[tuple]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``outputs`` to every row with a Python kernel over Arrow batches, without a shuffle.

    ``kernel`` maps an iterator of input tuples to an iterator of output tuples of the same length and order.
    An output replaces an input column of the same name; ``drop`` names columns that are not passed on.
    """
    keep = without(df, [f.name for f in outputs] + list(drop))
    n, fields = len(keep), [df.schema[c] for c in keep] + outputs
    packed = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([T.StructField(f"k{i}", f.dataType, True) for i, f in enumerate(fields)])
    kinds = [to_arrow_type(f.dataType) for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                columns = [batch.column(n + i).to_pylist() for i in range(len(inputs))]
                made = list(kernel(zip(*columns, strict=True)))
                arrays = [pa.array([row[i] for row in made], type=kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + arrays, names=[f"k{i}" for i in range(len(fields))])

    return packed.mapInArrow(run, schema).toDF(*[f.name for f in fields])
