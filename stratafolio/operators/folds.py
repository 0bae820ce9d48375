"""Folds over the rows of a group in order, for rules whose state a window can't hold (a stack, what is taken, a running box)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def folded(rows: DataFrame, group: list[str], order: list[str | Column], columns: list[str], start: Callable[[], Any], step: Callable[..., Any], name: str, kind: str) -> DataFrame:
    """Adds ``name`` (a SQL type ``kind``): ``step(state, *columns)`` of each row, in order, with a fresh ``start()`` for each group.

    Partitions are sorted by group and order and read in Arrow batches; a task holds one group's state and one batch, so a group
    may be of any size, though it is one task's."""
    schema = StructType([*rows.schema.fields, StructField(name, _parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, arrow = object(), None, None
        for batch in batches:
            out = []
            keys = zip(*[batch.column(g).to_pylist() for g in group], strict=True)
            values = zip(*[batch.column(c).to_pylist() for c in columns], strict=True)
            for k, v in zip(keys, values, strict=True):
                if k != key:
                    key, state = k, start()
                out.append(step(state, *v))
            arrow = arrow or {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}[kind]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, name])

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
