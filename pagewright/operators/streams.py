"""Rows of Arrow batches, for folds over sorted rows inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def listed(column: pa.Array) -> list:
    """A column's values, by way of NumPy where that keeps them: many times faster. A null number is no number, which is like nothing."""
    kind = column.type
    fast = pa.types.is_floating(kind) or pa.types.is_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_boolean(kind))
    return column.to_numpy(zero_copy_only=False).tolist() if fast else column.to_pylist()


def values(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple]:
    return zip(*(listed(batch.column(n)) for n in names), strict=True)


def sent(rows: list[tuple], page: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a page and what the schema names."""
    schema = schema.insert(0, pa.field("page", page))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=pa.types.is_floating(f.type)) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
