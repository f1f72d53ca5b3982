"""The extension point for per-row functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_rows(df: DataFrame, fn: Callable[[dict], Iterable[dict] | dict | None], schema: str | T.StructType,
             on_error: str = "drop") -> DataFrame:
    """Apply ``fn(row dict)`` to every row and keep the rows it gives: none, one or many.

    A call that raises gives no row (``on_error="drop"``) or fails the job (``"raise"``). Rows come and
    go in Arrow batches, and each batch is let go before the next.
    """
    if on_error not in ("drop", "raise"):
        raise ValueError("on_error is 'drop' or 'raise'")
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = out.fieldNames()

    def call(row: dict) -> list[dict]:
        try:
            made = fn(row)
        except Exception:
            if on_error == "raise":
                raise
            return []
        if made is None:
            return []
        return [made] if isinstance(made, dict) else list(made)

    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Python values, so that whole numbers next to nulls stay whole
            made = [{name: new.get(name) for name in names} for row in batch.to_pylist() for new in call(row)]
            yield pa.RecordBatch.from_pylist(made, schema=kinds)

    return df.mapInArrow(run, out)
