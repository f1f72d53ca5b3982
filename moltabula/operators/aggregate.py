"""The extension point for a caller's own aggregate."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HELD_KEYS = 10_000  # groups with a state at the same time in a task


@dataclass(frozen=True)
class Aggregate:
    """``start()`` makes a state, ``add(state, row)`` takes a row, ``merge(a, b)`` joins two states, ``finish(state)`` gives the values of a group.

    ``add`` and ``merge`` return the new state and may change the old one. The order of rows and of merges is not fixed, so the result must not depend on it. States
    must pickle and stay small however many rows they stand for.
    """

    start: Callable[[], Any]
    add: Callable[[Any, dict], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], dict]


def aggregate(df: DataFrame, keys: list[str], values: list[str], own: Aggregate, schema: str | T.StructType,
              held_keys: int = HELD_KEYS) -> DataFrame:
    """The keys and what ``own`` gives for each group, null keys being groups like others; ``schema`` describes the values.

    Rows become states in the task that reads them, and only states are shuffled: a hot key is one state for each task, not its rows. A task with more than ``held_keys`` groups
    at a time passes its states on and goes on with new ones. Afterwards states come sorted by key, and one is held at a time.
    """
    if not keys:
        raise ValueError("an aggregate needs a key")
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = df.select(*keys, *values)
    key_types = T.StructType([rows.schema[k] for k in keys])
    partial = T.StructType([*key_types.fields, T.StructField("state", T.BinaryType())])
    result = T.StructType([*key_types.fields, *out.fields])
    key_kinds, result_kinds = to_arrow_schema(partial), to_arrow_schema(result)
    names = out.fieldNames()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}

        def states() -> pa.RecordBatch:
            made = [{**dict(zip(keys, key)), "state": pickle.dumps(state)} for key, state in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist(made, schema=key_kinds)

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key not in held and len(held) >= held_keys:
                    yield states()
                held[key] = own.add(held[key] if key in held else own.start(), row)
        if held:
            yield states()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, made = None, None, []

        def close() -> None:
            values_ = own.finish(state)
            made.append({**dict(zip(keys, current)), **{n: values_.get(n) for n in names}})

        for batch in batches:
            for row in batch.to_pylist():
                key, part = tuple(row[k] for k in keys), pickle.loads(row["state"])
                if key == current:
                    state = own.merge(state, part)
                    continue
                if current is not None:
                    close()
                current, state = key, part
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=result_kinds)
                made.clear()
        if current is not None:
            close()
            yield pa.RecordBatch.from_pylist(made, schema=result_kinds)

    states_ = rows.mapInArrow(gather, partial)
    return states_.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(finish, result)


def geometric_mean(value: str) -> Aggregate:
    """``geometric_mean, n`` of the positive numbers of a column."""
    import math

    def add(state: tuple, row: dict) -> tuple:
        x = row[value]
        return (state[0] + math.log(x), state[1] + 1) if x is not None and x > 0 else state

    return Aggregate(lambda: (0.0, 0), add, lambda a, b: (a[0] + b[0], a[1] + b[1]),
                     lambda s: {"geometric_mean": math.exp(s[0] / s[1]) if s[1] else None, "n": s[1]})


def greatest(n: int, order: str, carry: str) -> Aggregate:
    """``carried``: the values of ``carry`` in the rows with the ``n`` greatest ``order``, greatest first, ties to the lesser ``carry``. Null orders take no part."""

    def best(rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda r: (-r[0], r[1]))[:n]

    def add(state: list, row: dict) -> list:
        return state if row[order] is None or row[carry] is None else best([*state, (row[order], row[carry])])

    return Aggregate(list, add, lambda a, b: best([*a, *b]), lambda s: {"carried": [c for _, c in s]})
