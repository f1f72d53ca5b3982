"""SHA-256 of long ordered lists, without a task that holds a list."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.scratch import written

CHUNK_BYTES = 1 << 18


def list_digests(df: DataFrame, key: str, value: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``key, sha256``: lowercase hex of the values of each binary key, in ascending order and joined by commas.

    Rows are dealt out by ranges of key and value, so one hot key lies in many tasks. A task streams its share: a key that starts and ends
    inside it is finished there, others leave pieces of joined text of about ``chunk_bytes`` that a second pass streams through the hash in order.
    Null keys and values are left out; repeated values are repeated in the list.
    """
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value")).where("key is not null and value is not null")
    ranged = rows.repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    value_type = rows.schema["value"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = current = start = None
        parts: list[str] = []
        size, cut = 0, False
        out: list[tuple] = []

        def leave(whole: bool) -> None:
            text = ",".join(parts)
            done = whole and not cut and current != first
            out.append((current, start, None if done else text, hashlib.sha256(text.encode()).hexdigest() if done else None))

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != current:
                    if current is not None:
                        leave(True)
                    first = k if first is None else first
                    current, start, parts, size, cut = k, v, [], 0, False
                elif size > chunk_bytes:
                    leave(False)
                    start, parts, size, cut = v, [], 0, True
                text = str(v)
                parts.append(text)
                size += len(text) + 1
            if out:
                yield _piece_rows(out, batch.schema.field(1).type)
                out = []
        if current is not None:
            leave(False)
            yield _piece_rows(out, batch.schema.field(1).type)

    cut = ranged.mapInArrow(pieces, f"key binary, start {value_type}, text string, sha256 string")
    cut = written(cut, "pieces")
    rest = cut.where("text is not null").select("key", "start", "text").repartition("key").sortWithinPartitions("key", "start")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != current:
                    if current is not None:
                        done.append((current, state.hexdigest()))
                    current, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield _digest_rows(done)
        if current is not None:
            yield _digest_rows([(current, state.hexdigest())])

    return cut.where("sha256 is not null").select("key", "sha256").unionByName(rest.mapInArrow(joined, "key binary, sha256 string"))


def _piece_rows(rows: list[tuple], value_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.binary(), value_type, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["key", "start", "text", "sha256"])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "sha256"])
