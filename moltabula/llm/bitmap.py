"""A set of 64-bit hashes as a bitmap of fixed size: no member is missed, others pass by chance.

It saves shuffling rows that a later exact join would drop. Its size never grows with the data; a full one lets
everything pass, and results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.llm.common import arrow_map

BITS = 27  # 16 MB


def build(hashes: DataFrame, column: str) -> Broadcast:
    """Bitmap of a column of hashes, put together by Spark and sent to the executors."""
    words = hashes.select(
        F.expr(f"shiftrightunsigned(`{column}` & {(1 << BITS) - 1}L, 6)").alias("at"),
        F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("bit"))
    rows = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2^(BITS - 6) rows
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each signed 64-bit hash whether it may be in the set; its lowest bits count."""
    h = hashes.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (bits[(h >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (h & np.uint64(63))) & np.uint64(1) == 1


def keep(df: DataFrame, column: str, bitmap: Broadcast) -> DataFrame:
    """Rows whose hash may be in the set."""
    at = df.columns.index(column)

    def run(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(holds(bits, batch.column(at).to_numpy(zero_copy_only=False))))

    return arrow_map(df, run, df.schema, lambda: bitmap.value)
