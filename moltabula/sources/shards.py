"""Shards looked over before they are merged, and removed after."""

from __future__ import annotations

import io
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltabula.scratch import written
from moltabula.sources.resolve import path_exists

EMPTY_BYTES = 16 << 20  # a file without rows is a footer only, and not that long
STATES = "shard string, state string, files bigint, rows bigint"


def _path(spark: SparkSession, name: str) -> tuple[JavaObject, JavaObject]:
    """File system and full path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(path)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the content of each file is a table without rows."""
    for batch in batches:
        empty = []
        for content in batch.column("content"):
            try:
                empty.append(pq.ParquetFile(io.BytesIO(content.as_py())).metadata.num_rows == 0)
            except Exception:  # whatever is wrong with it, it is no table
                empty.append(False)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(empty, pa.bool_())], ["file", "empty"])


def _per_file(spark: SparkSession, folder: str, schema: T.StructType, deep: bool) -> DataFrame:
    """``shard, file, length, rows, whole, empty``: what is known of every file below a folder."""
    file = F.col("_metadata.file_path").alias("file")
    root = _path(spark, folder)[1].toString().rstrip("/")
    shard = F.substring_index(F.substring("path", len(root) + 2, 1 << 20), "/", 1)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = listing.select("path", shard.alias("shard"), file, "length")
    # scans pass over files of no length, which the list of a plan's inputs still has
    names = spark.createDataFrame([(unquote(f).replace(":///", ":/", 1),) for f in listing.inputFiles()], "path string")
    lost = names.join(files.select("path"), "path", "left_anti")
    files = files.unionByName(lost.select("path", shard.alias("shard"), F.col("path").alias("file"), F.lit(0).cast("bigint").alias("length"))).drop("path")
    tolerant = (
        spark.read.schema(schema).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True).parquet(folder)
    )
    # without a column only footers are read
    known = files.join(tolerant.select(file).groupBy("file").agg(F.count(F.lit(1)).alias("rows")), "file", "left")
    if deep:
        content = F.xxhash64(*[F.col(f.name) for f in schema.fields]).alias("h")
        read = tolerant.select(file, content).groupBy("file").agg(F.count(F.lit(1)).alias("read"), F.bit_xor("h").alias("content"))
        known = known.join(read, "file", "left")  # the content is stored as well, or it would not be read
    known = written(known, "shard-files")
    whole = F.coalesce(F.col("read"), F.lit(0)) == F.col("rows") if deep else F.lit(True)
    silent = known.filter(F.col("rows").isNull() & (F.col("length") <= EMPTY_BYTES)).select("file")
    short = listing.filter(F.col("length") <= EMPTY_BYTES).select(file, "content")
    empty = short.join(silent, "file", "left_semi").mapInArrow(_footers, "file string, empty boolean")
    return known.join(empty, "file", "left").withColumn("whole", whole)


def shard_states(spark: SparkSession, folder: str, schema: T.StructType, expected: list[str] | None = None,
                 deep: bool = True) -> DataFrame:
    """``shard, state, files, rows`` for every entry of a folder and every ``expected`` name.

    A shard is ``good`` if all of its files can be read and some hold rows, ``empty`` if all can be read and none does, ``broken`` if one of them can
    not be read, and ``missing`` if it is expected and has no file; ``rows`` is what the readable footers tell. ``deep`` also reads the columns of ``schema`` of
    every row, so that damage behind a sound footer, or another type of a column, is found. A folder that does not exist has no shard. Names
    that Spark hides (``_x``, ``.x``) are none.
    """
    found = spark.createDataFrame([], STATES)
    if path_exists(spark, folder):
        bad = ~F.coalesce(F.when(F.col("rows").isNull(), F.col("empty")).otherwise(F.col("whole")), F.lit(False))
        per_shard = _per_file(spark, folder, schema, deep).groupBy("shard").agg(
            F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max(bad).alias("_bad"))
        state = F.when(F.col("_bad"), "broken").when(F.col("rows") == 0, "empty").otherwise("good")
        found = per_shard.select("shard", state.alias("state"), "files", "rows")
    if expected:
        names = spark.createDataFrame([(e,) for e in set(expected)], "shard string")
        absent = names.join(found, "shard", "left_anti")
        none = F.lit(0).cast("bigint")
        found = found.unionByName(absent.select("shard", F.lit("missing").alias("state"), none.alias("files"), none.alias("rows")))
    return found


def merge_good(spark: SparkSession, folder: str, schema: T.StructType, target: str, index: str = "index",
               expected: list[str] | None = None) -> DataFrame:
    """Write the rows of all good shards, in the order of their index and without it, to a new ``target``; the stored states come back.

    An existing target is an error, never overwritten: it may be all that is left of removed shards. So is a folder where no shard can be read. A shard
    that breaks after it was looked over fails the merge.
    """
    if path_exists(spark, target):
        raise FileExistsError(f"{target} exists")
    states = written(shard_states(spark, folder, schema, expected), "shard-states")
    usable = [r.shard for r in states.filter("state = 'good'").select("shard").toLocalIterator()]
    if usable:
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{folder.rstrip('/')}/{name}" for name in usable])
    elif states.filter("state = 'empty'").isEmpty():
        raise ValueError(f"no shard of {folder} could be read")
    else:
        rows = spark.createDataFrame([], schema)
    rows.orderBy(index).drop(index).write.mode("error").parquet(target)
    return states


def remove_merged(spark: SparkSession, folder: str, states: DataFrame, target: str) -> int:
    """Remove the good and empty shards of a merge, once its target is committed and holds all of their rows; the number removed.

    Broken shards stay. A call that was cut short can be repeated.
    """
    if not path_exists(spark, f"{target.rstrip('/')}/_SUCCESS"):
        raise RuntimeError(f"{target} is not committed")
    want = states.filter("state = 'good'").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    have = spark.read.parquet(target).count()
    if have != want:
        raise RuntimeError(f"{target} holds {have} rows, the shards {want}")
    removed = 0
    for row in states.filter("state IN ('good', 'empty')").select("shard").toLocalIterator():
        system, path = _path(spark, f"{folder.rstrip('/')}/{row.shard}")
        removed += bool(system.delete(path, True))
    return removed
