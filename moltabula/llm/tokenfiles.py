"""Token ids as flat binary files with 64-bit document offsets.

Each partition, in ascending ``doc_id`` order, makes two files in one folder:

* ``NAME.bin``: ids one after the other, little-endian, 16 bits wide where the vocabulary allows it, else 32;
* ``NAME.idx``: a header of four 64-bit numbers (magic, bytes of an id, documents, ids), then ``documents + 1``
  offsets, the document ids, and one byte each that is 0 where the id is null.

A manifest row for each partition is written by Spark's commit protocol; files of failed attempts are
in no manifest. A partition's base, the number of ids before it, is a prefix sum over the manifest.
Readers map the files into memory.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltabula.llm import bpe
from moltabula.llm.common import id_and_text, slices
from moltabula.scratch import scratch_path, written

MAGIC = 0x746F6B656E303031


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Write all documents and return the manifest: ``part, name, n_docs, n_tokens, base``.

    ``folder`` must be shared by all executors. Null text counts as empty, so each row has at least the end id. Rows
    without id come first; rows that repeat an id follow each other by text. Other columns are left out. An
    empty table has an empty manifest.
    """
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(tokenizer)
        kind = np.dtype("<u2" if max(encoder.vocab_size, end_id + 1) <= 1 << 16 else "<u4")
        store, root = _place(folder)
        name, sink, lengths, ids, present = f"part-{uuid.uuid4().hex}", None, [], [], []
        tail = np.array([end_id], kind).tobytes()
        for batch in batches:
            for part in slices(batch, 1):
                if sink is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(f"{root}/{name}.bin")
                for raw in encoder.encode_batch(part.column(1).to_pylist()):
                    sink.write(np.frombuffer(raw, np.uint32).astype(kind).tobytes() + tail)
                    lengths.append(len(raw) // 4 + 1)
                ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                present.append(part.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        with store.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(np.array([MAGIC, kind.itemsize, len(lengths), offsets[-1]], "<i8").tobytes())
            for section in (offsets, *ids, *present):
                index.write(section.tobytes())
        row = [[TaskContext.get().partitionId()], [name], [len(lengths)], [int(offsets[-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["part", "name", "n_docs", "n_tokens"])

    manifest = written(ordered.mapInArrow(write, "part long, name string, n_docs long, n_tokens long"), "manifest")
    # one row for each partition of the corpus, so one task can number them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _open(store: pafs.FileSystem, path: str) -> np.ndarray:
    """A file's bytes, mapped where the store is local."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with store.open_input_file(path) as source:
        return np.frombuffer(io.BytesIO(source.read()).getbuffer(), np.uint8)


def read_index(data: np.ndarray) -> tuple[np.dtype, np.ndarray, np.ndarray, np.ndarray]:
    """Kind of the ids, offsets, document ids and which of these are present."""
    magic, width, n_docs, _ = (int(x) for x in data[:32].view("<i8"))
    if magic != MAGIC:
        raise ValueError("not an index of token files")
    offsets = data[32:32 + 8 * (n_docs + 1)].view("<i8")
    at = 32 + 8 * (n_docs + 1)
    return np.dtype(f"<u{width}"), offsets, data[at:at + 8 * n_docs].view("<i8"), data[at + 8 * n_docs:at + 9 * n_docs]


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files of a manifest."""
    rows = manifest.select("name", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind, offsets, ids, present = read_index(_open(store, f"{root}/{name}.idx"))
                tokens = _open(store, f"{root}/{name}.bin").view(kind)
                for first in range(0, len(ids), 10_000):
                    last = min(len(ids), first + 10_000)
                    crcs = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[first:last], offsets[first + 1:last + 1])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array(ids[first:last]), pa.int64(), mask=np.array(present[first:last]) == 0),
                        pa.array(offsets[first:last] + base), pa.array(np.diff(offsets[first:last + 1])), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    # as many tasks as files: the manifest is small, the files are not
    return rows.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write to a new folder of the shared scratch space and read back."""
    folder = scratch_path(spark, "tokens")
    return read_token_files(written(write_token_files(docs, folder, tokenizer, end_id), "based"), folder)
