"""Token-id output: flat files of unsigned integers with 64-bit document offsets, read by memory map.

A data set is a folder of shards. ``shard-NNNNN-A.ids`` holds the ids of a range of documents, in ascending ``doc_id``
order, as little-endian unsigned integers of the narrowest type that holds the vocabulary. ``shard-NNNNN-A.idx`` holds
int64 document ids, then int64 starts of these documents in the shard, with one more start for the end. The shards'
places in the whole (``base``) are prefix sums over their token counts. A shard's name holds its task attempt's number:
a task that runs again writes files of its own, and the table of shards names those of the attempt that counted.

Ascending ``doc_id``; a null id comes first. Ties: rows of equal id go by a hash of their text and then the text, across
shards too; equal rows are alike. Null or empty text: the end id alone. A very long text is encoded by itself, and its
ids are held by its task. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import cut, documents, scratch_path, table
from gridloom.llm.tokenizing import encoder, tokenizer_path

END_ID = 1
SHARDS = "part int, path string, dtype string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
NO_ID = -(2**63)


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the shards and returns one row for each with its ``base``, the ids of all documents before it."""
    spark = docs.sparkSession
    ordered = documents(docs).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        name = f"{folder}/shard-{part:05d}-{TaskContext.get().taskAttemptId()}"
        store, at = pafs.FileSystem.from_uri(name)
        store.create_dir(os.path.dirname(at))
        end = np.array([end_id], encode.dtype).tobytes()
        wide = encode.dtype.itemsize
        doc_ids, starts = [], [0]
        with store.open_output_stream(f"{at}.ids") as out:
            for batch in batches:
                for piece in cut(batch):
                    doc_ids += [NO_ID if x is None else x for x in piece.column(0).to_pylist()]
                    for ids in encode.many(piece.column(1).to_pylist()):
                        out.write(ids + end)
                        starts.append(starts[-1] + len(ids) // wide + 1)
        if not doc_ids:
            store.delete_file(f"{at}.ids")
            return
        with store.open_output_stream(f"{at}.idx") as out:
            out.write(np.array(doc_ids, "<i8").tobytes() + np.array(starts, "<i8").tobytes())
        row = (part, name, encode.dtype.str, len(doc_ids), starts[-1])
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in SHARDS.split(", ")])

    shards = spark.createDataFrame(ordered.mapInArrow(run, SHARDS).collect(), SHARDS)  # one small row a shard
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def mapped(store: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file's values, by memory map where the store is a file system."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    return np.frombuffer(store.open_input_file(path).readall(), dtype)


def read(shards: DataFrame) -> DataFrame:
    """Each document of the files: ``doc_id, start, n_tokens, ids_crc32``."""
    n = max(1, shards.count())

    def run(batches):
        for batch in batches:
            for name, dtype, base in zip(*(batch.column(c).to_pylist() for c in ("path", "dtype", "base"))):
                store, at = pafs.FileSystem.from_uri(name)
                index, ids = mapped(store, f"{at}.idx", "<i8"), mapped(store, f"{at}.ids", dtype)
                many = len(index) // 2
                doc_ids, starts = index[:many], index[many:]
                for lo in range(0, many, 4096):
                    hi = min(lo + 4096, many)
                    crc = [zlib.crc32(ids[starts[i] : starts[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    columns = [doc_ids[lo:hi], base + starts[lo:hi], np.diff(starts[lo : hi + 1]), np.array(crc, np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, mask=doc_ids[lo:hi] == NO_ID if k == 0 else None) for k, c in enumerate(columns)], names=[x.split()[0] for x in ROWS.split(", ")])

    return shards.repartition(n, "part").mapInArrow(run, ROWS)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), tokenizer_path("word_bpe_49k.json"))
    return read(shards)
