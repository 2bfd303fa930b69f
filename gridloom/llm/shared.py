"""Helpers for the training-data operators: shared scratch storage, Arrow text buffers, word and shingle hashes.

Words are maximal runs of bytes other than space and the five ASCII controls 9 to 13; in UTF-8 none of these
bytes is part of a longer character, so the words of the bytes are the words of the text.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy block may hold. A longer text is a block of its own; a block's temporaries take about 15
#: times its bytes (bit masks, and five 64-bit numbers a word), so a text of 50 MB needs some 750 MB of its worker.
BLOCK_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 4096
U64 = np.uint64


def documents(docs: DataFrame, key: str = "doc_id", *more: str) -> DataFrame:
    """``key`` and ``text`` (null: empty) alone, whatever else the table holds."""
    return docs.select(F.col(f"`{key}`").cast("long").alias(key), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in more])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_uri(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's ``spark.checkpoint.dir`` names it."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="gridloom-")  # one machine: its own folder is shared
        spark.sparkContext.setCheckpointDir(given)
        given = spark.sparkContext.getCheckpointDir()
    return given.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_uri(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: cuts the lineage, and no lost executor takes it along."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    free_shuffles(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "written_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


# ---- Arrow -----------------------------------------------------------------------------------------------------


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` turns a batch into column dicts; batches are cut so that each holds about BLOCK_BYTES of text."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for part in cut(batch):
                for cols in fn(part):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in (cols[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of ``column``; a longer text is a slice of its own."""
    if column not in batch.schema.names or not batch.num_rows:
        yield batch
        return
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where its rows start in them (one more than rows)."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


# ---- hashes ----------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit words that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LANE, GRAM = (U64(x) | U64(1) for x in stream(2, 2))
GRAM = int(GRAM)


def word_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes a step, each step a bijection of the state, so no structure of a word's
    letters cancels out; words of more than LONG_WORD bytes by BLAKE2b."""
    length = end - start
    eights = np.ndarray(len(raw) + 1, "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))
    code = mix(length.astype(np.uint64) * LANE)
    short = np.flatnonzero(length <= LONG_WORD)
    at, left = start[short], length[short]
    while len(short):
        lane = eights[at] & np.where(left >= 8, ~U64(0), (U64(1) << (np.minimum(left, 7).astype(np.uint64) * U64(8))) - U64(1))
        code[short] = mix((code[short] ^ lane) * LANE)
        on = left > 8
        short, at, left = short[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(length > LONG_WORD):
        code[i] = int.from_bytes(blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return code


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), U64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a block: ``start`` and ``end`` in the bytes, ``doc`` (row in the block), ``code`` (64-bit hash)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, self.rows = raw, offsets, len(offsets) - 1
        n = len(raw)
        inside = np.append(~IS_SPACE[raw], False)
        edge = np.zeros(n + 1, bool)  # where a row starts or the block ends
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:]
        last = inside[:-1] & (~inside[1:] | edge[1:])
        inside, first = inside[:-1], first[:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.rows) if len(self.doc) else np.zeros(self.rows, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # of each row, its first word
        self.code = word_codes(raw, self.start, self.end)

    def spelled(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by one space, and where each starts (one more than words)."""
        size = self.end - self.start + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.full(int(begin[-1]), 32, np.uint8)
        here = np.repeat(self.start - begin[:-1], size) + np.arange(len(out))
        inside = np.ones(len(out), bool)
        inside[begin[1:] - 1] = False
        out[inside] = self.raw[here[inside]]
        return out.tobytes(), begin

    def places(self, k: int) -> np.ndarray:
        """Where runs of ``k`` words within one row start."""
        n = len(self.code)
        return np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of ``k`` words within one row start, and their hashes; equal runs have equal hashes anywhere."""
        n = len(self.code)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        base = GRAM
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code * powers(base, n))])
            hashes = mix((sums[k:] - sums[:-k]) * powers(pow(base, -1, 2**64), n - k + 1) + U64(k))
        where = self.places(k)
        return where, hashes[where]

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of every shingle of ``k`` words; a row of fewer words has one shingle, a row of none none."""
        where, hashes = self.grams(k)
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        rows, codes = [self.doc[where]], [hashes]
        for r in short:
            words = self.code[self.first[r] : self.first[r + 1]]
            with np.errstate(over="ignore"):
                codes.append(mix(np.add.reduce(words * powers(GRAM | 1, len(words)), keepdims=True) + U64(len(words))))
            rows.append(np.array([r]))
        return np.concatenate(rows), np.concatenate(codes)


def word_set(text: str, k: int = 5) -> set[bytes]:
    """The exact shingles of one text, for verification."""
    words = text.encode().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


_freed = 0.0


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more; else they wait for the
    driver's next full collection, and a job of several phases holds the disk of all of them. Phases of a moment leave
    little, so they share a collection."""
    global _freed
    if time.monotonic() - _freed > 5:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _freed = time.monotonic()
