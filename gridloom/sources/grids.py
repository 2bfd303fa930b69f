"""Grids from tables, ranges and raw images, and where grids go."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from math import isqrt, log2, prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import Grid, StencilError

#: A piece of a raw file that is read at once has at most so many bytes, and on files of more at least so many.
MOST_BYTES, LEAST_BYTES = 1 << 20, 1 << 12
#: Pixels of a raw file that are put in order at once, and pixels that the driver takes at once.
BLOCK, PART = 1 << 16, 1 << 22
#: Keys of the views over ``events``, as expressions of the event's number.
EVENT_KEYS = {
    1: {"x": "event_id"},
    2: {"i": "event_id div 100", "j": "event_id % 100"},
    3: {"i": "event_id div 100", "j": "(event_id % 100) div 10", "k": "event_id % 10"},
}


def events(spark: SparkSession, sf_dir: str, dim: int = 2, value: str = "cast(round(value * 100) as bigint)") -> Grid:
    """The events' values in 1, 2 or 3 dimensions; only two columns are read, and the number of rows gives the shape."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = df.count()
    shape = {1: (n,), 2: (-(-n // 100), 100), 3: (-(-n // 100), 10, 10)}[dim]
    keys = EVENT_KEYS[dim]
    return Grid(df.selectExpr(*[f"{e} AS {k}" for k, e in keys.items()], f"{value} AS v"), list(keys), "v", shape)


def image(spark: SparkSession, sf_dir: str) -> Grid:
    return events(spark, sf_dir, 2, "cast(least(floor(value), 255) as double)")


def embeddings(spark: SparkSession, sf_dir: str) -> Grid:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n, wide = df.agg(F.count("*"), F.max(F.size("embedding"))).first()
    return Grid(df.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")), ["i", "j"], "v", (n, wide))


def _points(spark: SparkSession, shape: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """All points, by row-major number: no cross join, as many tasks as Spark likes."""
    df = spark.range(prod(shape))
    below = 1
    columns = []
    for k, n in reversed(list(zip(keys, shape))):
        columns.append(F.expr(f"(id div {below}) % {n}").alias(k))
        below *= n
    return df.select(*reversed(columns), "id")


def constant(spark: SparkSession, shape: Sequence[int], value: float = 1, kind: str = "float", keys: Sequence[str] = "ijklmn") -> Grid:
    keys = list(keys[: len(shape)])
    return Grid(_points(spark, shape, keys).withColumn("v", F.lit(value).cast(kind)), keys, "v", shape)


def random(spark: SparkSession, shape: Sequence[int], scale: float = 1, seed: int = 0, kind: str = "float", keys: Sequence[str] = "ijklmn") -> Grid:
    """Uniform values up to ``scale``, from each point's number and the seed: the same however Spark cuts the range."""
    keys = list(keys[: len(shape)])
    unit = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return Grid(_points(spark, shape, keys).withColumn("v", (unit * scale).cast(kind)), keys, "v", shape)


def from_array(spark: SparkSession, array, kind: str | None = None, keys: Sequence[str] = "ijklmn") -> Grid:
    """A small array that the driver holds."""
    import numpy as np

    array = np.asarray(array)
    kind = kind or {"int64": "bigint", "int32": "int", "float32": "float", "float64": "double"}[str(array.dtype)]
    keys = list(keys[: array.ndim])
    rows = [(*map(int, at), array[at].item()) for at in np.ndindex(*array.shape)]
    return Grid(spark.createDataFrame(rows, ", ".join([f"{k} bigint" for k in keys] + [f"v {kind}"])), keys, "v", array.shape)


def to_array(grid: Grid):
    """A grid as an array of the driver's, for small grids."""
    import numpy as np

    rows = grid.df.toPandas()
    out = np.zeros(grid.shape, rows[grid.value].dtype)
    out[tuple(rows[k].to_numpy() for k in grid.keys)] = rows[grid.value].to_numpy()
    return out


def _hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as the session's settings give it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _piece(length: int) -> int:
    """A divisor of a file's length, as near to 64 KB as there is, and at most 1 MB: pieces of equal length that fill the file."""
    small = (d for d in range(1, min(isqrt(length), MOST_BYTES) + 1) if length % d == 0)
    return min((d for s in small for d in (s, length // s) if d <= MOST_BYTES), key=lambda d: abs(log2(d) - 16), default=1)


def _padded(spark: SparkSession, path: str) -> str:
    """A copy of a raw file in the shared folder, filled up to whole pieces of 64 KB."""
    at, files = _hadoop_path(spark, path)
    copy = f"{shared_folder(spark)}/gridloom-padded-{uuid.uuid4().hex}.raw"
    to, shared = _hadoop_path(spark, copy)
    read, out = files.open(at), shared.create(to)
    try:
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
        out.write(bytearray(-files.getFileStatus(at).getLen() % (1 << 16)))
    finally:
        read.close()
        out.close()
    return copy


def read_raw(spark: SparkSession, path: str, width: int, height: int, transposed: bool = False) -> Grid:
    """A raw grayscale file, a byte a pixel, row by row: keys (row, column), or (column, row) if ``transposed``. A task reads
    about a megabyte of it; a file whose length has no divisor for a piece is copied first, and the copy stays. Bytes beyond the
    image are ignored, points beyond the file's end are left out."""
    at, files = _hadoop_path(spark, path)
    length = files.getFileStatus(at).getLen()
    pixels, piece = min(width * height, length), _piece(length)
    if piece < LEAST_BYTES < length:
        path, piece = _padded(spark, path), 1 << 16
    pieces = spark.sparkContext.newAPIHadoopFile(
        path.replace(",", r"{\,}"),  # Hadoop takes a bare comma for the end of a path
        "org.apache.spark.input.FixedLengthBinaryInputFormat",
        "org.apache.hadoop.io.LongWritable",  # the piece's number in the file
        "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(piece), "mapreduce.input.fileinputformat.split.maxsize": str(1 << 20)},
    )
    letters = F.split(F.decode("bytes", "ISO-8859-1"), "")  # once a piece: a substring for each pixel would copy the piece each time
    df = spark.createDataFrame(pieces, "piece bigint, bytes binary", verifySchema=False).where(F.col("piece") * piece < pixels)
    df = df.select("piece", F.posexplode(letters).alias("at", "letter")).select((F.col("piece") * piece + F.col("at")).alias("n"), F.ascii("letter").cast("float").alias("v")).where(F.col("n") < pixels)
    row, column = F.expr(f"n div {width}"), F.expr(f"n % {width}")
    keys, shape = ((column, row), (width, height)) if transposed else ((row, column), (height, width))
    return Grid(df.select(keys[0].alias("i"), keys[1].alias("j"), "v"), ["i", "j"], "v", shape)


def renormalise(result: Grid, before: Grid) -> Grid:
    """The result scaled to the mean of what it was made from, cut to whole numbers from 0 to 255."""
    means = result.df.agg(F.avg(result.value).alias("_after")).crossJoin(before.df.agg(F.avg(before.value).alias("_before")))  # one row each
    scaled = F.least(F.lit(255), F.greatest(F.lit(0), (F.col(result.value) * (F.col("_before") / F.col("_after"))).cast("int")))
    df = result.df.crossJoin(F.broadcast(means)).select(*result.keys, scaled.alias(result.value))
    return Grid(df, result.keys, result.value, result.shape)


def raw_rows(grid: Grid) -> DataFrame:
    """A grid of 0 to 255 as one binary row of pixels for each line: ``row, pixels``."""
    line, column = grid.keys
    letter = F.lpad(F.hex(F.col(grid.value).cast("long")), 2, "0")
    inner = F.array_sort(F.collect_list(F.struct(column, letter.alias("byte"))))
    return grid.df.groupBy(F.col(line).alias("row")).agg(F.unhex(F.array_join(F.transform(inner, lambda x: x["byte"]), "")).alias("pixels"))


def raw_blocks(grid: Grid) -> DataFrame:
    """A grid of 0 to 255 as binary rows of BLOCK pixels, counted along its lines: ``block, pixels``. A pixel is gathered as
    one number, its place in the block and its value."""
    line, column = (F.col(k).cast("long") for k in grid.keys)
    n = line * grid.shape[1] + column
    value = F.col(grid.value).cast("long")
    value = F.when(value.between(0, 255), value).otherwise(F.raise_error("a raw image holds values from 0 to 255"))
    points = grid.df.select(F.floor(n / BLOCK).alias("block"), (n % BLOCK * 256 + value).cast("int").alias("point"))
    points = points.groupBy("block").agg(F.sort_array(F.collect_list("point")).alias("points"))
    letters = F.array_join(F.transform("points", lambda x: F.char(x)), "")  # char takes the low byte
    return points.select("block", F.encode(letters, "ISO-8859-1").alias("pixels"))


def write_raw(grid: Grid, path: str) -> None:
    """One raw file, a byte a pixel, at a path of any of Spark's file systems. Executors order the pixels; their blocks pass
    through the driver, a part of PART bytes at a time."""
    if grid.dim != 2:
        raise StencilError("an image has two dimensions")
    parts = max(1, -(-prod(grid.shape) // PART))
    blocks = raw_blocks(grid).repartitionById(parts, F.floor(F.col("block") * BLOCK / PART).cast("int")).sortWithinPartitions("block")
    at, files = _hadoop_path(grid.df.sparkSession, path)
    out = files.create(at)
    waiting = bytearray()
    try:
        for row in blocks.toLocalIterator(prefetchPartitions=True):
            waiting += row["pixels"]
            if len(waiting) >= 1 << 20:  # a call of the JVM costs more than a block
                out.write(waiting)
                waiting = bytearray()
        out.write(waiting)
    finally:
        out.close()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as ``spark.checkpoint.dir`` names it; a session on one machine
    that names none gets a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise StencilError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            given = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        context.setCheckpointDir(given)
    return context.getCheckpointDir()


def trials(timings: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Benchmark lines: shape, name, average and sum of the trials' seconds. ``wanted`` names must have been timed; a
    name whose trials hold no time has an average of 0."""
    if wanted is not None:
        known = {r[0] for r in timings.select("name").distinct().where(F.col("name").isin(list(wanted))).collect()}
        if missing := sorted(set(wanted) - known):
            raise StencilError(f"no trials of {', '.join(missing)}")
        timings = timings.where(F.col("name").isin(list(wanted)))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return timings.groupBy("shape", "name").agg(zero(F.avg("seconds")).alias("avg"), zero(F.sum("seconds")).alias("sum"))
