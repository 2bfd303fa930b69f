"""Best-fit packing: bulk-synchronous best-fit of token pieces into sequences of a fixed length.

A document's tokens end with an end id; a document longer than a sequence is cut into full pieces, of which the first
may be shorter. Pieces of one length differ in nothing but their rank, and so do sequences with gaps of one size: both
are run-length coded, as runs of ranks, and what the super-steps sort, shuffle and sweep are such runs. Their number is
bounded by the width, some thousand rows however large the corpus is.

A super-step is one job. Runs of pieces and of gaps are range-sorted by size and each range is swept by a task of its own:
going up in size, a gap meets the longest piece that fits it and that no smaller gap has taken, so each piece goes to
its successor, the smallest gap free for it. Where more pieces than gaps meet, ranks decide: the lowest ranks of the run
are placed, the others stay and go on to the next larger gap. What a range leaves over is swept across ranges. Gaps
are updated, move to the ranges of their new sizes, and the super-step is repeated until it places nothing; then the
pieces left over open new sequences, no more than ``OPEN`` of what they would fill. Longer pieces come first (``BANDS``).

What else is distributed: tokenizing, the histogram of lengths, the ranks (a piece's rank among those of its length is
the count in the tasks before plus its count in its own task: no sort, no window over a hot length) and the
assignment.

Null or empty text: one piece that holds the end id. Very long texts: many full pieces. Ties (equal lengths) go by task
and place in the task. Repeated rows are packed each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import documents, map_arrow, materialize, table
from gridloom.llm.tokenizing import rank_encoder, tokenizer_path

WIDTH, END_ID = 2048, 0
#: Pieces longer than a part of the width are placed before shorter ones.
BANDS = (1 / 2, 1 / 4, 0)
#: Share of the sequences that the pieces left over would fill, opened at once.
OPEN = 0.8
RANGES = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seq long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: A run of pieces (kind 0: length, first rank, count), of gaps (kind 1: size, first sequence, count), or of pieces placed
#: (kind 2: length, first rank, count, first sequence, pieces a sequence, offset).
RUNS = "kind int, size int, first long, count long, sequence long, each long, offset long"
PIECE, GAP, PLACED = range(3)


def cut_pieces(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document, with the task that made them (``part``) and their count among the pieces of the
    same length in that task (``seq``)."""

    def run(batches):
        encode = rank_encoder(path).one
        part = TaskContext.get().partitionId()
        seen = np.zeros(width + 1, np.int64)
        out = [[] for _ in range(7)]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                start, to = 0, n % width or width
                piece = 0
                while start < n:
                    length = to - start
                    for column, x in zip(out, (doc, piece, start, length, zlib.crc32(ids[start:to].tobytes()), part, int(seen[length]))):
                        column.append(x)
                    seen[length] += 1
                    start, to, piece = to, to + width, piece + 1
            yield _batch(out)
            out = [[] for _ in range(7)]

    return documents(docs).mapInArrow(run, PIECES)


def _batch(columns: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], width: int):
    """One sweep up the sizes: (runs placed, runs of pieces left, runs of gaps). Runs are (size, first, count), sorted."""
    placed, after, stack, at = [], [], [], 0
    for size, sequence, many in gaps:
        while at < len(pieces) and pieces[at][0] <= size:
            stack.append(pieces[at])
            at += 1
        while many and stack:
            length, rank, count = stack.pop()
            each = min(size // length, count)
            full = min(many, count // each)
            placed.append((PLACED, length, rank, full * each, sequence, each, width - size))
            after.append((size - each * length, sequence, full))
            sequence, many, rank, count = sequence + full, many - full, rank + full * each, count - full * each
            if count:
                stack.append((length, rank, count))
        if many:
            after.append((size, sequence, many))
    return placed, sorted(stack + pieces[at:]), sorted(g for g in after if g[0])


def joined(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of one size that follow each other as one."""
    out: list[tuple[int, int, int]] = []
    for size, first, count in sorted(runs):
        if out and out[-1][0] == size and out[-1][1] + out[-1][2] == first:
            out[-1] = (size, out[-1][1], out[-1][2] + count)
        else:
            out.append((size, first, count))
    return out


def _sweeps(width: int, shortest: int):
    """Sweeps the runs that a task gets until nothing more is placed."""

    def run(batches):
        rows = [row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(7)))]
        out = [r for r in rows if r[0] == PLACED or r[0] == PIECE and r[1] <= shortest]
        pieces = sorted(r[1:4] for r in rows if r[0] == PIECE and r[1] > shortest)
        gaps = joined([r[1:4] for r in rows if r[0] == GAP])
        placed = True
        while placed and pieces and gaps:
            placed, pieces, gaps = sweep(pieces, gaps, width)
            out += placed
            gaps = joined(gaps)
        out += [(PIECE, *p, 0, 0, 0) for p in pieces] + [(GAP, *g, 0, 0, 0) for g in gaps]
        if out:
            types = (pa.int32(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in RUNS.split(", ")])

    return run


def superstep(spark: SparkSession, runs: list[tuple], width: int, shortest: int) -> list[tuple]:
    """The runs after one super-step over the pieces longer than ``shortest``: swept in ranges of size, then across."""
    near = spark.createDataFrame(runs, RUNS).repartitionByRange(RANGES, "size").mapInArrow(_sweeps(width, shortest), RUNS)
    return [tuple(r) for r in near.repartition(1).mapInArrow(_sweeps(width, shortest), RUNS).collect()]  # bounded by the width


def match(spark: SparkSession, counts: dict[int, int], width: int = WIDTH) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs of ranks: (first rank, first sequence, pieces of this length a sequence, their offset).

    Rank r of a run is in sequence ``first + (r - rank) // pieces`` at ``offset + (r - rank) % pieces * length``.
    """
    state: list[tuple] = [(PIECE, length, 0, n, 0, 0, 0) for length, n in counts.items()]
    done: list[tuple] = []
    fresh = 0
    for shortest in [int(width * part) for part in BANDS]:
        opens = not any(r[0] == GAP for r in state)  # gaps that there are come first
        while left := [r for r in state if r[0] == PIECE and r[1] > shortest]:
            if opens:
                many = sum(r[3] for r in left)
                if 2 * shortest < width:
                    many = max(1, int(OPEN * sum(r[1] * r[3] for r in left) / width))
                state.append((GAP, width, fresh, many, 0, 0, 0))
                fresh += many
            state = superstep(spark, state, width, shortest)
            done += [r for r in state if r[0] == PLACED]
            state = [r for r in state if r[0] != PLACED]
            opens = True
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for _, length, rank, _, sequence, each, offset in sorted(done):
        out[length].append((rank, sequence, each, offset))
    return dict(out)


def pack(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: every piece and its place."""
    pieces = materialize(cut_pieces(docs, path, width, end_id), "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    runs = match(docs.sparkSession, {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, width)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("seq")).alias("rank"))
    lengths = sorted(runs)
    table_of = {length: np.array(runs[length], np.int64) for length in lengths}

    def place(batch: pa.RecordBatch):
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            mine = np.flatnonzero(length == x)
            rows = table_of[int(x)]
            first, at, each, begin = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1].T
            sequence[mine] = at + (rank[mine] - first) // each
            offset[mine] = begin + (rank[mine] - first) % each * x
        yield {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

    return map_arrow(ranked, place, PACKED)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
