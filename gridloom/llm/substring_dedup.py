"""Substring dedup: long word sequences that repeat, found by De Bruijn compaction.

In the De Bruijn graph of the corpus an edge is a k-mer, here a window of ``window`` words; an edge that occurs more
than once is repeated, and every word under a repeated edge goes. Edges are packed and compacted in these steps:

1. Consecutive windows with the same minimizer (the smallest hash among their short grams) form a piece, a path without
   a branch in its document: one row instead of some thirteen. Equal windows have equal minimizers, so a window
   can only repeat where its minimizer (``anchor``) does. Anchors are counted; unique ones are dropped by a join.
2. A piece's name is the 128-bit BLAKE2b digest of its words, taken at its coordinates in the source text: pieces of one
   name are equal word for word, whatever the rolling hashes that proposed them. One aggregation by name gives how often
   a piece occurs and its degrees: whether all occurrences have the same next piece, and the same one before.
3. A piece that occurs twice or more has repeated edges alone. A join brings counts and degrees to the occurrences;
   neighbours of which the first has one successor and the second one predecessor are contracted into one repeated
   nonbranching path, so a long copied span is one row of source coordinates (document, first window, windows).
4. A piece that occurs once may branch off a repeated path. Only for such pieces, and one occurrence of each
   piece with the same anchor, the edges are listed by the digests of their words in the source, and counted.
5. The spans go back to the documents, where the covered words are removed.

Hot anchors are met by partial counts and by joins whose other side has one row a key, which Spark can split. Every
phase is a table in the shared folder.

Null or empty text, or one shorter than a window: kept as it is. Repeated rows, even of one id, are occurrences of
their own, so all their windows repeat. A null id is kept. Very long texts are blocks of their own (``shared``). There
are no ties: which occurrence stands for a piece changes nothing. Other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import Words, discard, documents, map_arrow, materialize, table, text_bytes

WINDOW = 35
#: Words in the grams whose hashes are compared for a minimizer.
GRAM_WORDS = 10
PIECES = "anchor long, path binary, before long, after long, d long, h long, first int, n int"
NO_ID = -(2**63)


def pieces_of(words: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Row, first window (as the number of its first word in the block), count and anchor of each piece."""
    where = words.places(window)
    at, code = words.grams(k)
    if not len(where):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    full = np.full(len(words.code), np.iinfo(np.uint64).max, np.uint64)
    full[at] = code
    least = np.lib.stride_tricks.sliding_window_view(full, window - k + 1).argmin(1)
    anchor = where + least[where]
    fresh = np.ones(len(where), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (words.doc[where[1:]] != words.doc[where[:-1]])
    begin = np.flatnonzero(fresh)
    n = np.diff(np.append(begin, len(where)))
    first = where[begin]
    return words.doc[first], first, n, full[anchor[begin]]


def digests(words: Words, first: np.ndarray, n: np.ndarray) -> list[bytes]:
    """128 bits of the ``n`` words from ``first`` on, as they are spelled."""
    text, at = words.spelled()
    return [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(at[first].tolist(), at[first + n].tolist())]


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the pair that names them in joins: rows alike in id and text share it, and share their fate."""
    docs = documents(docs)
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``d, h, spans``: for each document with repeated windows, (first word, windows, which of them; -1: all)."""
    k = max(1, min(GRAM_WORDS, window // 3))
    if window - k + 1 > 31:
        raise ValueError("at most 40 words a window")
    docs = keyed(docs)

    def anchors(batch: pa.RecordBatch):
        yield {"anchor": pieces_of(Words(*text_bytes(batch.column("text"))), window, k)[3].view(np.int64)}

    def pieces(batch: pa.RecordBatch):
        words = Words(*text_bytes(batch.column("text")))
        row, first, n, anchor = pieces_of(words, window, k)
        path = digests(words, first, n + window - 1)
        mark = np.frombuffer(b"".join(path), "<i8")[::2] if path else np.zeros(0, np.int64)
        same = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)  # the next piece is of the same row
        after = pa.array(np.roll(mark, -1), mask=~same)
        before = pa.array(np.roll(mark, 1), mask=~np.roll(same, 1))
        d, h = (batch.column(c).to_numpy()[row] for c in ("d", "h"))
        yield {"anchor": anchor.view(np.int64), "path": pa.array(path, pa.binary()), "before": before, "after": after, "d": d, "h": h, "first": (first - words.first[row]).astype(np.int32), "n": n.astype(np.int32)}

    repeated = materialize(map_arrow(docs.select("text"), anchors, "anchor long").groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    found = materialize(map_arrow(docs.select("text", "d", "h"), pieces, PIECES).join(repeated, "anchor"), "pieces")
    discard(repeated)
    one = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    paths = found.groupBy("anchor", "path").agg(F.count("*").alias("times"), F.min(F.struct("d", "h", "first", "n")).alias("at"), F.coalesce(one("before"), F.lit(False)).alias("one_before"), F.coalesce(one("after"), F.lit(False)).alias("one_after"))
    paths = materialize(paths, "paths")

    branching = paths.where("times = 1").select("anchor").distinct()
    asked = paths.join(branching, "anchor", "left_semi").select("at.d", "at.h", F.struct("anchor", "path", "times", "at.first", "at.n").alias("ask"))
    asked = asked.groupBy("d", "h").agg(F.collect_list("ask").alias("asks"))  # no more than a document has pieces

    def edges(batch: pa.RecordBatch):
        words = Words(*text_bytes(batch.column("text")))
        asks = batch.column("asks")
        many = asks.value_lengths().to_numpy()
        parts = asks.flatten()
        get = lambda name: pa.compute.struct_field(parts, name)
        row = np.repeat(np.arange(batch.num_rows), many)
        n = get("n").to_numpy().astype(np.int64)
        index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        here = np.repeat(words.first[row] + get("first").to_numpy(), n) + index
        each = pa.array(np.repeat(np.arange(len(n)), n))
        yield {c: get(c).take(each) for c in ("anchor", "path", "times")} | {"i": index.astype(np.int32), "edge": pa.array(digests(words, here, np.int64(window)), pa.binary())}

    once = docs.select("d", "h", "text").join(asked, ["d", "h"])
    listed = materialize(map_arrow(once, edges, "anchor long, path binary, times long, i int, edge binary"), "edges")
    twice = listed.groupBy("anchor", "edge").agg(F.sum("times").alias("n")).where("n > 1").select("anchor", "edge")
    some = listed.where("times = 1").join(twice, ["anchor", "edge"]).groupBy("anchor", "path").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("which"))
    whole = paths.where("times > 1").select("anchor", "path", F.lit(-1).alias("which"), "one_before", "one_after")
    decided = materialize(whole.unionByName(some.selectExpr("anchor", "path", "which", "false AS one_before", "false AS one_after")), "decided")
    discard(listed)
    return contracted(found.join(decided, ["anchor", "path"]))


def contracted(pieces: DataFrame) -> DataFrame:
    """Pieces of each document, neighbours joined into one path where neither end of their link branches."""
    line = Window.partitionBy("d", "h").orderBy("first")
    # Rows alike in id and text have the same pieces.
    pieces = pieces.withColumn("again", F.coalesce(F.lag("first").over(line) == F.col("first"), F.lit(False))).where(~F.col("again"))
    linked = (F.lag(F.col("first") + F.col("n")).over(line) == F.col("first")) & F.lag("one_after").over(line) & F.col("one_before")
    pieces = pieces.withColumn("starts", (~F.coalesce(linked, F.lit(False))).cast("int"))
    pieces = pieces.withColumn("unit", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    units = pieces.groupBy("d", "h", "unit").agg(F.min("first").alias("first"), F.sum("n").cast("int").alias("n"), F.min("which").alias("which"))
    return units.groupBy("d", "h").agg(F.collect_list(F.struct("first", "n", "which")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each document's words without those under a repeated window, joined by
    one space."""
    spans = materialize(repeated_spans(docs, window), "spans")
    joined = keyed(docs).join(spans, ["d", "h"], "left").select("doc_id", "text", "spans")

    def keep(batch: pa.RecordBatch):
        words = Words(*text_bytes(batch.column("text")))
        spans = batch.column("spans")
        many = pa.compute.fill_null(spans.value_lengths(), 0).to_numpy()
        first, n, which = (pa.compute.struct_field(spans.flatten(), c).to_numpy().astype(np.int64) for c in ("first", "n", "which"))
        begin = words.first[np.repeat(np.arange(batch.num_rows), many)] + first
        some = np.flatnonzero(which != -1)
        bit = np.flatnonzero((which[some, None] >> np.arange(31)) & 1)
        begin = np.concatenate([begin[which == -1], begin[some[bit // 31]] + bit % 31])
        end = begin + np.concatenate([n[which == -1], np.ones(len(bit), np.int64)]) - 1 + window
        step = np.bincount(begin, minlength=len(words.code) + 1) - np.bincount(end, minlength=len(words.code) + 1)
        covered = np.cumsum(step)[:-1] > 0
        text, at = words.spelled()
        size = np.diff(at)
        left = np.frombuffer(text, np.uint8)[np.repeat(~covered, size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.where(covered, 0, size))])[words.first].tolist()
        kept = [left[a : max(a, b - 1)].decode() for a, b in zip(ends, ends[1:])]
        gone = np.concatenate([[0], np.cumsum(covered)])[words.first]
        yield {"doc_id": batch.column("doc_id"), "n_words": words.count, "n_removed": np.diff(gone), "kept": pa.array(kept, pa.string())}

    return map_arrow(joined, keep, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: Every window as a string: for tables of some thousand documents.
SQL = r"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
e AS MATERIALIZED (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
t AS (SELECT s FROM e GROUP BY s HAVING count(*) > 1),
c AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM e JOIN t USING (s)),
l AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM l ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)
"""
