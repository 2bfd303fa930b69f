"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Items are partitioned by the power of two that bounds their number of shingles. Each item is sketched by its
smallest shingle hashes (bottom-k MinHash), as many as its partition asks for: with containment of at least 4/5, at
most a fifth of an item's shingles is missing from a document, so of a sketch that holds more than a fifth of them
(and MARGIN more) at least the rest has to be found. That bound is exact for each item, so the search loses nothing;
long documents aren't sketched, since only whole documents can be asked for containment of something far shorter.
Candidates are then verified by the exact shingles of both texts.

Items are read in blocks of bounded size, each block searched against all documents by its own broadcast index.

Words are lower-cased and split at ASCII white space. A document or item of fewer than ``k`` words has all of them
as its one shingle; one without words (empty, null) has no shingle and takes part in no pair. A very long document is a
block of its own and is searched whole. Repeated rows are each reported: a document that occurs a times and an item that
occurs b times give the ab rows of a join. Ties don't arise: exactly 4/5 counts. Empty tables give an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import Words, cut, documents, map_arrow, table, text_bytes, word_set

#: Hash values that a sketch holds beyond the fifth that may be missing.
MARGIN = 4
#: Bytes of item texts in a block, whose index is broadcast.
ITEM_BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long"


class ItemIndex:
    """The sketches of one block of items, by hash value."""

    def __init__(self, ids: list[int], texts: list[str], k: int):
        self.k, self.ids, self.texts = k, ids, texts
        lowered = pc.utf8_lower(pa.array(texts, pa.string()))
        row, code = Words(*text_bytes(lowered)).shingles(k)
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        row, code = row[fresh], code[fresh]
        size = np.bincount(row, minlength=len(ids))
        upper = np.exp2(np.ceil(np.log2(np.maximum(size, 1)))).astype(np.int64)  # of the item's partition
        keep = np.minimum(size, upper // 5 + 1 + MARGIN)
        self.size, self.need = size, np.maximum(keep - size // 5, 1)
        rank = np.arange(len(row)) - np.concatenate([[0], np.cumsum(size)])[row]
        sketch = rank < keep[row]
        order = np.argsort(code[sketch], kind="stable")
        self.code, self.item = code[sketch][order], row[sketch][order]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.code >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of document row and item in which enough of the item's sketch was found."""
        hit = np.flatnonzero(self.filter[(code >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.code, code[hit], "left"), np.searchsorted(self.code, code[hit], "right")
        hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = np.unique(np.repeat(row[hit], n) * len(self.code) + slot)  # each sketch value once a document
        pair, times = np.unique(found // len(self.code) * len(self.ids) + self.item[found % len(self.code)], return_counts=True)
        row, item = pair // len(self.ids), pair % len(self.ids)
        enough = times >= self.need[item]
        return row[enough], item[enough]


def item_indexes(items: DataFrame, k: int):
    """Indexes of the items, a block of bounded size at a time."""
    items = documents(items, "item_id")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / ITEM_BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield ItemIndex([r[0] for r in rows], [r[1] for r in rows], k)


def search(index: ItemIndex, text: pa.Array, k: int) -> list[tuple[int, int, int, int]]:
    """Row, item, shingles of the item and those of them in the row, of each pair that the exact shingles confirm."""
    text = pc.utf8_lower(text)
    sets: dict[int, set[bytes]] = {}
    at: dict[int, set[bytes]] = {}
    out = []
    for r, i in zip(*(x.tolist() for x in index.candidates(*Words(*text_bytes(text)).shingles(k)))):
        if r not in at:
            at = {r: word_set(text[r].as_py(), k)}
        if i not in sets:
            sets[i] = word_set(pc.utf8_lower(pa.scalar(index.texts[i])).as_py(), k)
        shared = len(at[r] & sets[i])
        if shared * 5 >= len(sets[i]) * 4:
            out.append((r, i, len(sets[i]), shared))
    return out


def find_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """Every pair of a document and an item of which at least 4/5 of the distinct shingles are in the document:
    ``doc_id, item_id, n_item, n_shared`` (shingles of the item, and those of them in the document)."""
    docs = documents(docs, key)
    found = None
    for index in item_indexes(items, k):

        def pairs(batch: pa.RecordBatch, index=index):
            if got := search(index, batch.column("text"), k):
                row, item, n, shared = zip(*got)
                yield {"doc_id": batch.column(key).take(pa.array(row)), "item_id": pa.array([index.ids[i] for i in item], pa.int64()), "n_item": pa.array(n, pa.int64()), "n_shared": pa.array(shared, pa.int64())}

        part = map_arrow(docs, pairs, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """``docs`` with all its columns, without the rows that hold an item."""
    for index in item_indexes(items, k):

        def clean(batches, index=index):
            for whole in batches:
                for batch in cut(whole):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[r for r, *_ in search(index, batch.column("text").cast(pa.string()).fill_null(""), k)]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


SQL = r"""
WITH w AS (SELECT doc_id AS id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
b AS (SELECT item_id AS id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM benchmark),
ds AS (SELECT DISTINCT id, unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 3, 2))]) AS s FROM w WHERE len(ws) > 0),
bs AS (SELECT DISTINCT id, unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 3, 2))]) AS s FROM b WHERE len(ws) > 0),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, max(n.n)::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / max(n.n) AS containment
FROM ds JOIN bs ON ds.s = bs.s JOIN n ON n.id = bs.id GROUP BY ds.id, bs.id HAVING count(*) * 5 >= max(n.n) * 4
"""
