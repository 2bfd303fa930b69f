"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles; those with equal sets form a class, and what follows works on classes. In each of
``RUNS`` runs a set is split off to buckets by the shingles that a threshold hash samples, SAMPLED of them on average,
the same ones in every set they belong to. In buckets of up to ``BUCKET`` sets all pairs are tried, by size and by a
256-bit minwise sketch whose bound a pair of the asked similarity fails with a chance of about 1e-6; of the pairs found a
bucket gives one edge a set, to the first of those it hangs together with. Larger buckets are split again by shingles
sampled for the path so far, as deep as it takes; from level to level rows become fewer and the size of buckets that are
tried pair by pair grows (``WIDER``, up to ``WIDEST``), so that few levels settle them:

- Each large bucket's first member is its centre. Members that differ from it by up to ``NEAR`` bits get an edge to it.
- Members within ``SAME`` bits go no deeper: what is within ``DIFFER`` bits of such a member is within SAME + DIFFER =
  NEAR of the centre (bits that differ are a metric), so it has its edge already.
- The edges found so far are contracted to groups after each level, and a bucket all of whose members are of one group
  is settled. So near copies, which share most of their shingles at any depth, go no deeper, and texts that share a
  line alone are split by their other shingles.

A pair at the threshold is missed by a run that ends at the first level with a chance of about 1/4, at the second 1/2; by
all runs with about 1e-7 and 1e-3. How much is found is measured: the links of ``CALIBRATION`` documents to all others
come from brute force, and runs are repeated with new hashes until ``RECALL`` of these links are within groups.

The groups are joined exactly. A small one is one task. A large one is cut by size of set, so that only neighbouring
sizes meet (a pair at 4/5 differs by a factor of 5/4 at most), and each of these into blocks; each pair of blocks counts
all intersections by matrix products, and gives sums of links and a forest, not pairs. Links between different texts
of one large group can be as many as the square of its size, and counting them takes that many multiplications, in
tasks of bounded size; no row is made for a link.

``links`` counts the other documents, copies included, whose Jaccard similarity is at least 4/5; ``class_id`` is the
smallest doc_id that links lead to. Words are split at ASCII white space and compared as they are, shingles by 64-bit
hashes of their words. Documents without words (null, empty) have no links and their own id as class. Documents of fewer
than five words have one shingle of all of them. A very long text is a block of its own. Ties don't arise: a similarity of
exactly 4/5 links. Repeated rows are documents of their own. A null id can't be a class id unless nothing else is
linked. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.shared import Words, discard, documents, map_arrow, materialize, mix, stream, table, text_bytes

SHINGLE = 5
RUNS, BUCKET = 12, 48
#: Buckets that are tried pair by pair are so many times as large a level deeper, up to a size that is a second's work.
WIDER, WIDEST = 4, 3072
SAMPLED, SAMPLED_DEEPER = 1.5, 1.25
#: Differing bits that a pair may have. At similarity 0.8 a bit differs with a chance of 0.1.
BITS, DIFFER = 256, 50
SAME = 26
NEAR = SAME + DIFFER
#: Documents whose links are found by brute force (texts of up to so many letters), and the share of them to be reached.
CALIBRATION, CALIBRATION_LETTERS, RECALL = 256, 200_000, 0.99
#: Sets and shingles that a block holds.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
NO_ID = -(2**63)
U64 = np.uint64
SKETCH = stream(12, BITS) | U64(1)


def sets_of(text: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    raw, offsets = text_bytes(text)
    row, code = Words(raw, offsets).shingles(SHINGLE)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    row, code = row[fresh], code[fresh]
    return np.split(code, np.cumsum(np.bincount(row, minlength=len(text)))[:-1])


def name_of(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def sketch(s: np.ndarray) -> np.ndarray:
    """One bit of each of ``BITS`` minwise hashes, as 64-bit words."""
    least = np.full(BITS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 500):
        np.minimum(least, (SKETCH[:, None] * s[None, at : at + 500]).min(1), out=least)
    return np.packbits(((mix(least) >> U64(17)) & U64(1)).astype(np.uint8)).view("<i8")


def sampled(s: np.ndarray, seeds: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """For each seed the shingles that its hash samples: (number of the seed, path that goes on with the shingle)."""
    most = U64(min(2**64 - 1, int(2.0**64 * wanted / max(len(s), 1))))
    which, path = [], []
    for at in range(0, len(s), 20_000):
        part = s[at : at + 20_000]
        value = part[None, :] * seeds[:, None]
        value ^= value >> U64(32)
        value *= U64(0xD6E8FEB86659FD93)
        run, i = np.nonzero(value <= most)
        which.append(run)
        path.append(mix(part[i] ^ seeds[run]))
    return np.concatenate(which), np.concatenate(path)


def keyed(docs: DataFrame) -> DataFrame:
    docs = documents(docs)
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"))


WORDS = [f"s{i}" for i in range(BITS // 64)]
PATHS = "path long, v binary, n int, " + ", ".join(f"{c} long" for c in WORDS)


def _rows(path: list[np.ndarray], names: list[bytes], sets: list[np.ndarray]) -> dict:
    """Rows of ``PATHS``, with as many paths for each set as it is given."""
    each = np.repeat(np.arange(len(sets)), [len(p) for p in path])
    bits = np.array([sketch(s) if len(p) else np.zeros(BITS // 64, np.int64) for s, p in zip(sets, path)], np.int64).reshape(-1, BITS // 64)
    out = {"path": np.concatenate([*path, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64), "v": pa.array(names, pa.binary()).take(pa.array(each)), "n": np.array([len(s) for s in sets], np.int32)[each]}
    return out | {c: bits[each, i] for i, c in enumerate(WORDS)}


def first_paths(docs: DataFrame, batch_of_runs: int) -> DataFrame:
    """Paths of one shingle, of all runs of a batch."""
    seeds = mix(stream(100 + batch_of_runs, RUNS)) | U64(1)

    def run(batch: pa.RecordBatch):
        sets = [s for s in sets_of(batch.column("text")) if len(s)]
        yield _rows([sampled(s, seeds, SAMPLED)[1] for s in sets], [name_of(s) for s in sets], sets)

    return map_arrow(docs.select("text"), run, PATHS)


def next_paths(asked: DataFrame) -> DataFrame:
    """From ``v, paths, content``: the paths that go on from each of a set's paths."""

    def run(batch: pa.RecordBatch):
        sets = [np.frombuffer(c, "<u8") for c in batch.column("content").to_pylist()]
        seeds = [mix(np.array(p, np.int64).view(np.uint64)) | U64(1) for p in batch.column("paths").to_pylist()]
        yield _rows([sampled(s, x, SAMPLED_DEEPER)[1] for s, x in zip(sets, seeds)], batch.column("v").to_pylist(), sets)

    return map_arrow(asked, run, PATHS)


def differing(a: list[Column], b: list[Column]) -> Column:
    """Bits in which two sketches differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)])


def bucketed(rows: DataFrame, most: int) -> DataFrame:
    """Rows of buckets that hold more than one class, once each, with their ``size``; in buckets of more than ``most`` with
    the centre ``b`` and the bits in which they ``differ`` from it. Rows of a hot path are counted before they are
    shuffled, and joined with one row a path, which Spark can split."""
    bits = [F.col(c) for c in WORDS]
    once = rows.groupBy("path", "v").agg(*[F.first(c).alias(c) for c in ("n", *WORDS)])
    sizes = once.groupBy("path").agg(F.count("*").alias("size"), F.min(F.struct("v", *WORDS)).alias("first"), F.max("n").alias("probe")).where("size > 1 AND probe IS NOT NULL")
    sizes = sizes.select("path", "size", F.when(F.col("size") > most, F.col("first")).alias("first"))
    met = once.join(sizes, "path")
    return met.select("path", "v", "n", *WORDS, "size", F.col("first.v").alias("b"), differing(bits, [F.col(f"first.{c}") for c in WORDS]).alias("differ"))


def settled(label: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Each row's smallest row that the pairs, and the labels so far, connect it with."""
    a, b = np.concatenate([np.arange(len(label)), *a]), np.concatenate([label, *b])
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            return label
        label = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]


def edges_of(path: np.ndarray, n: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Within runs of equal paths, all pairs are tried; of what hangs together each row gets an edge to the first."""
    label, held = np.arange(len(path)), 0
    left, a, b = label[:-1], [], []
    for off in range(1, most):
        left = left[left + off < len(path)]
        left = left[path[left] == path[left + off]]
        if not len(left):
            break
        i, j = left, left + off
        fits = (n[i] * 5 >= n[j] * 4) & (n[j] * 5 >= n[i] * 4)
        i, j = i[fits], j[fits]
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(1) <= DIFFER
        a.append(i[near])
        b.append(j[near])
        held += len(a[-1])
        if held > 1_000_000:  # pairs become labels before they fill the memory
            label, a, b, held = settled(label, a, b), [], [], 0
    label = settled(label, a, b)
    hung = np.flatnonzero(label != np.arange(len(path)))
    return hung, label[hung]


def small_edges(rows: DataFrame, most: int) -> DataFrame:
    """Edges ``a, b`` of buckets of up to ``most`` sets."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            path = whole["path"].to_numpy()
            end = len(path) if last else int(np.searchsorted(path, path[-1]))  # the last bucket may go on
            if end < len(path):
                held.extend(whole.slice(end).to_batches())
            v, bits = whole["v"], np.column_stack([whole[c].to_numpy()[:end] for c in WORDS]).view(np.uint64)
            a, b = edges_of(path[:end], whole["n"].to_numpy()[:end].astype(np.int64), bits, most)
            if len(a):
                yield from pa.table({"a": v.take(pa.array(a)), "b": v.take(pa.array(b))}).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) > 50_000:
                yield from flush(False)
        if held:
            yield from flush(True)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("path", "v", "n", *WORDS).repartition(tasks, "path").sortWithinPartitions("path", "v")
    return rows.mapInArrow(run, "a binary, b binary")


def candidate_groups(docs: DataFrame, where: DataFrame, batch_of_runs: int, groups: DataFrame | None) -> DataFrame:
    """``v, label``: the ``groups`` so far, with those that one more batch of runs finds. ``where``: the classes ``v`` with
    the document (d, h) that stands for each."""
    rows, contents, most = first_paths(docs, batch_of_runs), None, BUCKET
    while True:
        rows = materialize(bucketed(rows, most), "buckets")
        large = rows.where(F.col("size") > most)
        edges = small_edges(rows.where(F.col("size") <= most), most).unionByName(large.where((F.col("v") != F.col("b")) & (F.col("differ") <= NEAR)).select(F.col("v").alias("a"), "b"))
        if groups is not None:
            edges = edges.unionByName(groups.select(F.col("v").alias("a"), F.col("label").alias("b")))
        groups = components(edges)
        grouped = large.select("path", "v", "differ").join(groups, "v", "left").withColumn("label", F.coalesce("label", "v"))
        unsettled = grouped.groupBy("path").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("path")
        rest = large.where(F.col("differ") > SAME).select("path", "v").join(unsettled, "path")
        asked = materialize(rest.groupBy("v").agg(F.collect_list("path").alias("paths")), "asked")  # some SAMPLED x RUNS paths
        discard(rows)
        if asked.isEmpty():
            return groups
        if contents is None:  # those that go deeper are among these
            contents = contents_of(asked.select("v"), docs, where)
        rows, most = next_paths(asked.join(contents, "v")), min(WIDER * most, max(WIDEST, BUCKET))


def contents_of(wanted: DataFrame, docs: DataFrame, where: DataFrame) -> DataFrame:
    """``v, content``: the sets of the ``wanted`` classes."""

    def run(batch: pa.RecordBatch):
        yield {"v": batch.column("v"), "content": pa.array([s.astype("<u8").tobytes() for s in sets_of(batch.column("text"))], pa.binary())}

    told = wanted.join(where.select("v", "d", "h"), "v").join(docs.select("d", "h", "text"), ["d", "h"]).dropDuplicates(["v"])
    return materialize(map_arrow(told.select("v", "text"), run, "v binary, content binary"), "contents")


class Sample:
    """Sets whose links are found by brute force."""

    def __init__(self, sets: list[np.ndarray]):
        self.names = [name_of(s) for s in sets]
        self.size = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.token >> U64(48)).astype(np.int64)] = True

    def links(self, sets: list[np.ndarray]) -> list[list[int]]:
        """The sample's sets that each set is linked with."""
        out: list[list[int]] = [[] for _ in sets]
        if not len(self.token):
            return out
        token = np.concatenate([*sets, np.zeros(0, np.uint64)])
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        hit = np.flatnonzero(self.filter[(token >> U64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.token, token[hit], "left"), np.searchsorted(self.token, token[hit], "right")
        many = hi - lo
        slot = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        pair, shared = np.unique(np.repeat(row[hit], many) * len(self.size) + self.owner[slot], return_counts=True)
        r, i = pair // len(self.size), pair % len(self.size)
        size = np.array([len(s) for s in sets], np.int64)[r] + self.size[i] - shared
        for a, b in zip(r[shared * 5 >= size * 4].tolist(), i[shared * 5 >= size * 4].tolist()):
            out[a].append(b)
        return out


def sample_of(docs: DataFrame) -> Sample:
    """The documents of the smallest hashes."""
    few = docs.where((F.length("text") <= CALIBRATION_LETTERS) & (F.length("text") > 0)).withColumn("order", F.xxhash64("text", F.lit(5)))
    chosen = [r[0] for r in few.select("order").distinct().orderBy("order").limit(CALIBRATION).collect()]
    texts = [r[0] for r in few.where(F.col("order").isin(chosen)).groupBy("order").agg(F.first("text")).select("first(text)").collect()]
    sets = {name_of(s): s for s in sets_of(pa.array(sorted(texts), pa.string())) if len(s)} if texts else {}
    return Sample(list(sets.values()))


def exact(one_block: bool, members: list[tuple[bytes, int, np.ndarray]], sides: list[int]):
    """All pairs of one task: links to other classes weighed by copies, and a spanning forest of the links."""
    tokens = np.concatenate([m[2] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    number = np.cumsum(np.append(False, tokens[1:] != tokens[:-1]))
    shared = np.bincount(number)[number] > 1
    number, owner = number[shared], owner[shared]
    number = np.unique(number, return_inverse=True)[1]
    common = np.zeros((len(members), len(members)), np.float32)
    for at in range(0, int(number.max()) + 1 if len(number) else 0, 4096):
        lo, hi = np.searchsorted(number, [at, at + 4096])
        grid = np.zeros((len(members), 4096), np.float32)
        grid[owner[lo:hi], number[lo:hi] - at] = 1
        common += grid @ grid.T
    size = np.array([len(m[2]) for m in members])
    both = common.astype(np.int64)
    linked = both * 5 >= (size[:, None] + size[None, :] - both) * 4
    np.fill_diagonal(linked, False)
    side = np.array(sides)
    if not one_block:  # pairs within either are another task's
        linked &= side[:, None] != side[None, :]
    copies = np.array([m[1] for m in members])
    label, forest = np.arange(len(members)), []
    while True:  # each member to the smallest label around it
        least = np.where(linked, label[None, :], len(members)).min(1)
        fresh = np.minimum(label, least)
        if (fresh == label).all():
            break
        label = fresh
    for i in np.flatnonzero(label != np.arange(len(members))).tolist():
        forest.append((members[i][0], members[label[i]][0]))
    return linked @ copies, forest


PAIRED = "v binary, links long, a binary, b binary"
TASK = ["label", "p", "i", "q", "j"]


def _join_blocks(batches):
    """Tasks arrive sorted by ``TASK``; each is joined when it is whole."""
    held, now = [], None

    def flush():
        rows = []
        if len(held) > 1:
            links, forest = exact(now[1:3] == now[3:5], [(h[0], h[1], np.frombuffer(h[2], "<u8")) for h in held], [h[3] for h in held])
            rows += [(h[0], int(n), None, None) for h, n in zip(held, links) if n]
            rows += [(None, None, a, b) for a, b in forest]
        held.clear()
        return rows

    out = []
    for batch in batches:
        for *task, side, v, copies, content in zip(*(batch.column(c).to_pylist() for c in (*TASK, "side", "v", "copies", "content"))):
            if task != now:
                out += flush()
                now = task
            held.append((v, copies, content, side))
        if len(out) > 5000:
            yield _paired(out)
            out = []
    out += flush()
    if out:
        yield _paired(out)


def _paired(rows) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["v", "links", "a", "b"])


def dealt(groups: DataFrame, named: DataFrame) -> DataFrame:
    """``v, copies`` and the tasks that each class takes part in: (label, p, i, q, j) is block i of size class p against
    block j of size class q. A group that fits in a block is of one class."""
    members = groups.join(named.select("v", "copies", "n"), "v")
    totals = members.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    one = (F.col("sets") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)
    members = members.join(totals, "label").withColumn("p", F.when(one, 0).otherwise(F.floor(F.log("n") / F.log(F.lit(1.25)))).cast("int"))
    blocks = members.groupBy("label", "p").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks = blocks.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("p", "blocks"))).alias("blocks"))  # one row a size class
    own = members.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("v"), F.element_at("blocks", F.col("p"))).cast("int"))
    p, block = F.col("p"), F.col("block")

    def against(step: int, make) -> Column:
        many = F.try_element_at("blocks", p + step)
        return F.when(many.isNotNull(), F.transform(F.sequence(F.lit(0), many - 1), make)).otherwise(F.array())

    task = lambda p, i, q, j, side: F.struct(p.cast("int").alias("p"), i.cast("int").alias("i"), q.cast("int").alias("q"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    tasks = F.concat(
        against(0, lambda x: task(p, F.least(block, x), p, F.greatest(block, x), F.when(block <= x, 0).otherwise(1))),
        against(1, lambda x: task(p, block, p + 1, x, F.lit(0))),
        against(-1, lambda x: task(p - 1, x, p, block, F.lit(1))),
    )
    return own.select("v", "copies", "label", tasks.alias("tasks"))


def linked(docs: DataFrame) -> DataFrame:
    """``doc_id, d, h, label, links`` of every document; equal labels are linked, no label: no words."""
    docs = keyed(docs)
    spark = docs.sparkSession
    sample = sample_of(docs)

    def summary(batch: pa.RecordBatch):
        sets = sets_of(batch.column("text"))
        yield {"doc_id": batch.column("doc_id"), "d": batch.column("d"), "h": batch.column("h"), "v": pa.array([name_of(s) if len(s) else None for s in sets], pa.binary()), "n": pa.array([len(s) for s in sets], pa.int32()), "near": pa.array(sample.links(sets), pa.list_(pa.int32()))}

    seen = materialize(map_arrow(docs, summary, "doc_id long, d long, h long, v binary, n int, near array<int>"), "sets")
    named = seen.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("copies"), F.min(F.struct("d", "h")).alias("at"), F.max("n").alias("n"))
    named = materialize(named.select("v", "copies", "n", "at.d", "at.h"), "classes")
    names = spark.createDataFrame(list(enumerate(sample.names)), "i int, b binary")
    truth = seen.where(F.size("near") > 0).select("v", F.explode("near").alias("i")).distinct().join(F.broadcast(names), "i").where("v <> b").select("v", "b")

    groups, batch_of_runs = None, 0
    while True:
        groups = candidate_groups(docs, named, batch_of_runs, groups)
        met = truth.join(groups, "v", "left").join(groups.select(F.col("v").alias("b"), F.col("label").alias("other")), "b", "left")
        true, reached = met.agg(F.count("*"), F.count(F.when(F.col("label") == F.col("other"), 1))).first()
        batch_of_runs += 1
        if reached >= RECALL * true:
            break

    placed = dealt(groups, named)
    contents = contents_of(placed.select("v"), docs, named)
    tasks = placed.join(contents, "v").select("v", "copies", "content", "label", F.explode("tasks").alias("task")).select("v", "copies", "content", "label", "task.*")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paired = tasks.repartition(width, *TASK).sortWithinPartitions(*TASK, "v").mapInArrow(_join_blocks, PAIRED)
    paired = materialize(paired, "paired")
    discard(contents)
    links = paired.where("v IS NOT NULL").groupBy("v").agg(F.sum("links").alias("other"))
    labels = components(paired.where("a IS NOT NULL").select("a", "b"))
    known = named.select("v", "copies").join(labels, "v", "left").join(links, "v", "left")
    known = known.select("v", F.coalesce("label", "v").alias("label"), (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("links"))
    return materialize(seen.select("doc_id", "d", "h", "v").join(known, "v", "left").drop("v"), "labelled")


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, links`` of every document."""
    labelled = linked(docs)
    least = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return labelled.join(least, "label", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, and of each group of linked documents the one with the smallest id alone. Rows
    without words stay; rows alike in id and text are one."""
    labelled = linked(docs)
    first = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("d", "h")).alias("at")).select("at.d", "at.h")
    kept = first.unionByName(labelled.where("label IS NULL").select("d", "h").distinct())
    kept = materialize(kept, "kept").withColumnsRenamed({"d": "_d", "h": "_h"})
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed_docs = docs.withColumn("_d", F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))).withColumn("_h", F.xxhash64(text))
    return keyed_docs.join(kept, ["_d", "_h"], "left_semi").dropDuplicates(["_d", "_h"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))

#: All pairs that share a shingle: for tables of some thousand documents.
SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 3, 2))]) AS s FROM w WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS MATERIALIZED (SELECT x.r AS a, y.r AS b FROM s x JOIN s y ON x.s = y.s AND x.r <> y.r JOIN n nx ON nx.r = x.r JOIN n ny ON ny.r = y.r GROUP BY x.r, y.r, nx.n, ny.n HAVING count(*) * 5 >= (nx.n + ny.n - count(*)) * 4),
reach(r, o) AS (SELECT r, r FROM w UNION SELECT reach.r, p.b FROM reach JOIN p ON p.a = reach.o),
c AS (SELECT reach.r, min(w.doc_id) AS class_id FROM reach JOIN w ON w.r = reach.o GROUP BY reach.r)
SELECT w.doc_id, c.class_id, (SELECT count(*) FROM p WHERE p.a = w.r)::BIGINT AS links FROM w JOIN c ON c.r = w.r
"""
