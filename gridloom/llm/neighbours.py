"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, searched best bin first.

Inner products become distances by one more coordinate (sqrt(M^2 - |x|^2), M the largest norm; 0 for queries). The tree
is fitted to at most about ``FIT_ROWS`` rows, by hash threshold, down to leaves of ``LEAF_ROWS`` of them; every row is put
in a leaf. A query walks the tree by a priority queue of nodes, those first whose centre's direction it fits best, and
visits leaves in that order. How many is calibrated: for ``CALIBRATION`` queries the true neighbours come from a scan of
all rows, and the visits are widened, doubling first, until ``RECALL`` of these neighbours lie in visited leaves. A walk
goes on beyond that until its leaves hold enough rows to return.

Leaves are small, so that a query sees few rows; they are stored in pages of about ``PAGE_ROWS`` rows, neighbours in the
tree together, and a query goes to a page once, with the list of leaves that it visits there. A leaf beyond a page's size
is dealt to several pages, a page with many queries serves them in blocks. Equal vectors are indexed once with their
smallest ids, one more than a query can ask for, so a vector that a third of all rows share costs no more than another.
Scores are sums of products in double precision over the original vectors, in a fixed order.

Vectors that are null, empty, zero or hold null or non-finite parts take no part, nor do rows without an id. A vector
shorter than others counts as followed by zeros. Rows of one id are rows of their own: each is a query, and a candidate
for the others. Equal scores go by smaller id. Fewer rows than asked for: all of them. There are no texts. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import materialize, table

FIT_ROWS, CALIBRATION, RECALL = 32_000, 256, 0.93
BRANCHES, LEAF_ROWS = 8, 48
K, EVERY = 20, 20
PAGE_ROWS, QUERY_BLOCK = 4096, 1024


class Tree:
    """Nodes as arrays: ``way`` (a centre's direction), ``children`` (their numbers), ``leaf`` (or -1)."""

    def __init__(self, x: np.ndarray, norm: float, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        self.norm, self.leaves = norm, 0
        self.random = np.random.default_rng(seed)
        self.centre: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self._grow(self.lift(x), leaf_rows)
        centre = np.array(self.centre)
        self.way = (centre / np.maximum(np.sqrt((centre * centre).sum(1)), 1e-300)[:, None])[:, :-1]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))])

    def _grow(self, x: np.ndarray, leaf_rows: int) -> int:
        me = len(self.centre)
        self.centre.append(x.mean(0))
        self.children.append([])
        self.leaf.append(-1)
        if len(x) > leaf_rows:
            near = _nearest(x, self._kmeans(x))
            parts = [x[near == c] for c in np.unique(near)]
            if len(parts) > 1:
                self.children[me] = [self._grow(p, leaf_rows) for p in parts]
                return me
        self.leaf[me] = self.leaves
        self.leaves += 1
        return me

    def _kmeans(self, x: np.ndarray) -> np.ndarray:
        centres = x[self.random.choice(len(x), min(BRANCHES, len(x)), replace=False)]
        for _ in range(8):
            near = _nearest(x, centres)
            centres = np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        return centres

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        lifted = self.lift(x) if len(x) else x
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = _nearest(lifted[rows], np.stack([self.centre[c] for c in self.children[node]]))
            todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visit(self, q: np.ndarray, most: int, rows: np.ndarray | None = None, enough: int = 0) -> list[int]:
        """The first leaves of a query, best bin first: ``most`` of them, and on until they hold ``enough`` rows."""
        cost = (-(self.way @ q)).tolist()
        queue, out, held = [(cost[0], 0)], [], 0
        while queue and (len(out) < most or held < enough):
            node = heapq.heappop(queue)[1]
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += rows[self.leaf[node]] if rows is not None else 0
            for child in self.children[node]:
                heapq.heappush(queue, (cost[child], child))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that take part, all of one length."""
    x = F.col("x")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    rows = rows.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0))
    wide = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.withColumn("x", F.when(F.size("x") == wide, x).otherwise(F.concat(x, F.array_repeat(F.lit(0.0), F.lit(wide) - F.size("x")))))


def _matrix(column) -> np.ndarray:
    return np.array(list(column), float) if len(column) else np.zeros((0, 1))


def best(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: list, k: int, rough: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Each query's ``k`` best ids: (query number, id, score); of all rows, or of those whose ``rough`` score is finite. A
    query's own row, which is one of its id with its vector, is left out."""
    rough = q @ x.T if rough is None else rough
    out = []
    for i in range(len(q)):
        keep = min(rough.shape[1], k + 1)  # one more than asked for: the own row may be among them
        least = np.partition(rough[i], rough.shape[1] - keep)[rough.shape[1] - keep]
        near = np.flatnonzero((rough[i] >= least - 1e-9 * max(1.0, abs(least))) & (rough[i] > -np.inf)) if least > -np.inf else np.flatnonzero(rough[i] > -np.inf)
        exact = np.add.reduce(x[near] * q[i], axis=1)
        found = []
        for s, r in zip(exact.tolist(), near.tolist()):
            here = [int(v) for v in ids[r]]
            if own[i] in here and (x[r] == q[i]).all():
                here.remove(own[i])
            found += [(-s, v) for v in here]
        out += [(i, v, -s) for s, v in sorted(found)[:k]]
    return out


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``x, ids``: each distinct vector with its ``k + 1`` smallest ids. The limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= k + 1)
    return few.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Pages:
    """Which pages hold each leaf: ``first`` and ``many``, from the rows of each leaf."""

    def __init__(self, rows: np.ndarray, page_rows: int = PAGE_ROWS):
        self.first, self.many = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
        page, held = 0, 0
        for leaf, n in enumerate(rows.tolist()):
            if held and held + n > page_rows:
                page, held = page + 1, 0
            self.first[leaf] = page
            held += n
            if n > page_rows:
                self.many[leaf] = -(-n // page_rows)
                page, held = page + int(self.many[leaf]), 0


SCORED = "query_id long, twin int, times long, vec_id long, score double"


def search(vectors: DataFrame, k: int = K, every: int = EVERY, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    index = materialize(classes(rows, k), "vector-classes")
    n, norm = index.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = F.pmod(F.xxhash64("x"), F.lit(1 << 20))
    sample = index.where(part < int(min(1.0, FIT_ROWS / n) * (1 << 20)) + (n <= FIT_ROWS)).select("x").toPandas()
    if not len(sample):
        sample = index.select("x").limit(1).toPandas()
    fitted = _matrix(sample["x"])
    tree = Tree(fitted[np.lexsort(fitted.T)], float(np.sqrt(norm)))

    def place(batches):
        for b in batches:
            yield b.assign(leaf=tree.place(_matrix(b["x"])))

    placed = materialize(index.mapInPandas(place, "x array<double>, ids array<long>, leaf long"), "leaves")
    # Rows alike in id and vector ask alike (``times``); other rows of one id are twins.
    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "x").agg(F.count("*").alias("times"))
    queries = materialize(queries.withColumn("twin", F.row_number().over(Window.partitionBy("query_id").orderBy("x"))), "queries")
    visits = calibrate(queries, placed, tree, k, recall)

    sizes = np.zeros((2, tree.leaves), np.int64)
    for leaf, many, held in placed.groupBy("leaf").agg(F.count("*"), F.sum(F.size("ids"))).collect():  # bounded by the sample
        sizes[:, leaf] = many, held
    pages = Pages(sizes[0])

    def walk(batches):
        for b in batches:
            out = []
            for i, twin, times, q, x in zip(b["query_id"], b["twin"], b["times"], _matrix(b["x"]), b["x"]):
                leaves = np.array(tree.visit(q, visits, sizes[1], k + 1), np.int32)
                first, many = pages.first[leaves], pages.many[leaves]
                for page in np.unique(first).tolist():
                    here = first == page
                    mine = leaves[here].tobytes()
                    out += [(page + p, i, twin, times, x, mine if p == 0 else leaves[here & (many > p)].tobytes()) for p in range(int(many[here].max()))]
            yield pd.DataFrame(out, columns=["page", "query_id", "twin", "times", "x", "leaves"])

    asked = materialize(queries.mapInPandas(walk, "page long, query_id long, twin int, times long, x array<double>, leaves binary"), "visits")
    lists = asked.groupBy("page").count().collect()  # as many as pages
    chunks = spark.createDataFrame([(r[0], -(-r[1] // QUERY_BLOCK)) for r in lists] or [(-1, 1)], "page long, chunks long")
    where = spark.createDataFrame(list(enumerate(zip(pages.first.tolist(), pages.many.tolist()))), "leaf long, at struct<first:long,many:long>")
    asked = asked.join(chunks, "page").withColumn("chunk", F.pmod(F.xxhash64("query_id", "twin"), F.col("chunks")))
    stored = placed.join(where, "leaf").withColumn("page", F.col("at.first") + F.pmod(F.xxhash64("x"), F.col("at.many"))).drop("at")
    stored = stored.join(chunks, "page").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("leaf", kind="stable")
            q, x, leaf = _matrix(left["x"]), _matrix(right["x"]), right["leaf"].to_numpy()
            lists = [np.frombuffer(v, np.int32) for v in left["leaves"]]
            who = np.repeat(np.arange(len(left)), [len(v) for v in lists])
            wanted = np.concatenate(lists)
            order = np.argsort(wanted, kind="stable")
            who, wanted = who[order], wanted[order]
            rough = np.full((len(q), len(x)), -np.inf)
            for one in np.unique(leaf).tolist():
                a, b = np.searchsorted(leaf, [one, one + 1])
                u, v = np.searchsorted(wanted, [one, one + 1])
                if v > u:
                    rough[who[u:v], a:b] = q[who[u:v]] @ x[a:b].T
            found = best(q, left["query_id"].to_numpy(), x, list(right["ids"]), k, rough)
        at = [f[0] for f in found]
        names = ["query_id", "twin", "times"]
        out = left[names].iloc[at].reset_index(drop=True) if found else pd.DataFrame({c: [] for c in names})
        return out.assign(vec_id=[f[1] for f in found], score=[f[2] for f in found]).astype({"query_id": "int64", "twin": "int32", "times": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["page", "chunk"]
    found = asked.select(*keys, "query_id", "twin", "times", "x", "leaves").groupBy(*keys).cogroup(stored.select(*keys, "leaf", "x", "ids").groupBy(*keys)).applyInPandas(meet, SCORED)
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id"))
    near = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return near.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def calibrate(queries: DataFrame, placed: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """How many leaves to visit so that ``recall`` of the true neighbours of a sample of queries is found."""
    some = queries.orderBy(F.xxhash64("query_id"), "twin").limit(CALIBRATION).toPandas()
    q, own = _matrix(some["x"]), some["query_id"].to_numpy()
    if not len(q):
        return 1

    def scan(batches):
        for b in batches:
            x, ids = _matrix(b["x"]), list(b["ids"])
            leaf_of = {int(v): int(leaf) for leaf, vs in zip(b["leaf"], ids) for v in vs}
            found = best(q, own, x, ids, k) if len(x) else []
            yield pd.DataFrame([(i, v, s, leaf_of[v]) for i, v, s in found], columns=["who", "vec_id", "score", "leaf"]).astype({"who": "int64", "vec_id": "int64", "score": "float64", "leaf": "int64"})

    rank = F.row_number().over(Window.partitionBy("who").orderBy(F.desc("score"), "vec_id"))
    true = placed.mapInPandas(scan, "who long, vec_id long, score double, leaf long").withColumn("rank", rank).where(F.col("rank") <= k).toPandas()
    place = np.zeros(len(true), np.int64)
    for i in range(len(q)):
        at = np.zeros(tree.leaves, np.int64)
        at[tree.visit(q[i], tree.leaves)] = np.arange(tree.leaves)
        mine = (true["who"] == i).to_numpy()
        place[mine] = at[true["leaf"].to_numpy()[mine]]
    visits = 1
    while len(place) and (place < visits).mean() < recall and visits < tree.leaves:
        visits = min(visits * 2, tree.leaves)
    low = visits // 2
    while visits - low > 1:  # the fewest that reach it
        middle = (low + visits) // 2
        low, visits = (low, middle) if (place < middle).mean() >= recall else (middle, visits)
    return visits


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
