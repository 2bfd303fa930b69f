"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance, shrunk towards the pooled covariance and its diagonal; a document's margin is
the difference of the classes' Gaussian log densities and log priors, from Mahalanobis distances by cached Cholesky
factors. A logistic curve fitted to the training margins turns it into a score from 0 to 1.

The model is fitted on the labelled rows outside the held-out fold; beyond ``FIT_ROWS`` of them, on those whose hash
falls under the threshold that keeps about so many. Statistics are of whole texts and every document is scored.
Labels, language, source and id are never inputs.

Null or empty text: scored, by statistics of zero. Null labels don't count; a row labelled twice counts twice. With no
labels of one class every score is 1 or 0 by the other class, and 1/2 without any label. A very long text is a block of
its own. Ties: equal statistics give equal scores, and so do repeated rows. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import Words, cut, documents, map_arrow, table, text_bytes

#: Labelled rows that a model is fitted on, at most (on average over hash thresholds).
FIT_ROWS = 50_000
KEEP_SCORE = 0.7
SHRINK, RIDGE = 0.1, 1e-3


def _mask(letters: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in letters]] = 1
    return out


# Byte classes.
UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = UPPER + _mask("abcdefghijklmnopqrstuvwxyz")
LETTER[128:] = 1
CLASSES = np.stack([UPPER, _mask("0123456789"), _mask("#$%&*+<=>@\\^_`~{}[]"), _mask("!?"), _mask("|"), _mask(".,;:"), _mask("\n"), _mask("/\"'()-"), (np.arange(256) >= 128).astype(float), LETTER])
N_STATS = 15


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text of a block."""
    rows = len(offsets) - 1
    counts = np.stack([np.bincount(raw[offsets[r] : offsets[r + 1]], minlength=256) for r in range(rows)]) if rows else np.zeros((0, 256))
    size = np.maximum(np.diff(offsets), 1)
    shares = counts @ CLASSES.T / size[:, None]
    upper = counts @ UPPER / np.maximum(counts @ LETTER, 1)
    words = Words(raw, offsets)
    n = np.maximum(words.count, 1)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(words.doc, length, rows) / n
    spread = np.sqrt(np.maximum(np.bincount(words.doc, length**2, rows) / n - mean**2, 0))
    same = (words.code[1:] == words.code[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = np.bincount(words.doc[1:][same], minlength=rows) / n
    order = np.lexsort((words.code, words.doc))
    doc, code = words.doc[order], words.code[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    distinct = np.bincount(doc[fresh], minlength=rows)
    # The longest run of one word, as a share.
    variety = np.log1p(distinct) - 0.8 * np.log1p(words.count)
    return np.column_stack([np.log1p(words.count), np.sqrt(upper), np.sqrt(shares[:, 1:9]), shares[:, 9], np.log1p(mean), np.log1p(spread), np.sqrt(repeats), variety])


@dataclass
class Quadratic:
    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverses of the Cholesky factors
    constants: list[float]
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None  # the score of everything, where a class is missing

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        log = [k - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, k in zip(self.means, self.factors, self.constants)]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        t = self.slope * self.margin(x) + self.shift
        return 1 / (1 + np.exp(-np.clip(t, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> Quadratic:
    """``times``: how often each row counts."""
    times = np.ones(len(y)) if times is None else times.astype(float)
    if min(times[y == 0].sum(), times[y == 1].sum()) < 2:
        return Quadratic(np.zeros(N_STATS), np.ones(N_STATS), [], [], [], constant=float(np.average(y, weights=times)) if len(y) else 0.5)
    order = np.lexsort((*x.T, y))  # sums don't depend on the order in which rows arrive
    x, y, times = x[order], y[order], times[order]
    center = np.average(x, axis=0, weights=times)
    scale = np.maximum(np.sqrt(np.average((x - center) ** 2, axis=0, weights=times)), 1e-6)
    z = (x - center) / scale
    means, covs, shares = [], [], []
    for c in (0, 1):
        part, w = z[y == c], times[y == c]
        means.append(np.average(part, axis=0, weights=w))
        covs.append(((part - means[-1]) * w[:, None]).T @ (part - means[-1]) / w.sum())
        shares.append(w.sum() / times.sum())
    pooled = sum(c * share for c, share in zip(covs, shares))
    factors, constants = [], []
    for c, share in zip(covs, shares):
        shrunk = (1 - SHRINK) * c + SHRINK / 2 * (pooled + np.diag(np.diag(pooled))) + RIDGE * np.eye(len(c))
        low = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(low))
        constants.append(float(np.log(share) - np.log(np.diag(low)).sum()))
    model = Quadratic(center, scale, means, factors, constants)
    m = model.margin(x)
    unit = float(np.average(np.abs(m), weights=times)) or 1.0
    t = np.clip(m / unit, -30, 30)
    w = np.zeros(2)
    design = np.column_stack([t, np.ones_like(t)])
    for _ in range(50):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-design @ w))
        g = design.T @ (times * (p - y)) + 1e-2 * w
        h = (design * (times * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = max(w[0], 1e-3) / unit, w[1]
    return model


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Quadratic:
    """Fits on the labelled rows of the training fold."""
    labels = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)").where(~held_out("label_id"))
    labels = labels.groupBy("label_id", "quality").agg(F.count("*").alias("times"))  # an id that is repeated is one row
    there = labels.count()
    if there > rows:
        labels = labels.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int((1 << 20) * rows / there))
    docs = documents(docs)
    labelled = docs.join(F.broadcast(labels), docs["doc_id"] == labels["label_id"]).select("text", "quality", "times")  # about ``rows`` labels at most

    def run(batch: pa.RecordBatch):
        x = statistics(*text_bytes(batch.column("text")))
        yield {"quality": batch.column("quality"), "times": batch.column("times"), "stats": pa.array(x.tolist(), pa.list_(pa.float64()))}

    got = map_arrow(labelled, run, "quality int, times long, stats array<double>").groupBy("quality", "stats").agg(F.sum("times").alias("times")).toArrow()  # equal texts are one row
    x = np.array(got["stats"].to_pylist(), float).reshape(-1, N_STATS)
    return fit(x, got["quality"].to_numpy(), got["times"].to_numpy())


def score(docs: DataFrame, model: Quadratic) -> DataFrame:
    """``docs`` with all its columns and a ``score`` (named ``_score`` if that name is taken)."""
    name = "_score" if "score" in docs.columns else "score"
    from pyspark.sql.types import DoubleType, StructType

    def run(batches):
        for whole in batches:
            for batch in cut(whole):
                text = batch.column("text").cast(pa.string()).fill_null("")
                x = statistics(*text_bytes(text))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, name])

    schema = StructType([*docs.schema.fields]).add(name, DoubleType(), False)
    return docs.mapInArrow(run, schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(documents(docs), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))
