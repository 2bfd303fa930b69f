"""URL filters: rules by host and path, and gradient-boosted trees on lexical features where no rule fits.

Everything is DataFrame expressions. URLs that a rule decides are the labelled ones; the trees learn from them (up
to about ``FIT_ROWS``, by hash threshold) and judge the rest. Each feature is cut into bins by fixed edges. A tree
grows level by level: one aggregation gives gradients and Hessians by node, feature and bin (a table whose size
doesn't depend on the rows), the driver picks the splits of all nodes of a level, and the tree becomes a CASE
expression. Scoring is one projection.

Suffixes and path sections enter as block rates, tables of all labelled values joined by key. The rules test the same
parts of a URL, so a rate that had seen a URL's own label would hand that label to the trees: a training URL gets the
rates of the other ``FOLDS - 1`` folds, by a hash of its host, so that copies of a host are of one fold. URLs of values that no
labelled URL has get the overall rate, and are judged by their shape.

Null url, or one without ``://``: host and path are empty, no rule fits, the trees judge it by its features (all zero
for null). With no labelled URLs, or those of one class only, every undecided URL gets that class (allow without any).
A very long url is one row as any other. Repeated rows are judged each; equal gains are broken by feature and bin, rules
of equal length by their order. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import materialize, table

FIT_ROWS, FOLDS = 50_000, 5
TREES, DEPTH, RATE, RIDGE = 10, 3, 0.3, 1.0
#: Rules as (verdict, domain, start of the path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Upper edges of the bins of each feature.
EDGES = {
    "length": [15, 25, 32, 36, 40, 44, 48, 52, 56, 60, 70, 80, 100, 150, 250],
    "host_length": [0, 8, 12, 16, 18, 20, 22, 24, 28, 32, 40, 60],
    "depth": [0, 1, 2, 3, 4, 5, 6, 8],
    "host_labels": [0, 1, 2, 3, 4, 5],
    "digit_ratio": [0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3, 0.5],
    "entropy": [1, 2, 2.5, 3, 3.2, 3.4, 3.6, 3.8, 4, 4.2, 4.4, 4.6, 5],
    "parameters": [0, 1, 2, 3, 5],
    "path_digits": [0, 1, 2, 3, 4, 5, 6, 8],
    "hyphens": [0, 1, 2, 3, 5],
    "suffix_block_rate": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95],
    "section_block_rate": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95],
}


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where there is no ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def with_parts(pages: DataFrame) -> DataFrame:
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("")).alias("_url"))
    host, path = parse(F.col("_url"))
    return pages.withColumn("host", host).withColumn("path", path)


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rule`` and ``rule_verdict``: the longest rule that fits; of equal ones the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), -rules.index(r))):
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def with_features(pages: DataFrame) -> DataFrame:
    url, host, path = F.col("_url"), F.col("host"), F.col("path")
    count = lambda text, letters: F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]", ""))
    size = F.greatest(F.length(url), F.lit(1))
    # Shannon entropy of the letters, from run lengths of the sorted letters.
    letters = F.array_sort(F.split(url, ""))
    runs = F.split(F.regexp_replace(F.array_join(letters, ""), r"(?s)(.)(?!\1)", "$1\u0000"), "\u0000")
    entropy = F.aggregate(F.transform(runs, lambda r: F.length(r) / size), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double").alias("depth"),
        F.when(host == "", 0.0).otherwise(count(host, ".") + 1.0).alias("host_labels"),
        (count(url, "0-9") / size).alias("digit_ratio"),
        entropy.alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double").alias("parameters"),
        count(path, "0-9").cast("double").alias("path_digits"),
        count(url, "-").cast("double").alias("hyphens"),
        F.regexp_extract(host, r"[^.]*$", 0).alias("suffix"),
        F.regexp_extract(path, r"^/([^/]*)", 1).alias("section"),
    )


@dataclass
class Filter:
    """A fitted model: tables of rates, one row a value, and trees as nested (feature, edge, left, right) or leaf values.
    Values without a labelled URL get the overall rate."""

    prior: float
    rates: dict[str, DataFrame]
    trees: list
    constant: str | None = None

    def features(self, pages: DataFrame) -> DataFrame:
        for column, rates in self.rates.items():
            rate = f"{column}_block_rate"
            pages = pages.join(rates, column, "left").withColumn(rate, F.coalesce(rate, F.lit(self.prior)))
        return pages


def case(tree, leaf=lambda x: F.lit(float(x))) -> Column:
    if not isinstance(tree, tuple):
        return leaf(tree)
    feature, edge, left, right = tree
    return F.when(F.col(feature) <= edge, case(left, leaf)).otherwise(case(right, leaf))


def _rates(rows: DataFrame, column: str, prior: float) -> tuple[DataFrame, DataFrame]:
    """Block rates of all values of ``column``: of all rows, and for each fold of the rows outside it."""
    by_fold = materialize(rows.groupBy(column, "fold").agg(F.sum("y").alias("y"), F.count("*").alias("n")), f"url-{column}")
    whole = by_fold.groupBy(column).agg(F.sum("y").alias("all_y"), F.sum("n").alias("all_n"))
    rate = lambda y, n: ((y + 20 * prior) / (n + 20)).alias(f"{column}_block_rate")
    y, n = F.col("all_y"), F.col("all_n")
    return whole.select(column, rate(y, n)), by_fold.join(whole, column).select(column, "fold", rate(y - F.col("y"), n - F.col("n")))


def train(labelled: DataFrame, rows: int = FIT_ROWS) -> Filter:
    """``labelled``: features, with ``rule_verdict`` as the label. Rules' own domains and paths aren't features, but
    statistics of suffixes and sections are."""
    there = labelled.agg(F.count("*"), F.coalesce(F.sum((F.col("rule_verdict") == "block").cast("long")), F.lit(0))).first()
    if there[0] == 0 or there[1] in (0, there[0]):
        return Filter(0.5, {}, [], "block" if there[0] and there[1] else "allow")
    labelled = labelled.withColumn("y", (F.col("rule_verdict") == "block").cast("double"))
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    prior = there[1] / there[0]
    model = Filter(prior, {}, [])
    outside = {}
    for c in ("suffix", "section"):  # of all labelled rows
        model.rates[c], outside[c] = _rates(labelled, c, prior)
    if there[0] > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("_url"), F.lit(1 << 20)) < int((1 << 20) * rows / there[0]))
    for c, rates in outside.items():
        labelled = labelled.join(rates, [c, "fold"])
    names = list(EDGES)
    binned = [sum(((F.col(f) > float(e)).cast("int") for e in EDGES[f]), F.lit(0)) for f in names]
    base = math.log(prior / (1 - prior))
    data = materialize(labelled.select("y", *names, F.array(*binned).alias("bins")), "url-fit")
    model.trees.append(base)
    for _ in range(TREES):
        margin = sum((case(t) for t in model.trees[1:]), F.lit(base))
        p = 1 / (1 + F.exp(-margin))
        data_now = data.withColumn("p", p).withColumn("g", F.col("p") - F.col("y")).withColumn("hess", F.col("p") * (1 - F.col("p")))
        model.trees.append(_grow(data_now, names))
    return model


def _grow(data: DataFrame, names: list[str]):
    """One tree: an aggregation a level. A split gives its children's sums, so leaves need none."""
    splits: dict[int, tuple[str, float]] = {}  # node (root 1, children 2n and 2n + 1)
    sums: dict[int, tuple[float, float]] = {}

    def subtree(node, leaf):
        return (*splits[node], subtree(2 * node, leaf), subtree(2 * node + 1, leaf)) if node in splits else leaf(node)

    frontier = [1]
    for _ in range(DEPTH):
        at = case(subtree(1, lambda n: n), lambda n: F.lit(int(n)))
        binned = data.select(at.alias("node"), "g", "hess", F.posexplode("bins").alias("f", "b")).where(F.col("node").isin(frontier)).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("hess").alias("h"))
        got = {(r["node"], r["f"], r["b"]): (r["g"], r["h"]) for r in binned.collect()}  # nodes x features x bins at most
        grown = []
        for node in frontier:
            if node not in sums:
                sums[node] = tuple(sum(v[i] for (n, f, _), v in got.items() if n == node and f == 0) for i in (0, 1))
            all_g, all_h = sums[node]
            best = (1e-6, None, None)
            for f, name in enumerate(names):
                g = h = 0.0
                for b, edge in enumerate(EDGES[name]):
                    dg, dh = got.get((node, f, b), (0.0, 0.0))
                    g, h = g + dg, h + dh
                    if min(h, all_h - h) < 1:
                        continue
                    gain = g * g / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, float(edge)), (g, h))
            if best[1]:
                splits[node] = best[1]
                sums[2 * node], sums[2 * node + 1] = best[2], (all_g - best[2][0], all_h - best[2][1])
                grown += [2 * node, 2 * node + 1]
        frontier = grown
        if not frontier:
            break
    return subtree(1, lambda n: -RATE * sums[n][0] / (sums[n][1] + RIDGE))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of every URL."""
    seen = with_features(with_rule(with_parts(pages), rules))
    model = train(seen.where("rule IS NOT NULL"))
    if model.constant:
        score = F.lit(float(model.constant == "block"))
        scored = seen
    else:
        scored = model.features(seen)
        score = 1 / (1 + F.exp(-sum((case(t) for t in model.trees[1:]), F.lit(float(model.trees[0])))))
    scored = scored.withColumn("block_score", score)
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
