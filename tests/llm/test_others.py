"""Nearest neighbours, URL filters, quality, components and the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import decontaminate, neighbours, pii, quality, registry, similarity_join, url_filters
from gridloom.llm.components import components
from gridloom.llm.shared import materialize
from tests.llm import data

DATA = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 200)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 3


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, x string").select("*")


def test_neighbours_are_found(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=(900, 16)).astype(np.float32)
    a[300:600] = a[300]  # a vector that a third of the rows share
    a[600:610] *= 5  # norms differ
    odd = [(2000, None, 0.0, ""), (2020, [0.0] * 16, 0.0, ""), (2040, [float("nan")] + [1.0] * 15, 0.0, ""), (2060, [1.0, None] + [1.0] * 14, 0.0, ""), (None, [1.0] * 16, 0.0, ""), (2081, [1.0], 0.0, "")]
    rows = [(i, v.tolist(), 0.0, "") for i, v in enumerate(a)]
    got = neighbours.search(vectors(spark, rows + odd)).collect()
    x = np.vstack([a.astype(float), np.zeros((1182, 16))])
    x[2081, 0] = 1.0  # followed by zeros
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append(g)
    assert set(by) == set(range(0, 900, 20))
    hits = []
    for q, found in by.items():
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(2082), -s)) if i != q and (i < 900 or i == 2081)][:20]
        found = sorted(found, key=lambda g: g.rank)
        assert [g.rank for g in found] == list(range(1, 21)) and all(abs(g.score - s[g.vec_id]) < 1e-12 * max(1, abs(s[g.vec_id])) for g in found)
        assert found == sorted(found, key=lambda g: (-g.score, g.vec_id)) and q not in {g.vec_id for g in found}
        hits.append(len(set(order) & {g.vec_id for g in found}) / 20)
    assert np.mean(hits) >= 0.9


def test_neighbours_of_few_or_no_rows(spark):
    few = neighbours.search(vectors(spark, [(0, [1.0, 0.0], 0.0, ""), (1, [0.5, 0.5], 0.0, ""), (2, [0.5, 0.5], 0.0, "")])).collect()
    assert [(g.query_id, g.rank, g.vec_id, g.score) for g in sorted(few, key=lambda g: g.rank)] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert neighbours.search(vectors(spark, [])).count() == 0


def test_rows_of_one_id_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0], 0.0, ""), (20, [0.0, 1.0], 0.0, ""), (20, [0.0, 1.0], 0.0, ""), (7, [0.5, 0.25], 0.0, "")]
    got = Counter((g.query_id, g.rank, g.vec_id, g.score) for g in neighbours.search(vectors(spark, rows)).collect())
    first = [(20, 1, 7, 0.5), (20, 2, 20, 0.0), (20, 3, 20, 0.0)]
    second = [(20, 1, 20, 1.0), (20, 2, 7, 0.25), (20, 3, 20, 0.0)]
    assert got == Counter([*first, *second, *second])


def test_small_leaves_and_large_pages_give_enough_rows(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 8)) * 10
    x = np.concatenate([centres[i] + r.normal(size=(9, 8)) * 0.01 for i in range(40)])
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 4)
    monkeypatch.setattr(neighbours, "PAGE_ROWS", 20)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    monkeypatch.setattr(neighbours, "calibrate", lambda *a: 1)  # a walk goes on until there are enough
    got = Counter(g.query_id for g in neighbours.search(vectors(spark, [(i, v.tolist(), 0.0, "") for i, v in enumerate(x)])).collect())
    assert got == {i: 20 for i in range(0, 360, 20)}


def test_registered_neighbours_reach_the_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = Counter((g.query_id, g.vec_id) for g in neighbours.op3_nearest_neighbours(spark, DATA).collect())
    hits = total = 0
    for n in np.flatnonzero(ids % 20 == 0):
        s = x @ x[n]
        s[n] = -np.inf
        for v in ids[np.argsort(-s)[:20]]:
            hits += got[ids[n], v]
            total += 1
    assert hits / total >= 0.9


# ---- 6


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(d + p, v) for v, d, p in url_filters.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, max(fit, key=lambda r: len(r[0]), default=(None, None))


def test_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/en/12?q=1", "a://example.org", "http://example.org/es/", "http://notexample.org/es/x", "x://y://com/fr/", "http://a.com/de/1#f", "http://É.COM/fr/", "http://com?x", "http://org/", "http://b.org/a?u=http://c.com/de/", "http://net/%20" + "a-1" * 500]
    rows = [(i, u, "h", "s") for i, u in enumerate(urls)] + [(100 + i, f"http://s{i % 7}.example.{'com' if i % 3 else 'org'}/{'de' if i % 2 else 'fr'}/{i}", "h", "s") for i in range(200)] + [(0, None, "h", "s")]
    spark.createDataFrame(rows, "page_id long, url string, html string, host string").write.parquet(str(tmp_path / "pages.parquet"))
    got = url_filters.op6_url_filters(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    of = {r[0]: r[1] for r in rows}
    for g in got:
        host, path, (rule, verdict) = judged(of[g.page_id])
        assert (g.host, g.path, g.rule) == (host, path, rule), of[g.page_id]
        assert g.verdict == verdict if verdict else g.verdict in ("allow", "block")


def test_trees_learn_the_rules(spark):
    pages = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/pages.parquet")
    seen = materialize(url_filters.with_features(url_filters.with_rule(url_filters.with_parts(pages), url_filters.RULES)), "seen").where("rule IS NOT NULL")
    model = url_filters.train(seen.where("page_id % 3 <> 0"))
    from pyspark.sql import functions as F

    margin = sum((url_filters.case(t) for t in model.trees[1:]), F.lit(float(model.trees[0])))
    test = model.features(seen.where("page_id % 3 = 0")).select((margin > 0).alias("p"), (F.col("rule_verdict") == "block").alias("y")).collect()
    assert len(test) > 200 and np.mean([r.p == r.y for r in test]) > 0.85


def test_trees_judge_suffixes_that_no_rule_has(spark):
    """Blocked URLs have long digits; suffixes of the judged ones were never labelled."""
    url = lambda i, suffix: f"http://h{i % 50}.{suffix}/{'p/' + str(10**9 + i * 7919) if i % 2 else 'words-of-a-title'}"
    rules = [("block", "com", "/p/"), ("allow", "com", "/w"), ("block", "fr", "/p/"), ("allow", "fr", "/w")]
    rows = [(i, url(i, "com" if i % 3 else "fr")) for i in range(600)] + [(1000 + i, url(i, ("xyz", "dev")[i % 3 % 2])) for i in range(200)]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    unseen = [got[1000 + i] for i in range(200)]
    assert all(r.rule is None for r in unseen) and np.mean([(r.verdict == "block") == (r.page_id % 2 == 1) for r in unseen]) > 0.95


def test_rates_leave_out_a_urls_own_fold(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(f"s{i % 3}", i % 2 * 1.0, i % 5) for i in range(300)], "suffix string, y double, fold long")
    whole, outside = url_filters._rates(rows, "suffix", 0.5)
    data_ = [(f"s{i % 3}", i % 2, i % 5) for i in range(300)]
    for r in outside.collect():
        mine = [y for s, y, f in data_ if s == r.suffix and f != r.fold]
        assert abs(r.suffix_block_rate - (sum(mine) + 10) / (len(mine) + 20)) < 1e-12
    assert whole.where(F.abs(F.col("suffix_block_rate") - 0.5) > 1e-12).count() == 0 and outside.count() == 15


def test_a_tree_by_exhaustive_search(spark):
    """Every split of a tree against a search over all features and edges on the rows."""
    r = np.random.default_rng(4)
    names = list(url_filters.EDGES)
    x = np.column_stack([r.choice([*url_filters.EDGES[f], url_filters.EDGES[f][-1] + 1], 400) for f in names]).astype(float)
    y = (x[:, 0] + r.normal(size=400) * 10 > 45).astype(float)
    g, h = 0.4 - y, np.full(400, 0.24)

    def grow(rows, depth):
        total = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for f, name in enumerate(names if depth else []):
            for edge in url_filters.EDGES[name]:
                left = rows[x[rows, f] <= edge]
                a, b = g[left].sum(), h[left].sum()
                if min(b, total[1] - b) < 1:
                    continue
                gain = a * a / (b + url_filters.RIDGE) + (total[0] - a) ** 2 / (total[1] - b + url_filters.RIDGE) - total[0] ** 2 / (total[1] + url_filters.RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, edge))
        if best[1] is None:
            return -url_filters.RATE * total[0] / (total[1] + url_filters.RIDGE)
        f, edge = best[1]
        return (names[f], float(edge), grow(rows[x[rows, f] <= edge], depth - 1), grow(rows[x[rows, f] > edge], depth - 1))

    bins = [[int(sum(v > e for e in url_filters.EDGES[f])) for f, v in zip(names, row)] for row in x]
    table = spark.createDataFrame([(float(a), float(b), c, *map(float, row)) for a, b, c, row in zip(g, h, bins, x)], "g double, hess double, bins array<int>, " + ", ".join(f"{n} double" for n in names))
    want, got = grow(np.arange(400), url_filters.DEPTH), url_filters._grow(table, names)

    def alike(a, b):
        return a[:2] == b[:2] and alike(a[2], b[2]) and alike(a[3], b[3]) if isinstance(a, tuple) and isinstance(b, tuple) else abs(a - b) < 1e-9

    assert alike(want, got), (want, got)


def test_urls_without_labels(spark):
    one = spark.createDataFrame([(1, "http://x.net/a")], "page_id long, url string")
    assert [r.verdict for r in url_filters.judge(one).collect()] == ["allow"]
    assert url_filters.judge(one.limit(0)).count() == 0


def test_every_section_has_its_rate(spark):
    from pyspark.sql import functions as F

    urls = [(i, f"http://a.{'com' if i % 400 % 2 else 'org'}/s{i % 400}/{i}", "block" if i % 400 % 2 else "allow") for i in range(1200)]
    pages = url_filters.with_features(url_filters.with_parts(spark.createDataFrame(urls, "page_id long, url string, v string")))
    seen = pages.withColumn("rule_verdict", F.when(F.col("section").substr(2, 9).cast("int") % 2 == 1, "block").otherwise("allow"))
    for rows in (50_000, 100):  # a smaller fit leaves no value out
        model = url_filters.train(seen, rows)
        got = {r.section: r.section_block_rate for r in model.features(pages).collect()}
        assert len(got) == 400 and all(abs(x - (3 * (int(s[1:]) % 2) + 10) / 23) < 1e-9 for s, x in got.items())


# ---- 10


@pytest.fixture(scope="module")
def scored(spark):
    return quality.op10_quality_classifier(spark, DATA.replace("0.001", "0.01")).collect()


def test_quality_on_the_held_out_fold(spark, scored):
    import zlib

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet").collect()}
    assert all(s.held_out == (zlib.crc32(str(s.doc_id).encode()) % 4 == 2) and 0 <= s.score <= 1 and s.predicted == int(s.score >= 0.7) for s in scored)
    test = [s for s in scored if s.held_out and s.doc_id in labels]
    assert len(test) > 60 and np.mean([s.predicted == labels[s.doc_id] for s in test]) > 0.93


def test_quality_of_awkward_rows(spark):
    docs = data.frame(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 40)] + [(21, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model)
    assert out.columns == [*docs.columns, "_score"] and out.count() == len(data.texts()) and out.where("_score IS NULL OR isnan(_score)").count() == 0
    assert quality.train(docs, labels.limit(0)).constant == 0.5 and quality.train(docs, labels.where("quality = 1")).constant == 1.0
    assert quality.score(docs.limit(0), model).count() == 0


def test_discriminant_by_dense_algebra():
    """Margins and scores against log densities from determinants and inverses, with weights as repeated rows."""
    r = np.random.default_rng(6)
    n = quality.N_STATS
    x = np.concatenate([r.normal(size=(80, n)), r.normal(size=(60, n)) * 1.5 + 0.7])
    y = np.repeat([0, 1], [80, 60])
    times = r.integers(1, 4, 140)
    model = quality.fit(x, y, times)
    rows, labels = np.repeat(x, times, axis=0), np.repeat(y, times)
    z = (rows - rows.mean(0)) / rows.std(0)
    parts = [z[labels == c] for c in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(c * len(p) for c, p in zip(covs, parts)) / len(z)
    q = (x - rows.mean(0)) / rows.std(0)
    log = []
    for p, c in zip(parts, covs):
        s = (1 - quality.SHRINK) * c + quality.SHRINK / 2 * (pooled + np.diag(np.diag(pooled))) + quality.RIDGE * np.eye(n)
        d = q - p.mean(0)
        log.append(np.log(len(p) / len(z)) - np.linalg.slogdet(s)[1] / 2 - np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) / 2)
    assert np.allclose(model.margin(x), log[1] - log[0])
    again = quality.fit(rows, labels)
    assert np.allclose(model.score(x), again.score(x), atol=1e-6)


# ---- the pipeline


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.7").collect()}
    now = materialize(corpus_pipeline.STAGES[0][1](spark, docs, DATA), "t")
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == good
    classes = {r.class_id for r in similarity_join.join(now).collect()}
    now = materialize(corpus_pipeline.STAGES[1][1](spark, now, DATA), "t")
    assert now.columns == docs.columns and sorted(r.doc_id for r in now.collect()) == sorted(classes)
    bad = {r.doc_id for r in decontaminate.find_contaminated(now, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    now = materialize(corpus_pipeline.STAGES[2][1](spark, now, DATA), "t")
    assert {r.doc_id for r in now.collect()} == classes - bad
    private = {r.doc_id for r in pii.detect(now).where("size(spans) > 0").collect()}
    before = {r.doc_id: r.text for r in now.collect()}
    now = materialize(corpus_pipeline.STAGES[3][1](spark, now, DATA), "t")
    after = {r.doc_id: r.text for r in now.collect()}
    assert private and {i for i in before if before[i] != after[i]} == private
    assert pii.detect(now).where("size(base_spans) > 0").count() == 0
    packed = corpus_pipeline.STAGES[4][1](spark, now, DATA)
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, data.words(900, 40))], "item_id long, text string")
    for rows in (None, []):
        folder = data.save(spark, tmp_path / str(rows is None), rows, labels=labels, benchmark=items)
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, folder), "t")
        assert docs.count() > 0 if rows is None else docs.count() == 0


def test_registry():
    import __spark_entry__ as entry

    assert [k.split("_")[0] for k in registry.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert {*registry.QUERIES, "pipeline"} <= set(entry.queries())


def test_decontamination_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    got = sorted(map(tuple, decontaminate.op4_decontaminate(spark, DATA).select("doc_id", "item_id", "n_item", "n_shared", "containment").collect()))
    assert got == sorted(con.execute(decontaminate.SQL).fetchall())
