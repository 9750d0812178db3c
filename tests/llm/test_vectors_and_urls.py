"""Embedding dedup and URL filter against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.llm import embeddings, registry, urls

SF = "/root/testdata/sf0.01"


def brute_near(rows, least=0.95):
    """n_links and component by all pairs in double precision."""
    ok = [
        v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for _, v in rows
    ]
    unit = [np.array(v, float) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok)]
    links = [
        [j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least]
        for i in range(len(rows))
    ]
    low = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(links):
            new = min([low[i], *(low[j] for j in js)])
            changed |= new != low[i]
            low[i] = new
    return sorted((r[0], len(js), c, r[0] == c) for r, js, c in zip(rows, links, low))


def ours(df):
    return sorted(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def test_embeddings_whole(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = brute_near(rows), ours(registry.op1_embedding_dedup(spark, SF))
    assert len(got) == len(want)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_embeddings_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    near = base[:20] + rng.normal(size=(20, 8)) * 0.02
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near])]
    rows += [(100, None), (101, [0.0] * 8), (102, [None] + [1.0] * 7), (103, [float("nan")] * 8), (104, [float("inf")] * 8), (105, [])]
    rows += [(106, base[0].tolist()), (107, base[0].tolist()), (108, [1.0, 2.0]), (109, [2.0, 4.0]), (110, (base[1] * 1e30).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("vector", F.lit("x"))
    got, want = ours(embeddings.near_groups(df)), brute_near(rows)
    assert got == want
    assert embeddings.near_groups(df.limit(0)).count() == 0


def test_dense_group_is_counted_whole(spark, monkeypatch):
    """More members of one cell than a block: all pairs are counted, stars are emitted."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.01).tolist()) for i in range(2300)]
    rows += [(5000 + i, rng.normal(size=16).tolist()) for i in range(50)]
    got = ours(embeddings.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    # Measured against the contract of the index: nearly all links, one component.
    dense = [r for r in got if r[0] < 2300]
    assert np.mean([r[1] for r in dense]) > 0.97 * 2299
    assert {r[2] for r in dense} == {0}


def test_multi_sequence_order_is_the_true_order():
    rng = np.random.default_rng(8)
    index = embeddings.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)), 12)
    x = rng.normal(size=(30, 6))
    sums = (embeddings.distances(x[:, :3], index.first)[:, :, None] + embeddings.distances(x[:, 3:], index.second)[:, None, :]).reshape(30, -1)
    assert (index.order(x) == np.argsort(sums, axis=1)[:, :12]).all()


def test_ranks_are_places_in_the_order():
    rng = np.random.default_rng(12)
    index = embeddings.MultiIndex(rng.integers(0, 3, (9, 2)) * 1.0, rng.integers(0, 3, (6, 2)) * 1.0, 1)
    x = rng.integers(0, 3, (300, 4)) * 1.0  # whole numbers: many sums are equal
    cells = rng.integers(0, 54, 300)
    assert (index.ranks(x, cells) == (index.order(x, 54) == cells[:, None]).argmax(1)).all()


def test_calibration_never_holds_all_cells_of_all_queries():
    import tracemalloc

    x = embeddings.unit(np.random.default_rng(13).normal(size=(1000, 8)))
    tracemalloc.start()
    embeddings.fit(x, 300, 0.95, 0.99)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * 300**2 * 8 / 4  # a quarter of one array of queries x cells


@pytest.mark.parametrize("dims, rank", [(64, 6), (384, 8)])
def test_recall_of_copies_that_differ_where_the_data_vary(spark, tmp_path, dims, rank):
    """Low-rank vectors, half of them near copies in the same subspace, on a grid of 25 x 25 cells."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(21)
    basis = rng.normal(size=(rank, dims))
    low = rng.normal(size=(10_000, rank))
    away = rng.normal(size=low.shape) * np.linalg.norm(low, axis=1)[:, None] / np.sqrt(rank)
    x = np.concatenate([low, low + 0.28 * away]) @ basis
    flat = pa.array(x.ravel())
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), flat)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": vectors}), tmp_path / "x.parquet")
    want = np.zeros(len(x), int)
    unit = embeddings.unit(x)
    for at in range(0, len(x), 1000):
        want[at : at + 1000] = (unit[at : at + 1000] @ unit.T >= 0.95).sum(1) - 1
    got = embeddings.near_groups(spark.read.parquet(str(tmp_path)), min_cosine=0.95)
    found = {r.vec_id: r.n_links for r in got.select("vec_id", "n_links").collect()}
    found = np.array([found[i] for i in range(len(x))])
    print("links", want.sum(), "recall", found.sum() / want.sum())
    assert want.sum() > 10_000
    assert (found <= want).all()
    assert found.sum() >= 0.99 * want.sum()


# --- URLs -----------------------------------------------------------------------------------


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fit = [
        r for r in registry.URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fit, key=lambda r: len(r.name), default=None)


def brute_verdict(model, host, path):
    from xxhash import xxh64_intdigest

    # Spark hashes several columns by taking the hash of one as the seed of the next.
    buckets, found = len(model.weights) - 1, set()
    for kind, part in (("host", host), ("path", path)):
        seed = xxh64_intdigest(kind.encode(), 42)
        marked = f"<{part}>"
        for n in (2, 3, 4):
            for i in range(len(marked) - n + 1):
                h = xxh64_intdigest(marked[i : i + n].encode(), seed)
                found.add((h - (1 << 64 if h >> 63 else 0)) % buckets)
    grams = [*sorted(found), buckets]
    margin = 0.0
    for g in grams:
        margin += model.weights[g]
    return "block" if margin / np.sqrt(len(grams)) > 0 else "allow"


ODD_URLS = [
    None, "", "no scheme", "http://", "http://COM", "https://com/", "ftp://a.COM/x?y#z", "http://example.com/en/", "http://www.example.com/en/a",
    "http://xexample.com/en/", "http://a.net/es/1", "http://a.net/es", "http://net/fr/?q", "http://a.net?x=/es/", "x://y://com/", "http://ü.ÉXAMPLE.com/",
    "http://com:80/", "http://a.com/" + "x" * 20000, "http://a.org/ES/\nb",
]


@pytest.mark.parametrize("odd", [False, True])
def test_urls(spark, odd):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    ruled = urls.judged(pages, registry.URL_RULES).where("rule_verdict is not null")
    model = urls.train(ruled.select("url", (F.col("rule_verdict") == "block").cast("int").alias("blocked")))
    if odd:
        pages = spark.createDataFrame([*enumerate(ODD_URLS), (5, ODD_URLS[5]), (None, None)], "page_id long, url string")
        pages = pages.withColumn("host", F.lit(1)).withColumn("rule", F.lit("x")).withColumn("grams", F.lit(0))
    rows = {r.page_id: r.url for r in pages.collect()}
    got = urls.filter_urls(pages, registry.URL_RULES, model).collect()
    assert len(got) == pages.count()
    for r in got:
        host, path = brute_parts(rows[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == (rule.verdict if rule else brute_verdict(model, host, path))


def test_url_query_is_repeatable(spark):
    once, again = (sorted(map(tuple, registry.op10_url_filter(spark, SF).collect())) for _ in range(2))
    assert once == again


def test_url_model_learns(spark):
    rows = [(f"http://{'ads' if i % 2 else 'news'}{i}.org/{'buy' if i % 2 else 'read'}/{i}", i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    model = urls.train(labelled.where("cast(substring_index(url, '/', -1) as int) < 300"))
    held = labelled.selectExpr("cast(substring_index(url, '/', -1) as long) page_id", "url").where("page_id >= 300")
    got = urls.filter_urls(held, [], model).collect()
    assert np.mean([r.verdict == ("block" if r.page_id % 2 else "allow") for r in got]) > 0.97


def test_urls_without_rows(spark):
    nothing = spark.createDataFrame([], "url string, blocked int")
    model = urls.train(nothing)
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in urls.filter_urls(pages, [], model).collect()] == ["allow"]
    assert urls.filter_urls(pages.limit(0), [], model).count() == 0
