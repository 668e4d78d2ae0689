"""Sharding, URL rules, nearest neighbours, exact top-k: brute force and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import sharding, topk, urlfilter, vptree

DOCS = "doc_id bigint, text string, place string, shard int, bytes bigint"


def documents(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], DOCS)


def test_shards_are_even_and_gapless(spark):
    rows = [(i, "é" * (i % 37) + "x" * (i * i % 501)) for i in range(3000)] + [(9000, None), (9001, ""), (9002, "y" * 30_000), (None, "a"), (None, "a"), (5, "x"), (5, "x")]
    got = sharding.sharded(documents(spark, rows).repartition(7), 40).collect()
    assert sorted((r["id"] or -1, r["size"], r["crc"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    held, places = {}, {}
    for r in got:
        held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len(held) == 40
    mean = sum(held.values()) / 40
    assert sorted(held.values())[-2] < 1.02 * mean or max(held.values()) == 30_016


def test_growing_a_map_moves_slots_into_the_new_shard_only():
    rng = np.random.default_rng(1)
    size = [int(x) for x in rng.integers(0, 1000, 512)]
    first = sharding.rebalanced(sharding.uniform_map(8, 512), size, 8)
    more = sharding.grown(first, size, 8)
    assert all(a == b or b == 8 for a, b in zip(first, more))
    load = [sum(s for s, k in zip(size, more) if k == x) for x in range(9)]
    assert 0.8 * sum(load) / 9 < load[8] <= sum(load) / 9


def test_stored_maps_have_versions(spark):
    maps = sharding.slot_maps(spark, [5, 1, 1, 1, 1, 1, 0, 0], 2)
    assert {r["version"] for r in maps.select("version").distinct().collect()} == {1, 2, 3}
    assert maps.count() == 24


def test_sharding_nothing(spark):
    assert sharding.sharded(documents(spark, []), 40).count() == 0


def judged(url, rules, unlisted):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0] if rest[cut:cut + 1] == "/" else ""
    fits = [(h, p) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], rules[best] if best else unlisted


RULES = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block", ("a.b.c", ""): "block"}


@pytest.mark.parametrize("max_bytes", [urlfilter.MAX_BYTES, 0])
def test_urls_equal_brute_force(spark, monkeypatch, max_bytes):
    monkeypatch.setattr(urlfilter, "MAX_BYTES", max_bytes)
    monkeypatch.setattr(urlfilter, "BITS_A_KEY", 2)  # many errors, many levels
    urls = [f"{s}{h}{p}{t}" for s in ("http://", "https://") for h in ("Example.ORG", "x.example.org", "notexample.org", "org", "w.com", "com", "a.b.c", "z.a.b.c", "b.c", "é.com", "x.org:80")
            for p in ("", "/", "/es/", "/es", "/en/12", "/en/2", "/fr/1", "/de/9", "/DE/9") for t in ("", "?q=/es/", "#top")]
    urls += [None, "", "nothing", "mailto:x@org/", "://org/a", "http://", "http:///es/", "http://a://b.org/es/", "http://" + "a." * 500 + "org/" + "x" * 5000] + [f"http://h{i}.test{i % 7}.com/{'fr' if i % 3 else 'de'}/{i}" for i in range(300)]
    urls += urls[:20]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, RULES).collect()}
    assert got == {i: judged(u, RULES, "allow") for i, u in enumerate(urls)}


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_A_KEY", 3)
    keys = [f"k{i}" for i in range(4000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = urlfilter.build_cascade(universe.limit(0).unionByName(spark.createDataFrame([(k,) for k in keys[:500]], "key string")), universe)
    depth = len(cascade.levels)
    assert depth > 2
    rows = universe.select("key", F.concat(*[urlfilter.hashes(F.col("key"), n) for n in range(depth)]).alias("h")).collect()
    listed = cascade.listed(np.array([r["h"] for r in rows], np.int64).reshape(-1, depth, 2))
    assert {r["key"] for r, x in zip(rows, listed) if x} == set(keys[:500])


def test_no_urls_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert urlfilter.judge(empty, RULES).count() == 0
    some = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert [(r["rule"], r["verdict"]) for r in urlfilter.judge(some, {}).collect()] == [(None, "allow")]


def vectors(spark, n=700, d=5, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.integers(-2, 3, d)], 1.0) for i in range(n)]  # many ties
    rows += [(2000, None, 0.0), (2100, [0.0] * d, 0.0), (2200, [1.0, None, 0.0, 0.0, 0.0], 0.0), (2300, [float("nan")] * d, 0.0), (2400, [float("inf")] + [0.0] * (d - 1), 0.0), (None, [1.0] * d, 0.0), (2500, [], 0.0), (2600, [1.0, 2.0], 0.0), (2601, [1.0, 2.5], 0.0), (7, [1.0] * d, 0.0)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score double").repartition(5), rows


def usable(rows, nonzero):
    return [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and (not nonzero or np.any(np.array(v, float)))]


def brute(rows, measure, k):
    """measure(q, x): smaller is better."""
    out = []
    for q, v in rows:
        if q % 100 == 0:
            near = sorted((measure(v, x), i) for i, x in rows if i != q and len(x) == len(v))[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_nearest_is_exact_at_factor_one(spark, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 8)
    df, rows = vectors(spark)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vptree.nearest(df, F.col("id") % 100 == 0, 10).collect())
    want = brute(usable(rows, True), lambda q, x: float(np.sqrt(((q - x) ** 2).sum())), 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14)


def test_trees_prune_and_larger_factors_prune_more():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (400, 3)) for c in ((0, 0, 0), (9, 0, 0), (0, 9, 0), (0, 0, 9))])
    q, tree, seen = x[::100], vptree.build(x), {}
    for factor in (1.0, 4.0):
        s = vptree.Search(x, np.arange(len(x)), q, np.arange(0, len(x), 100), 10, factor)
        count = [0]
        add = s.add
        s.add = lambda at, rows, d: (count.__setitem__(0, count[0] + d.size), add(at, rows, d))
        s.walk(tree, np.arange(len(q)))
        seen[factor] = count[0], s.found.copy()
    assert seen[1.0][0] < 0.6 * len(q) * len(x) and seen[4.0][0] < seen[1.0][0]
    exact = np.argsort(np.linalg.norm(q[:, None] - x[None], axis=2) + 1e9 * (np.arange(len(x))[None] == np.arange(0, len(x), 100)[:, None]), axis=1)[:, :10]
    assert (np.sort(exact) == np.sort(seen[1.0][1])).all()


def test_products_equal_brute_force(spark):
    df, rows = vectors(spark)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_products(df, F.col("id") % 100 == 0, 10).collect())
    want = brute(usable(rows, False), lambda q, x: -sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(q, x)), 10)
    assert got == sorted((q, n, i, -s) for q, n, i, s in want)


def test_large_products_stay_whole():
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**80, 1.0]])
    assert topk.products(q, x).tolist() == [[2**60 + 3, 2**63 - 1]]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vptree.nearest(empty, F.col("id") % 100 == 0).count() == 0
    assert topk.top_products(empty, F.col("id") % 100 == 0).count() == 0
