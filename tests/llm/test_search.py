"""Ranked search, decontamination and clustering against brute force: windows and suffixes, bounds, ties, nulls and blocks."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vetspan.llm import clusters, decontamination, search, shared

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
texts = st.lists(st.sampled_from(["a", "B", "b", "ä", "Ä", "c-d", "7", "\n", "x.", "", "e f"]), max_size=40).map(" ".join)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@given(st.lists(texts, max_size=8))
@settings(max_examples=100, deadline=None)
def test_plain_words(found):
    array = pa.array(["cut", *found], pa.string()).slice(1)
    codes, bounds, names = shared.split_words(shared.plain_texts(array))
    names = names.to_pylist()
    assert [[names[c] for c in codes[a:b]] for a, b in zip(bounds, bounds[1:])] == [words(t) for t in found]
    assert shared.plain_word_counts(array).tolist() == [len(words(t)) for t in found]


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_suffix_array(codes, depth):
    padded = np.array(codes + [0] * (depth + 1), np.int64)
    got = decontamination.suffix_array(padded, depth, len(codes))
    assert sorted(got) == [i for i, c in enumerate(codes) if c]
    keys = [tuple(padded[i : i + depth]) for i in got]
    assert keys == sorted(keys)


def brute_matches(text, items, window):
    own, hit, ids, longest = words(text), set(), set(), 0
    for name, item in items:
        theirs = words(item)
        size = min(window, len(theirs))
        for i in range(len(theirs) - size + 1 if theirs else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == theirs[i : i + size]:
                    hit.update(range(j, j + size))
                    ids.add("" if name is None else str(name))
                    n = size
                    while i + n < len(theirs) and j + n < len(own) and own[j + n] == theirs[i + n]:
                        n += 1
                    longest = max(longest, n)
    spans, place = [], None
    for k in sorted(hit):
        if place is None or k != sum(spans[-1]):
            spans.append([k, 0])
        spans[-1][1] += 1
        place = k
    return len(own), len(hit), longest, [tuple(s) for s in spans], sorted(ids)


@given(st.lists(texts, min_size=1, max_size=6), st.lists(texts, max_size=5), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_slice_matches(docs, items, window):
    table = pa.table({"item": pa.array([None if i == 1 else str(i % 3) for i in range(len(items))], pa.string()), "text": pa.array(items, pa.string())})
    one = decontamination.Slice(pa.array(docs, pa.string()))
    one.match(decontamination.read_items(table, window))
    got = list(zip(*(c.to_pylist() for c in one.columns())))
    named = list(zip(table.column("item").to_pylist(), items))
    assert [(a, b, c, [tuple(s.values()) for s in d], e) for a, b, c, d, e in got] == [brute_matches(t, named, window) for t in docs]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["Äther", "x7"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([3, 9, 10, 14, 40]))) for i in range(30)] + [(4, make(12)), (None, make(11)), (90, None), (91, "  \n"), (92, "w1")]
    docs = [(i, make(rng.randint(0, 200))) for i in range(120)]
    docs += [(200 + i, make(20) + ", " + items[i][1].upper() + "! " + make(5)) for i in range(30)]
    docs += [(300, None), (301, ""), (None, items[7][1]), (302, "longword" * 40_000), (303, make(60_000) + " " + items[4][1]), (5, docs[5][1]), (5, docs[5][1])]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5).cache(), spark.createDataFrame(items, "item_id long, text string"), items


def test_find_matches(spark, corpus, monkeypatch):
    docs, _, items = corpus
    few = [(i, t) for i, t in items if i != 92]
    table = spark.createDataFrame(few, "item_id long, text string")
    expected = sorted([(r.doc_id, *brute_matches(r.text, few, 10)) for r in docs.filter("length(text) < 100000 OR text IS NULL").collect()], key=repr)
    shape = lambda rows: sorted([(r.doc_id, r.n_words, r.n_hit, r.longest_match, [tuple(s) for s in r.spans], r["items"]) for r in rows if r.n_words < 50_000 and r.doc_id != 302], key=repr)
    whole = decontamination.find_matches(docs, table).collect()
    assert shape(whole) == expected
    long = next(r for r in whole if r.doc_id == 303)
    assert long.n_hit >= len(words(items[4][1])) and "4" in long["items"]
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 300)  # several files of items
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 37)  # several arrays a text
    small = docs.filter("text IS NULL OR length(text) < 5000").coalesce(1)
    parts = decontamination.find_matches(small, table)
    assert shape(parts.collect()) == [e for e in expected if e[1] < 50_000]


def test_decontamination_edges(spark, corpus):
    docs, items, _ = corpus
    clashing = docs.withColumn("n_hit", F.lit("mine")).withColumn("items", F.lit(0))
    kept = decontamination.remove_contaminated(clashing, items)
    assert kept.columns == clashing.columns and 0 < kept.count() < docs.count()
    with pytest.raises(ValueError, match="prefix"):
        decontamination.find_matches(clashing, items)
    assert decontamination.find_matches(docs.limit(0), items).count() == 0
    none = decontamination.find_matches(docs, items.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.n_hit or r["items"] or r.longest_match for r in none)


def brute_search(docs, items, limit):
    bags = [Counter(words(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    out = []
    for name, text in items:
        scored = []
        for (doc, _), bag, size in zip(docs, bags, sizes):
            m = 50 + (50 * size * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(words(text)) if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(name, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:limit])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit, block, passes", [(7, None, None), (50, 400, 3), (1000, 2000, 1)])
def test_search(spark, corpus, monkeypatch, limit, block, passes):
    docs, table, items = corpus
    if block:  # many blocks, passes and groups of items
        monkeypatch.setattr(search, "BLOCK_BYTES", block)
        monkeypatch.setattr(search, "PASS_ITEMS", 35 // passes)
        monkeypatch.setattr(search, "SCORED", 50)
    index = search.build_index(docs.withColumn("terms", F.lit(1)))
    got = search.search(index, table, limit)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_search([tuple(r) for r in docs.collect()], items, limit)


def test_search_of_empty_tables(spark, corpus):
    docs, items, _ = corpus
    assert search.search(search.build_index(docs.limit(0)), items).count() == 0
    assert search.search(search.build_index(docs.filter("text IS NULL")), items).count() == 0
    assert search.search(search.build_index(docs), items.limit(0)).count() == 0


def test_bounds_hold_every_score(spark, corpus):
    docs, _, _ = corpus
    impacts = search.Impacts()
    frequencies, factors = np.array([1, 1, 2, 70, 10**6, 1]), np.array([50, 100, 51, 5000, 50, 10**12])
    exact = impacts.exact(frequencies, factors)
    levels = -(-exact // impacts.step)
    assert (levels <= 255).all() and (levels * impacts.step >= exact).all() and ((levels - 1) * impacts.step < exact)[levels > 0].all()


def brute_clusters(rows, rule):
    kept = [(i, [math.floor(float(np.float32(x)) * rule.scale) for x in v]) for i, v in rows if v is not None and len(v) == rule.dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{rule.seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[: rule.clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rule.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else centre for k, centre in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    return sorted([(i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, d, k in found], key=repr)


@pytest.mark.parametrize("count, spread, limit", [(150, 1.0, 5), (150, 0.01, 12), (40, 3e4, 6), (3, 1.0, 5), (1, 1.0, 5)])
def test_clusters(spark, count, spread, limit):
    rng = random.Random(count)
    rule = clusters.Clustering(clusters=limit, rounds=4, dimensions=3)
    rows = [(i, [rng.gauss(0, spread) for _ in range(3)]) for i in range(count)]
    rows += [(0, rows[0][1])] * 3 + [(None, rows[0][1]), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, math.inf, 2.0]), (904, [math.nan, 1.0, 2.0]), (905, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("mine")).repartition(3)
    got = clusters.cluster_vectors(table, rule)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, rule)


def test_clusters_of_no_vectors(spark):
    table = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert clusters.cluster_vectors(table).count() == 0


@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_bounds_certify_only_the_nearest(seed, size, rounds):
    rng = np.random.default_rng(seed)
    vectors, centroids = rng.integers(-6, 7, (50, 2)), rng.integers(-6, 7, (size, 2))
    kept = min(3, size - 1)
    bounds, scans = clusters.Bounds.unknown(50, kept), 0
    for i in range(rounds):
        scans += clusters.assign(vectors, centroids, bounds).sum()
        exact = clusters.squared(vectors, centroids)
        assert (bounds.cluster == exact.argmin(1)).all()  # the first of equal ones
        new = centroids + rng.integers(-1, 2, centroids.shape)
        bounds.move(np.sqrt(((new - centroids) ** 2).sum(1)) * (1 + clusters.SLACK), kept := max(min(kept, 3 - i), min(1, size - 1)))
        centroids = new
        true = np.sqrt(clusters.squared(vectors, centroids))
        rows = np.arange(50)
        assert (bounds.upper >= true[rows, bounds.cluster]).all()
        assert (bounds.lower <= np.take_along_axis(true, bounds.near, 1)).all()


def test_files_of_the_index_hold_few_blocks(spark):
    from vetspan.llm import search as s

    docs = spark.range(s.FILE_BLOCKS + 2).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), s.BLOCK_BYTES // 5 + 1).alias("text"))
    index = s.build_index(docs)
    files = index.blocks.groupBy(F.input_file_name().alias("file")).count().collect()
    assert sorted(f["count"] for f in files) == [2, s.FILE_BLOCKS]
