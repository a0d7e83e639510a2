"""Exact and near copies against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from vetspan.llm import exact_dedup, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, keep_id string, kept string, slot string"


def rows_of(texts):
    return [(i, t, "a", "b", "c") for i, t in enumerate(texts)]


TEXTS = ["x", "x", "", None, "y" * 100_000, "y" * 100_000, "z", "x", "é", "é"]


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_exact_groups(spark, bits):
    docs = spark.createDataFrame([*rows_of(TEXTS), (7, "x", "a", "b", "c"), (None, "n", "a", "b", "c"), (None, None, "a", "b", "c")], SCHEMA)
    got = exact_dedup.exact_groups(docs, capacity=2, hash_bits=bits).collect()
    source = [(i, t or "") for i, t, *_ in docs.collect()]
    for r in got:
        same = [i for i, t in source if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == max((i for i in same if i is not None), default=None)
        assert r.kept == (r.doc_id == r.keep_id)
    assert len(got) == len(source)


def test_drop_copies(spark):
    docs = spark.createDataFrame([*rows_of(TEXTS), (7, "x", "a", "b", "c")], SCHEMA)
    kept = exact_dedup.drop_copies(docs, capacity=2)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 8, 9]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0 == exact_dedup.exact_groups(docs.limit(0)).count()


@pytest.mark.parametrize(("capacity", "bits"), [(2, 64), (3, 5)])
def test_buckets_split_until_they_fit(spark, capacity, bits):
    """Every bucket fits or can't split, is no smaller than it has to be, and no text's decision depends on the splits."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('t', id % 200) AS text")
    keys = exact_dedup.text_keys(docs, hash_bits=bits)
    hashes = sorted({r.vs_hash for r in keys.collect()})
    dealt = exact_dedup.deal_to_buckets(keys.select("vs_hash").distinct(), capacity).collect()
    assert sorted(r.vs_hash for r in dealt) == hashes
    members = lambda first, depth: [h for h in hashes if depth == 0 or (h % 2**64) >> (64 - depth) == (first % 2**64) >> (64 - depth)]
    for r in dealt:
        assert len(members(r.bucket, r.local_depth)) <= capacity and r.vs_hash in members(r.bucket, r.local_depth)
        assert r.local_depth == 0 or len(members(r.bucket, r.local_depth - 1)) > capacity
    index = exact_dedup.build_index(docs, keys, capacity=capacity, hash_bits=bits).collect()
    assert len(index) == 200 and all(len({r.chain for r in index if r.vs_hash == h}) == max(r.chain for r in index if r.vs_hash == h) for h in hashes)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, capacity=capacity, hash_bits=bits).collect()}
    assert got == {i: (i + 200, 2) if i < 100 else (i, 2) if i >= 200 else (i, 1) for i in range(300)}


def test_hashes_of_one_prefix_split_to_the_last_bits(spark):
    dealt = exact_dedup.deal_to_buckets(spark.range(40).selectExpr("shiftleft(id, 44) AS vs_hash"), 2).collect()
    assert {r.local_depth for r in dealt} == {19} and len({r.bucket for r in dealt}) == 20
    assert exact_dedup.deal_to_buckets(spark.range(0).selectExpr("id AS vs_hash"), 2).count() == 0


def shingles(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts, k, percent):
    sets, parent = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus():
    rnd = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rnd.integers(0, 5000, n)]
    base = word(120)
    out = [" ".join(base)]
    for edits in [0, 1, 1, 2, 3, 4, 5, 6, 8, 10, 15, 20] * 3:
        own = list(base)
        for at in rnd.integers(0, len(own), edits):
            own[at] = f"n{rnd.integers(0, 10**6)}"
        out.append(" ".join(own))
    return [*out, *[" ".join(word(80)) for _ in range(40)], "A b", "a  B", "a", "", None, "\n\t ", " ".join(base).upper(), "lone"]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_groups(spark, k, percent):
    texts = corpus()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: r for r in near_dedup.near_groups(docs, near_dedup.Similarity(words=k, percent=percent)).collect()}
    want, sizes = components(texts, k, percent)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "PART_BYTES", 2000)
    texts = corpus()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, near_dedup.Similarity(words=3, percent=85)).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts, 3, 85)[0]


def test_near_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d", "", "", ""), (None, None, "", "", ""), (5, "a b c d", "", "", ""), (5, "a b c d", "", "", ""), (9, "a b c d", "", "", "")], SCHEMA)
    kept = near_dedup.drop_near_copies(docs, near_dedup.Similarity(words=3))
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.filter("doc_id IS NOT NULL").collect()) == [(False, 5), (False, 5)]
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_odd_sketch_estimates():
    rule = near_dedup.Similarity(words=3, percent=85)
    sampler, rnd = near_dedup.Sampler(rule), np.random.default_rng(1)
    for similarity in (0.95, 0.85, 0.7):
        total, errors = 2000, []
        for _ in range(30):
            common = int(round(2 * total * similarity / (1 + similarity) / 2))
            shared = rnd.integers(0, 2**63, common, dtype=np.uint64)
            one, two = (np.concatenate((shared, rnd.integers(0, 2**63, total - common, dtype=np.uint64))) for _ in range(2))
            sketches = [np.frombuffer(sampler.odd_sketch(sampler.samples(x)), np.uint64) for x in (one, two)]
            true = common / (2 * total - common)
            errors.append(near_dedup.sketched_similarity(np.array([np.bitwise_count(sketches[0] ^ sketches[1]).sum()]), rule.samples)[0] - true)
        assert abs(np.mean(errors)) < 0.03


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    assert {(r.node, r.root) for r in near_dedup.connected(edges).collect()} == {(i, 0 if i <= 20 else 21) for i in range(41)}


def test_short_texts_have_one_shingle():
    sets = near_dedup.shingle_sets(pa.array(["a b", "A  B", "a b c", "", "b a"]), 3)
    assert [len(s) for s in sets] == [1, 1, 1, 0, 1] and sets[0][0] == sets[1][0] != sets[4][0]


@pytest.mark.parametrize("blocks", [False, True])
def test_parts_hold_every_pair_once(monkeypatch, blocks):
    monkeypatch.setattr(near_dedup, "PART_BYTES", 100)
    rnd = np.random.default_rng(8)
    size = rnd.integers(1, 30, 40)
    block = rnd.integers(0, 2, 40)
    members = np.flatnonzero(rnd.random(40) < 0.8)
    found = []
    for own, side, cross in near_dedup._parts(members, size, block if blocks else None):
        found += [tuple(sorted((int(a), int(b)))) for i, a in enumerate(own) for j, b in enumerate(own[:i]) if not cross or side[i] != side[j]]
    assert sorted(found) == sorted((int(a), int(b)) for a in members for b in members if a < b and (not blocks or block[a] != block[b]))


def test_op9_and_op10_against_brute_force(spark, data):
    from vetspan.llm import queries

    docs = {r.doc_id: r.text for r in queries.table(spark, data, "documents").collect()}
    ids = sorted(docs)
    want, sizes = components([docs[i] for i in ids], 3, 85)
    got = {r.doc_id: r for r in queries.op9_near_dedup(spark, data).collect()}
    assert got.keys() == docs.keys()
    for i, root, n in zip(ids, want, sizes, strict=True):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, ids[root], ids[root] == i)
    groups = {}
    for i in ids:
        groups.setdefault(docs[i] or "", []).append(i)
    for r in queries.op10_exact_dedup(spark, data).collect():
        own = groups[docs[r.doc_id] or ""]
        assert tuple(r) == (r.doc_id, max(own), len(own), r.doc_id == max(own), hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest())


def test_tasks_of_near_copies_start_empty_and_send_little_at_once(spark, monkeypatch):
    from vetspan.llm import shared

    text = " ".join(f"w{i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, f"{text} {i}") for i in range(80)], "doc_id long, text string").coalesce(1)
    caught, dropped = [], []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a, **b: caught.append(run) or real(self, run, *a, **b))
    signed = near_dedup.signatures(docs, near_dedup.Similarity())
    monkeypatch.undo()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(2 << 20)
    assert signed.count() == 80
    shared.keep_for("packing", lambda: dropped.append(1))
    ids, texts = (pa.array([r[c] for r in docs.collect()]) for c in ("doc_id", "text"))
    out = list(caught[0](iter([pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])])))
    assert dropped == [1]
    assert sum(b.num_rows for b in out) == 80 and max(b.num_rows for b in out) * len(text) <= 2 << 20
