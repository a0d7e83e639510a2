"""Near duplicates by MinHash bands, odd sketches of the samples, and exact confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_kept, skewed_join, small_batches, split_words, text_slices, written

#: Candidates' ids are broadcast up to so many, shuffled beyond.
BROADCAST_IDS = 200_000
SKETCH_BITS = 512
#: Bytes that Python gets at once and texts that are cut into shingles at once, or one row.
SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class Similarity:
    """Link where 100 * intersection >= percent * union of the sets of `words`-word shingles."""

    words: int = 5
    percent: int = 80
    samples: int = 128
    #: Largest probability that a pair just at the threshold shares no band.
    miss: float = 1e-6
    seed: int = 20240607

    def bands(self) -> tuple[int, int]:
        """(bands, rows): the most rows of which enough bands fit into the samples."""
        s = self.percent / 100
        rows = max((r for r in range(1, 17) if (1 - s**r) ** (self.samples // r) <= self.miss), default=1)
        return self.samples // rows, rows

    def floor(self) -> float:
        """Least estimated similarity worth an exact comparison: six standard deviations under the threshold."""
        s = self.percent / 100
        return s - 6 * (s * (1 - s) / self.samples) ** 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; a text of fewer words has one shingle of all of them."""
    codes, bounds, names = split_words(pc.ascii_lower(texts))
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in names.to_pylist()), np.uint64, len(names))[codes] if len(codes) else np.zeros(0, np.uint64)
    size = max(len(hashed) - words + 1, 0)
    rolled = np.zeros(size, np.uint64)
    factor = np.uint64(1)
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(words):
            rolled += hashed[k : k + size] * factor
            factor *= step
        rolled = _mix(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                own = np.sort(rolled[a : b - words + 1])
                out.append(own[np.append(True, own[1:] != own[:-1])])
            elif b > a:
                whole = np.uint64(b - a)
                for h in hashed[a:b]:
                    whole = _mix(np.array([whole * step + h]))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class Sampler:
    """MinHash samples, their band keys and their odd sketch."""

    def __init__(self, rule: Similarity):
        rnd = np.random.default_rng(rule.seed)
        self.odd = rnd.integers(0, 2**63, rule.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = rnd.integers(0, 2**63, rule.samples, dtype=np.uint64)
        self.count, self.rows = rule.bands()

    def samples(self, own: np.ndarray) -> np.ndarray:
        low = np.full(len(self.odd), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(own), 2048):
                np.minimum(low, (own[at : at + 2048, None] * self.odd).min(axis=0), out=low)
        return low

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        keys = np.arange(self.count, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for r in range(self.rows):
                keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + samples[r * self.count : (r + 1) * self.count])
        return keys.view(np.int64)

    def odd_sketch(self, samples: np.ndarray) -> bytes:
        """Parity of the number of (place, sample) pairs that fall on each bit."""
        with np.errstate(over="ignore"):
            at = (_mix(samples ^ self.places) % np.uint64(SKETCH_BITS)).astype(np.int64)
        return np.packbits(np.bincount(at, minlength=SKETCH_BITS) & 1 == 1).tobytes()


def sketched_similarity(differing: np.ndarray, samples: int) -> np.ndarray:
    """Similarity estimated from the number of bits in which two odd sketches differ.

    With d of n bits set in the XOR, the samples' symmetric difference is about -n/2 ln(1 - 2d/n),
    and that difference is 2 * samples * (1 - similarity).
    """
    share = np.minimum(2 * differing / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * samples) * np.log(1 - share)


def signatures(docs: DataFrame, rule: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """vs_id, n_shingles, set_a and set_b (a 128-bit hash of the set), bands, sketch for each row."""
    kinds = [docs.schema[id_col].dataType, T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(("vs_id", "n_shingles", "set_a", "set_b", "bands", "sketch"), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("near_dedup")
        sampler = Sampler(rule)
        for batch, texts in text_slices(batches, text_col, SLICE_BYTES):
            sets = shingle_sets(texts, rule.words)
            bands, sketches, a, b = [], [], [], []
            for own in sets:
                with np.errstate(over="ignore"):
                    a.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                    b.append(int((_mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5))).sum(dtype=np.uint64).view(np.int64)))
                low = sampler.samples(own) if len(own) else None
                bands.append(sampler.band_keys(low) if len(own) else [])
                sketches.append(sampler.odd_sketch(low) if len(own) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema.names)

    return small_batches(docs.select(id_col, text_col), SLICE_BYTES).mapInArrow(run, schema)


SET_KEY = ["n_shingles", "set_a", "set_b"]


def distinct_sets(signed: DataFrame) -> DataFrame:
    """One row per distinct non-empty set that has an id: node (its smallest id), its key, bands and sketch."""
    full = signed.filter("n_shingles > 0 AND vs_id IS NOT NULL")
    return full.groupBy(*SET_KEY).agg(F.min("vs_id").alias("node"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))


#: A task compares at most two blocks of so many members of one bucket; larger buckets are cut into more blocks.
BLOCK = 2048
#: Shingle bytes of the members that are compared exactly with each other, or with as many others, at once (one member at least).
PART_BYTES = 16 << 20


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal keys; the rows of a key must be neighbours."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _parts(members: np.ndarray, size: np.ndarray, block: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(members, side of each, whether only members of different sides are compared) so that every pair is in one.

    Members are cut into parts of at most PART_BYTES of shingles; with a block for each member, only pairs of
    different blocks are wanted.
    """

    def cut(own: np.ndarray) -> list[np.ndarray]:
        part = np.cumsum(8 * size[own]) // PART_BYTES
        return np.split(own, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(own) else []

    def crossed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        return np.concatenate((a, b)), np.repeat(np.array([0, 1], np.int32), [len(a), len(b)]), True

    if block is None:
        parts = cut(members)
        yield from ((a, np.zeros(len(a), np.int32), False) for a in parts)
        yield from (crossed(a, b) for i, a in enumerate(parts) for b in parts[:i])
    elif len(members):
        sides = [cut(members[block[members] == x]) for x in np.unique(block[members])]
        yield from (crossed(a, b) for i, x in enumerate(sides) for y in sides[:i] for a in x for b in y)


def _plausible(rule: Similarity):
    """For each bucket block: the members whose sketch allows a link to a member of another component."""
    floor = rule.floor()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("near_dedup")
        for group in _grouped(batches, ["key", "low", "high"]):
            m = group.num_rows
            if m < 2:
                continue
            bits = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(m, -1)
            size = group["n_shingles"].to_numpy()
            comp = group["comp"].to_numpy()
            if (comp == comp[0]).all():
                continue
            block = group["block"].to_numpy()
            apart = group["low"][0].as_py() != group["high"][0].as_py()
            hit = np.zeros(m, bool)
            for i in range(m):
                other = comp != comp[i]
                if apart:
                    other &= block != block[i]
                other = np.flatnonzero(other)
                other = other[100 * np.minimum(size[other], size[i]) >= rule.percent * np.maximum(size[other], size[i])]
                if len(other):
                    differing = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1)
                    near = other[sketched_similarity(differing, rule.samples) >= floor]
                    if len(near):
                        hit[i] = True
                        hit[near] = True
            for which, side, cross in _parts(np.flatnonzero(hit), size, block if apart else None):
                if (comp[which] == comp[which[0]]).all():
                    continue
                nodes = group["node"].to_numpy()[which]
                order = np.argsort(nodes)
                which, side, nodes = which[order], side[order], nodes[order]
                name = xxhash.xxh64_intdigest(nodes.tobytes() + bytes([cross]) + side.tobytes()) >> 1
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(nodes), pa.int64()), pa.array(nodes), pa.array(comp[which]), pa.array(side), pa.array([cross] * len(nodes))], ["name", "node", "comp", "block", "apart"])

    return run


def _confirmed(rule: Similarity):
    """For each group: exact links between members of different components, as few as join what is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("near_dedup")
        for group in _grouped(batches, ["name"]):
            m = group.num_rows
            node, comp, block = (group[c].to_numpy() for c in ("node", "comp", "block"))
            apart = group["apart"][0].as_py()
            raw = group["shingles"].to_pylist()
            size = np.array([len(x) // 8 for x in raw], np.int64)
            starts = np.cumsum(size) - size
            _, codes = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
            flag = np.zeros(int(codes.max()) + 1, np.int32)
            _, root = np.unique(comp, return_inverse=True)
            largest = np.bincount(root).argmax()
            links = []
            for i in np.flatnonzero(root != largest).tolist():  # one of any two components isn't the largest
                own = codes[starts[i] : starts[i] + size[i]]
                flag[own] = 1
                common = np.add.reduceat(flag[codes], starts)
                flag[own] = 0
                linked = 100 * common >= rule.percent * (size + size[i] - common)
                if apart:
                    linked &= block != block[i]
                for j in np.flatnonzero(linked).tolist():
                    if root[j] != root[i]:
                        links.append((node[i], node[j]))
                        root[root == root[j]] = root[i]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return run


def _full_sets(docs: DataFrame, nodes: DataFrame, rule: Similarity, id_col: str, text_col: str) -> DataFrame:
    """node and shingles (sorted distinct 64-bit hashes) of the documents whose ids are in `nodes`."""
    few = nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = nodes.select(F.col("node").alias(id_col))
    texts = docs.select(id_col, text_col).join(F.broadcast(wanted) if few else wanted, id_col, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("near_dedup")
        for batch, own in text_slices(batches, text_col, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([s.tobytes() for s in shingle_sets(own, rule.words)], pa.binary())], ["node", "shingles"])

    # rows that share an id count as one document: the largest of their sets stands for it
    found = small_batches(texts, SLICE_BYTES).mapInArrow(run, "node long, shingles binary")
    return written(found.groupBy("node").agg(F.max("shingles").alias("shingles")), "near-sets")


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the edges a, b.

    Each round moves every node to its smallest neighbour and contracts the edges; rounds grow with the
    logarithm of the longest path. Every round is written to the shared folder.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "links")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = written(ends.withColumn("root", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy(F.col("a").alias("old")).agg(F.least(F.first("a"), F.min("b")).alias("new"))
        labels = written(labels.join(step, labels["root"] == step["old"], "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        left = edges.join(step, edges["a"] == step["old"]).select(F.col("new").alias("a"), "b")
        moved = left.join(step, left["b"] == step["old"]).select("a", F.col("new").alias("b"))
        edges = written(moved.filter("a <> b").distinct(), "links")
    return labels


def links(docs: DataFrame, sets: DataFrame, rule: Similarity, id_col: str, text_col: str) -> DataFrame:
    """Edges a, b between distinct sets that give the same components as all links.

    1. Sets that share a band meet in its bucket, and each is compared with the bucket's most central
       set: first by odd sketch, then exactly.
    2. In buckets that still hold several components, every member is compared by sketch with the
       members of other components, in blocks of bounded size; those that may be linked are compared
       exactly. So no pair of a bucket is left out unless it is joined already.
    """
    cells = sets.select("node", F.explode("bands").alias("key"))
    several = written(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-keys")
    shared = written(skewed_join(cells, several, ["key"], "n"), "near-buckets")
    central = shared.groupBy("node").agg(F.sum("n").alias("c"))
    leaders = shared.join(central, "node").groupBy("key").agg(F.max(F.struct("c", "node")).alias("top"), F.max("n").alias("n")).select("key", F.col("top.node").alias("leader"), "n")
    pairs = skewed_join(shared.drop("n"), written(leaders, "near-leaders"), ["key"], "n").filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    brief = sets.select("node", "n_shingles", "sketch")
    one = brief.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    two = brief.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= rule.percent * F.greatest("na", "nb"))
    floor, p = rule.floor(), rule.percent

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("near_dedup")
        for batch in batches:
            if batch.num_rows:
                bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sa", "sb")]
                near = sketched_similarity(np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1), rule.samples) >= floor
                yield batch.select(["a", "b"]).filter(pa.array(near))

    likely = written(small_batches(sized, SLICE_BYTES).mapInArrow(sketched, "a long, b long"), "near-pairs")
    full = _full_sets(docs, likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), rule, id_col, text_col)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("near_dedup")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= p * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    xa = full.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    xb = full.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    stars = written(small_batches(likely.join(xa, "a").join(xb, "b"), SLICE_BYTES).mapInArrow(exact, "a long, b long"), "near-stars")

    labels = connected(stars)
    placed = written(shared.filter("n > 2").join(labels, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("comp")), "near-placed")
    mixed = written(placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("n").alias("n")).filter("x <> y").select("key", "n"), "near-mixed")
    open_rows = skewed_join(placed.drop("n"), mixed, ["key"], "n").join(brief, "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = open_rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", "node", "comp", "n_shingles", "sketch", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    hits = small_batches(dealt, SLICE_BYTES).mapInArrow(_plausible(rule), "name long, node long, comp long, block int, apart boolean")
    hits = written(hits.dropDuplicates(["name", "node"]), "near-open")
    rest = _full_sets(docs, hits.select("node").distinct(), rule, id_col, text_col)
    groups = hits.join(rest, "node").repartition("name").sortWithinPartitions("name")
    return written(stars.union(small_batches(groups, SLICE_BYTES).mapInArrow(_confirmed(rule), "a long, b long")), "near-links")


def near_groups(docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Letters A-Z are lower-cased, words are runs of other characters than \\x20 and \\x09-\\x0D. Rows whose
    sets are linked directly or through others share the smallest id as component_id, and only that row
    is kept. Null or wordless texts have an empty set and are linked with nothing. ids are integers and
    identify rows; rows that repeat an id share its decision, and rows with null ids join only rows with
    the same set. Other columns are not read; an empty table gives no rows. Shingles are told apart by
    64-bit hashes and equal sets by two 64-bit sums of them: among 2**32 different shingles some two agree
    with a probability of about 0.4, which changes a count by one; two sets agree with one below 1e-18.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, rule), "near-signed")
    sets = written(distinct_sets(signed), "near-distinct")
    labels = connected(links(docs, sets, rule, "doc_id", "text"))
    named = sets.join(labels, "node", "left").select(*SET_KEY, F.coalesce("root", "node").alias("component"))
    out = signed.select("vs_id", *SET_KEY).join(named, SET_KEY, "left")
    component = F.coalesce("component", "vs_id")
    return out.select(F.col("vs_id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("vs_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows of `docs` that stay: one of each component, that with the smallest id; rows with null ids stay."""
    gone = written(near_groups(docs, rule, id_col, text_col).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__vs_gone")).distinct(), "near-gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long") == F.col("__vs_gone"), "left_anti")
