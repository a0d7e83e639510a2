"""Exact duplicates through an extendible-hash index kept in shared files, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import skewed_join, written

#: Distinct hashes that a bucket holds before it splits.
BUCKET_CAPACITY = 20_000
#: Slots of the directory, hashes and entries of several rows, and ids of dropped rows are broadcast up to so many, joined by a shuffle beyond that.
BROADCAST_KEYS = 200_000
HASH_BITS = 64
#: How many bits deeper the directory looks at once.
DEEPER = 6


def _hashed(text: Column, hash_bits: int) -> Column:
    """The first hash_bits of the text's hash; fewer than 64 make collisions, for tests."""
    hashed = F.xxhash64(text)
    return hashed if hash_bits >= HASH_BITS else _prefix_of(hashed, F.lit(hash_bits))


def _prefix_of(hashed: Column, bits: Column) -> Column:
    """The hash with all but its first bits cleared: the first hash of their bucket."""
    rest = F.lit(HASH_BITS) - bits
    return F.when(bits > 0, F.call_function("shiftleft", F.call_function("shiftrightunsigned", hashed, rest), rest)).otherwise(F.lit(0).cast("long"))


def deal_to_buckets(hashes: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """`hashes` (distinct vs_hash) with bucket and local_depth: the first hash of the bucket, and how many bits its hashes share.

    A bucket of more than `capacity` hashes splits by its next bit, until none is overfull. The directory
    is counted for some bits at once; only the hashes of buckets that are overfull at all of them are
    counted again, by more bits, up to all 64. It stays a table: nothing of it comes to the driver.
    """
    n = hashes.count()  # no directory has more slots than hashes
    level, depth = 0, min(max(math.ceil(math.log2(n / capacity)), 0) + 2, HASH_BITS) if n else 0
    todo, done = hashes, None
    while True:
        slots = todo.groupBy(_prefix_of(F.col("vs_hash"), F.lit(depth)).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(level), F.lit(depth))).alias("local_depth")).withColumn("bucket", _prefix_of(F.col("slot"), F.col("local_depth")))
        full = F.lit(depth == HASH_BITS) & (F.col("local_depth") == HASH_BITS)
        fitting = levels.groupBy("bucket", "local_depth").agg(F.sum("n").alias("n")).filter((F.col("n") <= capacity) | full).select("bucket", "local_depth")
        first = levels.select("slot", "bucket", "local_depth").join(fitting, ["bucket", "local_depth"]).groupBy("slot").agg(F.min(F.struct("local_depth", "bucket")).alias("b"))
        directory = first.select("slot", F.col("b.local_depth").alias("local_depth"), F.col("b.bucket").alias("bucket"))
        few = min(n, 2**depth) <= BROADCAST_KEYS
        dealt = todo.withColumn("slot", _prefix_of(F.col("vs_hash"), F.lit(depth))).join(F.broadcast(directory) if few else directory, "slot", "left").drop("slot")
        dealt = written(dealt, "dedup-dealt")
        settled = dealt.filter("local_depth IS NOT NULL")
        done = settled if done is None else done.unionByName(settled)
        todo = dealt.filter("local_depth IS NULL").drop("bucket", "local_depth")
        n = todo.count()
        if not n:
            return done
        level, depth = depth + 1, min(depth + DEEPER, HASH_BITS)


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = HASH_BITS) -> DataFrame:
    """vs_id, vs_hash, vs_sha for each row; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("vs_id"), _hashed(text, hash_bits).alias("vs_hash"), F.sha2(text, 256).alias("vs_sha"))


def build_index(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY, hash_bits: int = HASH_BITS) -> DataFrame:
    """The index: bucket, local_depth, vs_hash, chain, vs_sha, keep_id, group_size, a row per distinct text.

    1. The rows of each hash are counted on the map side, and the distinct hashes dealt to buckets.
    2. A hash of one row is an entry by itself; its text isn't moved and its vs_sha is null.
    3. The texts of the others are summed up within each task, so that a task sends a text once however
       often it holds it, and go to the owners of their buckets, which are contiguous ranges. An owner
       compares the bytes of the texts of a hash: equal ones are one entry, others chain in byte order.
    The entry's largest id stays (nulls are the smallest). vs_sha is the digest by which rows find their
    entry; two texts of one hash and one digest would be told apart here, and raise ValueError.
    """
    counted = keys.groupBy("vs_hash").agg(F.count(F.lit(1)).alias("n"), F.max("vs_id").alias("top"))
    dealt = deal_to_buckets(written(counted, "dedup-hashes"), capacity)
    single = dealt.filter("n = 1").selectExpr("bucket", "local_depth", "vs_hash", "1 AS chain", "CAST(NULL AS STRING) AS vs_sha", "top AS keep_id", "n AS group_size")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("vs_id"), text.alias("vs_text"), _hashed(text, hash_bits).alias("vs_hash"))
    shared = skewed_join(rows, dealt.filter("n > 1").select("vs_hash", "bucket", "local_depth", "n"), ["vs_hash"], "n", broadcast_rows=BROADCAST_KEYS).drop("n")
    sums = shared.withColumn("part", F.spark_partition_id()).groupBy("part", "bucket", "local_depth", "vs_hash", "vs_text").agg(F.max("vs_id").alias("top"), F.count(F.lit(1)).alias("n"))
    owned = sums.drop("part").repartitionByRange("bucket", "vs_hash")
    texts = owned.groupBy("bucket", "local_depth", "vs_hash", "vs_text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    chained = texts.selectExpr("bucket", "local_depth", "vs_hash", "CAST(row_number() OVER (PARTITION BY bucket, vs_hash ORDER BY vs_text) AS INT) AS chain", "sha2(vs_text, 256) AS vs_sha", "keep_id", "group_size")
    index = written(single.unionByName(chained), "dedup-index")
    if differing := index.filter("vs_sha IS NOT NULL").groupBy("vs_hash", "vs_sha").count().filter("count > 1").count():
        raise ValueError(f"{differing} index entries hold texts that differ although their SHA-256 agrees")
    return index


def _looked_up(keys: DataFrame, index: DataFrame) -> DataFrame:
    """keys with keep_id, group_size and chain of their entry; a row whose hash is its own is its own entry."""
    several = index.filter("vs_sha IS NOT NULL").select("vs_hash", "vs_sha", "chain", "keep_id", "group_size")
    return skewed_join(keys, several, ["vs_hash", "vs_sha"], "group_size", "left", BROADCAST_KEYS).withColumns({
        "keep_id": F.when(F.col("chain").isNull(), F.col("vs_id")).otherwise(F.col("keep_id")),
        "group_size": F.coalesce("group_size", F.lit(1)).cast("long"),
        "chain": F.coalesce("chain", F.lit(1)),
    })


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY, hash_bits: int = HASH_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, chain.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest id stays
    (null ids are the smallest). Rows that repeat an id and its text are one document: each of them
    is kept if its id stays. chain is the text's place among the texts of its hash. An empty table gives
    no rows. Other columns are not read.
    """
    keys = written(text_keys(docs, id_col, text_col, hash_bits), "dedup-keys")
    found = _looked_up(keys, build_index(docs, keys, id_col, text_col, capacity, hash_bits))
    return found.select(F.col("vs_id").alias("doc_id"), "keep_id", "group_size", F.col("vs_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("vs_sha").alias("text_sha256"), "chain")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """The rows that stay, with the columns of `docs`: one per distinct text, that with the largest id (null is the smallest)."""
    keys = written(text_keys(docs, id_col, text_col), "dedup-keys")
    copies = written(_looked_up(keys, build_index(docs, keys, id_col, text_col, capacity)).filter("group_size > 1"), "dedup-copies")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__vs_hash": F.xxhash64(text), "__vs_sha": F.sha2(text, 256)})
    stays = F.col("vs_id").eqNullSafe(F.col("keep_id"))
    dropped = written(copies.filter(~stays).select(F.col("vs_hash").alias("__vs_hash"), F.col("vs_sha").alias("__vs_sha"), F.col("vs_id").alias("__vs_id")).distinct(), "dedup-dropped")
    few = dropped.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    gone = F.broadcast(dropped) if few else dropped
    same = (keyed["__vs_hash"] == gone["__vs_hash"]) & (keyed["__vs_sha"] == gone["__vs_sha"]) & keyed[id_col].eqNullSafe(gone["__vs_id"])
    kept = keyed.join(gone, same, "left_anti")
    again = written(copies.filter(stays).groupBy("vs_hash", "vs_sha").count().filter("count > 1").select(F.col("vs_hash").alias("__vs_hash"), F.col("vs_sha").alias("__vs_sha")), "dedup-again")
    if again.limit(1).count():  # rows that repeat both id and text
        once = kept.join(again, ["__vs_hash", "__vs_sha"], "left_semi").dropDuplicates(["__vs_hash", "__vs_sha"])
        kept = kept.join(again, ["__vs_hash", "__vs_sha"], "left_anti").unionByName(once)
    return kept.select(*docs.columns)
