"""Ranked lexical search: a two-level index whose upward-rounded byte impacts bound scores, and exact integer rescoring of what the bounds leave."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import part_files, plain_texts, plain_word_counts, read_part, small_batches, split_words, spread, text_slices, written

#: Bytes of texts in one block of the index, or one text.
BLOCK_BYTES = 4 << 20
#: Blocks in one file of the index, which is what a task holds at once while it writes or reads them.
FILE_BLOCKS = 8
#: Bytes of item texts, and items, that one pass over the index searches for.
ITEM_BYTES, PASS_ITEMS = 2 << 20, 5_000
#: Postings, and (item, document) places, that a task scores at once.
SCORED = 1 << 20

#: One row for each block: the ids of its documents, their length factors, its terms, how many documents have each,
#: and for the terms in turn the documents (uint16 places), term frequencies (int32) and impacts (uint8).
INDEX = "ids array<long>, factors binary, terms array<string>, counts array<int>, documents binary, frequencies binary, impacts binary"
HITS = "item long, doc_id long, score long"


@dataclass(frozen=True)
class Impacts:
    """The saturating part of a score, scale * tf div (tf_weight * tf + length_weight * factor), and its bytes."""

    scale: int = 1_000_000_000
    tf_weight: int = 1000
    length_weight: int = 20
    even: int = 100
    slope: int = 50

    @property
    def step(self) -> int:
        """Width of a byte's level: 255 of them reach the largest impact."""
        return -(-(self.scale // self.tf_weight) // 255)

    def factors(self, lengths: np.ndarray, texts: int, words: int) -> np.ndarray:
        """even - slope + (slope * length * texts div words), the length of a document against the mean."""
        return self.even - self.slope + (self.slope * lengths.astype(np.int64) * texts) // max(words, 1)

    def exact(self, frequencies: np.ndarray, factors: np.ndarray) -> np.ndarray:
        tf = frequencies.astype(np.int64)
        return (self.scale * tf) // (self.tf_weight * tf + self.length_weight * factors)


@dataclass(frozen=True)
class Index:
    """Blocks of INDEX, and the counts over all documents that they were made with."""

    blocks: DataFrame
    texts: int
    words: int
    impacts: Impacts


def _counts(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """How many documents have a word, and how many words there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = words = 0
        for _, slice_ in text_slices(batches, "text"):
            n = plain_word_counts(slice_)
            texts, words = texts + int((n > 0).sum()), words + int(n.sum())
        yield pa.RecordBatch.from_pydict({"texts": pa.array([texts], pa.int64()), "words": pa.array([words], pa.int64())})

    counted = small_batches(docs.select(F.col(text_col).alias("text"))).mapInArrow(run, "texts long, words long")
    found = counted.agg(F.sum("texts"), F.sum("words")).first()
    return found[0] or 0, found[1] or 0


def block_row(ids: pa.Array, texts: pa.Array, impacts: Impacts, total_texts: int, total_words: int) -> pa.RecordBatch:
    codes, bounds, names = split_words(plain_texts(texts))
    count = len(texts)
    factors = impacts.factors(np.diff(bounds), total_texts, total_words)
    keys, frequencies = np.unique(codes * count + np.repeat(np.arange(count), np.diff(bounds)), return_counts=True)
    terms, documents = np.divmod(keys, count)
    values = impacts.exact(frequencies, factors[documents])
    levels = -(-values // impacts.step)
    held = [documents.astype(np.uint16), frequencies.astype(np.int32), levels.astype(np.uint8)]
    columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([factors.tobytes()], pa.binary()), pa.array([names], pa.list_(pa.string())), pa.array([np.bincount(terms, minlength=len(names))], pa.list_(pa.int32()))]
    columns += [pa.array([x.tobytes()], pa.binary()) for x in held]
    return pa.RecordBatch.from_arrays(columns, ["ids", "factors", "terms", "counts", "documents", "frequencies", "impacts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", impacts: Impacts = Impacts()) -> Index:
    """Index every document, whole, in blocks of BLOCK_BYTES of text; the blocks are a table in the shared folder.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A block is what one task
    reads in turn, so nothing is shuffled. Ids are integers or null; null texts have no terms; repeated rows
    are documents of their own; other columns aren't read; an empty table gives an index without blocks.
    """
    texts, words = _counts(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slice_ in text_slices(batches, "text", BLOCK_BYTES):
            for start in range(0, batch.num_rows, 1 << 16):
                yield block_row(batch.column("id").slice(start, 1 << 16), slice_.slice(start, 1 << 16), impacts, texts, words)

    rows = small_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return Index(written(rows.mapInArrow(run, INDEX), "search-index", FILE_BLOCKS), texts, words, impacts)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches, "text"):
        codes, bounds, names = split_words(plain_texts(texts))
        rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
        item, term = np.divmod(np.unique(rows * max(len(names), 1) + codes), max(len(names), 1))
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(item)), names.take(pa.array(term))], ["item", "term"])


def weighted_items(index: Index, items: DataFrame) -> DataFrame:
    """item, terms, weights of items (columns item and text): weight 1000 * ln((2 * texts + 2) / (2 * df + 1)), rounded down, over all documents."""
    asked = written(small_batches(items).mapInArrow(_terms, "item long, term string"), "search-terms")
    in_blocks = index.blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    found = in_blocks.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.texts + 2) / (2 * F.col("df") + 1)))
    return asked.join(found, "term").groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list(weight.cast("long")).alias("weights"))


class Ranking:
    """The best documents so far of each item of a pass."""

    def __init__(self, table: pa.Table, limit: int, impacts: Impacts):
        table = table.combine_chunks()
        self.items = table.column("item").to_numpy()
        terms = table.column("terms").combine_chunks()
        self.item = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        self.names, self.term = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.limit, self.impacts = limit, impacts
        self.best = {k: np.zeros(0, np.int64) for k in ("item", "score", "no_id", "id")}

    def floor(self, items: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """For each of these items the limit-th largest of its scores so far and the lower bounds, or 0."""
        at = np.searchsorted(items, self.best["item"]).clip(max=len(items) - 1)
        mine = items[at] == self.best["item"]
        item, score = at[mine], self.best["score"][mine]
        kept = np.zeros((len(items), self.limit), np.int64)
        kept[item, np.arange(len(item)) - np.searchsorted(item, item)] = score
        both = np.concatenate((kept, lower), axis=1)
        return -np.partition(-both, self.limit - 1, axis=1)[:, self.limit - 1]

    def add(self, block: dict) -> None:
        """Bound every document of a block for every item, and score those exactly whose bound reaches the item's floor."""
        ids, size = block["ids"], len(block["ids"])
        factors = np.frombuffer(block["factors"], np.int64)
        counts = block["counts"].to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        documents, frequencies, levels = (np.frombuffer(block[k], t) for k, t in (("documents", np.uint16), ("frequencies", np.int32), ("impacts", np.uint8)))
        place = pc.fill_null(pc.index_in(self.names, value_set=block["terms"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)[self.term]
        asked = np.flatnonzero(place >= 0)
        item, place, weight = self.item[asked], place[asked], self.weight[asked]
        items, starts = np.unique(item, return_index=True)
        ends = np.append(starts[1:], len(item))
        work = np.cumsum(np.maximum(np.add.reduceat(counts[place], starts), size)) if len(items) else items
        for group in np.split(np.arange(len(items)), np.flatnonzero(np.diff(work // SCORED)) + 1):
            if len(group):
                part = slice(starts[group[0]], ends[group[-1]])
                self._score(items[group], item[part], firsts[place[part]], counts[place[part]], weight[part], (documents, frequencies, levels, factors, ids))

    def _score(self, items: np.ndarray, item: np.ndarray, firsts: np.ndarray, counts: np.ndarray, weight: np.ndarray, block: tuple) -> None:
        documents, frequencies, levels, factors, ids = block
        size, cells = len(ids), len(items) * len(ids)
        entry = spread(firsts, counts)
        cell = np.repeat(np.searchsorted(items, item), counts) * size + documents[entry]
        weight, level = np.repeat(weight, counts), levels[entry]
        step = self.impacts.step
        # whole numbers under 2 ** 53, so sums of doubles are exact
        upper = np.bincount(cell, weight * level.astype(np.float64), cells).astype(np.int64) * step
        slack = np.bincount(cell, weight * (level > 0), cells).astype(np.int64) * (step - 1)
        floor = self.floor(items, (upper - slack).reshape(len(items), size))
        reach = (upper >= np.repeat(np.maximum(floor, 1), size)) & (upper > 0)
        own = np.flatnonzero(reach[cell])
        exact = np.zeros(cells, np.int64)
        np.add.at(exact, cell[own], weight[own] * self.impacts.exact(frequencies[entry[own]], factors[documents[entry[own]]]))
        found = np.flatnonzero(exact > 0)
        of, document = np.divmod(found, size)
        taken = ids.take(pa.array(document))
        self.keep(items[of], exact[found], np.asarray(taken.is_null()), pc.fill_null(taken, 0).to_numpy(zero_copy_only=False))

    def keep(self, item: np.ndarray, score: np.ndarray, no_id: np.ndarray, id_: np.ndarray) -> None:
        both = {k: np.concatenate((v, new.astype(np.int64))) for (k, v), new in zip(self.best.items(), (item, score, no_id, id_), strict=True)}
        order = np.lexsort((both["id"], both["no_id"], -both["score"], both["item"]))
        item = both["item"][order]
        order = order[np.arange(len(order)) - np.searchsorted(item, item) < self.limit]
        self.best = {k: v[order] for k, v in both.items()}

    def rows(self) -> pa.RecordBatch:
        ids = pa.array(self.best["id"], pa.int64(), mask=self.best["no_id"] > 0)
        return pa.RecordBatch.from_arrays([pa.array(self.items[self.best["item"]], pa.int64()), ids, pa.array(self.best["score"], pa.int64())], ["item", "doc_id", "score"])


def _pass(index: Index, path: str, limit: int) -> DataFrame:
    """Each task's best documents for the items of one file."""
    impacts = index.impacts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(read_part(path), limit, impacts)
        for batch in batches:
            for i in range(batch.num_rows):
                block = {n: batch.column(n)[i] for n in batch.schema.names}
                ranking.add({n: v.values if n in ("ids", "terms", "counts") else v.as_buffer() for n, v in block.items()})
        yield ranking.rows()

    return small_batches(index.blocks).mapInArrow(run, HITS)


def search(index: Index, items: DataFrame, limit: int = 50, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the `limit` best documents of each row of `items`; equal scores by ascending id, nulls last.

    Every task keeps its best documents for each item of a pass: the limit-th largest lower bound of a
    block and of what was kept is the floor, and every document whose upper bound reaches it is scored
    exactly, so none is lost. At most `limit` rows an item and task are shuffled, and Spark ranks them.
    Items are searched for in passes of ITEM_BYTES and PASS_ITEMS, so a task's memory doesn't grow with them.
    Rows that repeat an id are items of their own; null texts and those without known terms have no rows.
    """
    spark = items.sparkSession
    rows = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("id"), F.col(text_col).alias("text")), "search-items")
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    paths = part_files(weighted_items(index, rows.select("item", "text")), "search-weights", max(size // ITEM_BYTES, count // PASS_ITEMS) + 1)
    hits = spark.createDataFrame([], HITS)
    for path in paths:
        hits = hits.union(_pass(index, path, limit))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.join(rows.select("item", "id"), "item").select(F.col("id").alias(item_id), "rank", "doc_id", "score")
