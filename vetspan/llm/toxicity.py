"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_kept, give_back, small_batches, spread, term_counts, text_slices, written


@dataclass(frozen=True)
class ToxicitySettings:
    """Bounds of the fitted model and its votes."""

    #: Labelled rows that the model is fitted on, per class, at most; taken in the order of a hash of their id.
    examples: int = 2000
    neighbours: int = 63
    #: Nearest examples told as evidence.
    evidence: int = 5
    #: Examples in a block of the index.
    block: int = 64
    #: Weight of the base rate among the votes.
    prior: float = 0.05
    #: How much more than by idf a term counts that tells the classes of the examples apart, for each unit of log odds; 0: by idf alone.
    telling: float = 0.0


#: The index holds the most frequent terms, up to so many, as columns and the others as lists; this changes no result.
COLUMNS = 1024
#: Similarities are rounded to so many decimals, so that ties don't depend on the order of sums.
DECIMALS = 10
#: Postings, and blocks of lists, that are read at once, or those of one text.
POSTINGS = 1 << 18
#: Texts that are compared with the index at once.
AT_ONCE = 256
#: Bytes that Python gets at once and texts that are cut into words at once, or one row.
SLICE_BYTES = 2 << 20


def _clustered(vectors: np.ndarray, block: int) -> np.ndarray:
    """An order of the vectors in which alike ones are neighbours: halves along the principal direction, down to a block."""
    out, todo = [], [np.arange(len(vectors))]
    while todo:
        own = todo.pop()
        if len(own) <= block:
            out.append(own)
            continue
        part = vectors[own] - vectors[own].mean(axis=0)
        direction = part[int(np.argmax((part**2).sum(axis=1)))]
        for _ in range(20):
            direction = part.T @ (part @ direction)
            direction /= max(float(np.linalg.norm(direction)), 1e-300)
        own = own[np.argsort(part @ direction, kind="stable")]
        half = -(-len(own) // block) // 2 * block
        todo += [own[half:], own[:half]]
    return np.concatenate([np.zeros(0, np.int64), *out])


@dataclass
class BlockMaxIndex:
    """Postings of all terms by block of examples, with the largest weight of every term in every block.

    Examples are dealt to blocks of alike ones. The postings of a frequent term are a column of weights in
    each block, those of another term a list of places; both say the same.
    """

    order: np.ndarray  # example at each place
    column: np.ndarray  # column of a term, -1 for one with a list
    tiles: np.ndarray  # [block, column, place in the block]
    tops: np.ndarray  # [column, block]: largest weight
    starts: np.ndarray  # first posting of each term's list, and the end of the last
    places: np.ndarray
    weights: np.ndarray
    top_starts: np.ndarray  # the same for the blocks of a list
    top_blocks: np.ndarray
    top_weights: np.ndarray
    runs: np.ndarray  # first posting of each of these, and the end of the last

    @classmethod
    def build(cls, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int, block: int) -> BlockMaxIndex:
        found = np.bincount(terms, minlength=n_terms)
        common = np.sort(np.argsort(-found, kind="stable")[:COLUMNS])
        common = common[found[common] * 32 > n]
        column = np.full(n_terms, -1, np.int64)
        column[common] = np.arange(len(common))
        often = column[terms] >= 0
        dense = np.zeros((n, len(common)))
        dense[rows[often], column[terms[often]]] = weights[often]
        order = _clustered(dense, block)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        blocks = max(-(-n // block), 1)
        tiles = np.zeros((blocks, len(common), block))
        for b in range(blocks):
            own = dense[order[b * block : (b + 1) * block]].T
            tiles[b, :, : own.shape[1]] = own
        del dense
        at, own, weight = place[rows[~often]], terms[~often], weights[~often]
        by = np.lexsort((at, own))
        at, own, weight = at[by], own[by], weight[by]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (at[1:] // block != at[:-1] // block))) if len(own) else np.zeros(0, np.int64)
        largest = np.maximum.reduceat(weight, first) if len(first) else weight[:0]
        names = np.arange(n_terms + 1)
        return cls(order, column, tiles, tiles.max(axis=2).T.copy(), np.searchsorted(own, names), at, weight, np.searchsorted(own[first], names), at[first] // block, largest, np.append(first, len(own)))

    def nearest(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of n vectors the k examples of the largest positive dot product (ties: the smaller example), exactly.

        Gives how many each has, and all examples and products end to end. skip is an example for each vector
        that doesn't count. Blocks of the highest bounds are opened first; then those whose bound still
        reaches the k-th best product. No other block can hold a nearer example.
        """
        counts, examples, products = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        load = np.cumsum(np.bincount(rows, self.top_starts[terms + 1] - self.top_starts[terms], n)).astype(np.int64) // POSTINGS
        group = np.arange(n) // AT_ONCE
        firsts = np.flatnonzero(np.append(True, (load[1:] != load[:-1]) | (group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        for at, end in zip(firsts.tolist(), np.append(firsts[1:], n).tolist(), strict=True):
            a, b = np.searchsorted(rows, (at, end))
            some = end - at
            for near, product in self._compared(rows[a:b] - at, terms[a:b], weights[a:b], some, k, None if skip is None else skip[at : at + some]):
                counts.append(len(near))
                examples.append(near)
                products.append(product)
        return np.array(counts, np.int64), np.concatenate(examples), np.concatenate(products)

    def _compared(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, skip: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        blocks, columns, block = self.tiles.shape
        often = self.column[terms] >= 0
        dense = np.zeros((n, columns))
        dense[rows[often], self.column[terms[often]]] = weights[often]
        rows, terms, weights = rows[~often], terms[~often], weights[~often]
        bounds = dense @ self.tops
        sizes = self.top_starts[terms + 1] - self.top_starts[terms]
        run = spread(self.top_starts[terms], sizes)
        row, weight = np.repeat(rows, sizes), np.repeat(weights, sizes)
        bounds += np.bincount(row * blocks + self.top_blocks[run], weight * self.top_weights[run], n * blocks).reshape(n, blocks)
        sums = np.zeros((n, blocks * block))
        left_out = None if skip is None else np.argsort(self.order)[skip]

        def opened(mask: np.ndarray) -> None:
            for b in np.flatnonzero(mask.any(axis=0)).tolist():
                own = np.flatnonzero(mask[:, b])
                sums[own, b * block : (b + 1) * block] = dense[own] @ self.tiles[b]
            live = np.flatnonzero(mask[row, self.top_blocks[run]])  # the others' postings aren't read
            sizes = self.runs[run[live] + 1] - self.runs[run[live]]
            parts = np.flatnonzero(np.diff(np.cumsum(sizes) // POSTINGS)) + 1
            for own, size in zip(np.split(live, parts), np.split(sizes, parts), strict=True):
                at = spread(self.runs[run[own]], size)
                np.add.at(sums, (np.repeat(row[own], size), self.places[at]), np.repeat(weight[own], size) * self.weights[at])
            if left_out is not None:
                sums[np.arange(n), left_out] = 0

        def edges() -> np.ndarray:
            size = sums.shape[1]
            return np.partition(sums, size - k, axis=1)[:, size - k] if size >= k else np.zeros(n)

        first = np.zeros((n, blocks), bool)
        most = min(-(-2 * k // block) + 1, blocks)
        first[np.arange(n)[:, None], np.argpartition(-bounds, most - 1, axis=1)[:, :most]] = True
        first &= bounds > 0
        opened(first)
        opened((bounds >= edges()[:, None] - 1e-9) & (bounds > 0) & ~first)
        np.round(sums, DECIMALS, out=sums)
        for own, edge in zip(sums, edges(), strict=True):
            some = np.flatnonzero(own >= edge) if edge > 0 else np.flatnonzero(own > 0)
            names = self.order[some]
            top = np.lexsort((names, -own[some]))[:k]
            yield names[top], own[some[top]]


@dataclass
class ToxicityModel:
    vocab: list[str] = field(default_factory=list)
    #: Weight of each term: idf, raised by the settings' `telling`.
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: BlockMaxIndex | None = None
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: list = field(default_factory=list)
    base: float = 0.0
    #: Score of a text without any term of the index.
    empty: float = 0.0
    #: Calibration: score = 1 / (1 + exp(-(slope * logit(vote) + shift))).
    slope: float = 1.0
    shift: float = 0.0
    settings: ToxicitySettings = ToxicitySettings()

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of unit TF-IDF vectors with 1 + ln(count) as term frequency."""
        rows, terms, counts, _ = term_counts(texts, pa.array(self.vocab, pa.string()))
        weights = (1 + np.log(counts)) * self.idf[terms]
        norms = np.sqrt(np.bincount(rows, weights**2, len(texts)))
        return rows, terms, weights / norms[rows] if len(rows) else weights

    def votes(self, counts: np.ndarray, examples: np.ndarray, similarity: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours of each text, weighted by squared similarity."""
        rows, weight = np.repeat(np.arange(len(counts)), counts), similarity**2
        ones = np.bincount(rows, weight * self.labels[examples], len(counts))
        return (ones + self.settings.prior * self.base) / (np.bincount(rows, weight, len(counts)) + self.settings.prior)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        votes = np.clip(votes, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(votes / (1 - votes)) + self.shift)))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the texts, and their neighbours: how many each has, and all examples and similarities end to end."""
        none = np.zeros(0, np.int64)
        if self.index is None:
            return np.full(len(texts), self.empty), np.zeros(len(texts), np.int64), none, np.zeros(0)
        counts, examples, similar = self.index.nearest(*self.vectors(texts), len(texts), self.settings.neighbours)
        return np.where(counts > 0, self.calibrated(self.votes(counts, examples, similar)), self.empty), counts, examples, similar


def _platt(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0.1) and shift of a weighted logistic fit on the logits of votes, by damped Newton steps."""
    x = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / (1 - np.clip(votes, 1e-6, 1 - 1e-6)))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weights * (p - labels) * x).sum() + 0.1 * (a - 1), (weights * (p - labels)).sum() + 0.1 * b])
        r = weights * p * (1 - p)
        h = np.array([[(r * x * x).sum() + 0.1, (r * x).sum()], [(r * x).sum(), r.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return max(float(a), 0.1), float(b)


def _strengths(found: np.ndarray, ones: np.ndarray, drawn: dict[int, int]) -> np.ndarray:
    """By how much the log odds that a text holds a term differ between the classes, less two standard errors; 0 at least.

    Terms of a few examples say nothing surely and get 0, so an example's own label hardly weighs its own terms.
    """
    a, b, c, d = ones + 0.5, found - ones + 0.5, drawn[1] - ones + 0.5, drawn[0] - found + ones + 0.5
    return np.maximum(0, np.abs(np.log(a * d / (b * c))) - 2 * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def _document_frequencies(docs: DataFrame, vocab: list[str], text_col: str) -> tuple[int, np.ndarray]:
    """Number of rows, and of rows with each term, over all rows; a task sends at most one row per term and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("toxicity")
        known = pa.array(vocab, pa.string())
        sums, total = np.zeros(len(vocab), np.int64), 0
        for _, texts in text_slices(batches, text_col, SLICE_BYTES):
            _, terms, _, _ = term_counts(texts, known)
            sums += np.bincount(terms, minlength=len(vocab))
            total += len(texts)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(sums[some], total), pa.int64())], ["term", "n"])

    found = small_batches(docs.select(text_col), SLICE_BYTES).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most a row per term of the examples
    term, n = (found[c].to_numpy() for c in ("term", "n"))
    out = np.zeros(len(vocab))
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def fit(docs: DataFrame, labelled: DataFrame, settings: ToxicitySettings = ToxicitySettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:  # noqa: B008
    """A model from the rows of `labelled` (id_col, label_col 0 or 1) whose ids are in `docs`.

    Null labels and other values than 0 and 1 are left out. At most settings.examples rows per class are
    fitted on, all of them and all of their terms are indexed, and document frequencies are over all rows
    of `docs`. With settings.telling a term counts the more, the more surely its presence in the examples goes with one class. A row that stands there more than once is as many examples. Without examples of both
    classes the score is the share of label 1 among the labelled rows, 0 without any.
    """
    rows = labelled.select(F.col(id_col).alias("vs_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1) AND vs_id IS NOT NULL")
    totals = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    model = ToxicityModel(settings=settings)
    if totals:
        model.base = model.empty = totals.get(1, 0) / sum(totals.values())
    if len(totals) < 2:
        return model
    order = F.xxhash64("vs_id", F.lit("toxicity"))
    chosen = [rows.filter(F.col("label") == y).orderBy(order, "vs_id").limit(settings.examples) for y in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * settings.examples rows
    texts = docs.select(F.col(id_col).alias("vs_id"), F.col(text_col).alias("text"))
    sample = written(texts.join(picked, "vs_id"), "toxicity-examples")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("toxicity")
        for batch, own in text_slices(batches, "text", SLICE_BYTES):
            rows, terms, _, names = term_counts(own, None)
            ones = terms[batch.column("label").to_numpy()[rows] == 1]
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), *[pa.array(np.bincount(t, minlength=len(names)), pa.int64()) for t in (terms, ones)]], ["term", "n", "ones"])

    drawn = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if not drawn.get(0) or not drawn.get(1):
        return model
    known = small_batches(sample, SLICE_BYTES).mapInArrow(terms, "term string, n long, ones long").filter("term <> ''")
    known = known.groupBy("term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow().sort_by("term")  # the terms of at most 2 * settings.examples texts
    model.vocab = known["term"].to_pylist()
    if not model.vocab:
        return model
    n_docs, df = _document_frequencies(docs, model.vocab, text_col)
    model.idf = np.log((1 + n_docs) / (1 + df)) + 1
    if settings.telling:
        model.idf *= 1 + settings.telling * _strengths(known["n"].to_numpy(), known["ones"].to_numpy(), drawn)
    return _index(model, sample, totals, drawn)


def _index(model: ToxicityModel, sample: DataFrame, totals: dict[int, int], drawn: dict[int, int]) -> ToxicityModel:
    """Add the index of the examples, their labels and the calibration from votes that leave each example out."""
    base = ToxicityModel(vocab=model.vocab, idf=model.idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("toxicity")
        for batch, texts in text_slices(batches, "text", SLICE_BYTES):
            rows, terms, weights = base.vectors(texts)
            cuts = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (terms, weights)]
            yield pa.RecordBatch.from_arrays([batch.column("vs_id"), batch.column("label"), *lists], ["vs_id", "label", "terms", "weights"])

    schema = T.StructType([sample.schema["vs_id"], sample.schema["label"], T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    found = small_batches(sample, SLICE_BYTES).mapInArrow(vectors, schema).toArrow()  # the examples
    found = found.sort_by([("vs_id", "ascending"), ("label", "ascending")]).combine_chunks()
    ids, labels = found["vs_id"].to_pylist(), found["label"].to_numpy().astype(np.int64)
    terms, weights = (pc.list_flatten(found[c]).to_numpy() for c in ("terms", "weights"))
    sizes = pc.list_value_length(found["terms"]).to_numpy()
    weight_of = {y: totals[y] / drawn[y] for y in (0, 1)}
    empty = np.array([weight_of[y] * ((sizes == 0) & (labels == y)).sum() for y in (0, 1)])
    model.empty = float((empty[1] + 0.5 * model.base) / (empty.sum() + 0.5))
    full = np.flatnonzero(sizes)
    if not len(full):
        return model
    model.ids, model.labels = [ids[i] for i in full.tolist()], labels[full]
    of = np.repeat(np.arange(len(full)), sizes[full])
    model.index = BlockMaxIndex.build(of, terms, weights, len(full), len(model.vocab), model.settings.block)
    left_out = model.index.nearest(of, terms, weights, len(full), model.settings.neighbours, skip=np.arange(len(full)))
    del found, terms, weights, of
    give_back()
    model.slope, model.shift = _platt(model.votes(*left_out), model.labels, np.array([weight_of[int(y)] for y in model.labels]))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with <prefix>score double, <prefix>predicted int and <prefix>evidence array<struct<example_id, label, similarity>>.

    evidence holds the nearest examples, the nearest first. Null text counts as empty; a text without any
    term of the index has none, and gets the share of label 1 among such examples. Only the text is an input of the score. Rows are kept one for one and nothing is shuffled.
    """
    evidence = T.ArrayType(T.StructType([T.StructField("example_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
    added = [T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType()), T.StructField(f"{prefix}evidence", evidence)]
    schema = T.StructType([*[f for f in docs.schema if f.name not in {a.name for a in added}], *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("toxicity")
        own = shared.value
        ids = np.array(own.ids, np.int64)
        for batch, texts in text_slices(batches, text_col, SLICE_BYTES):
            scores, counts, examples, similar = own.score(texts)
            told = np.minimum(counts, own.settings.evidence)
            some = spread(np.cumsum(counts) - counts, told)
            examples, similar = examples[some], similar[some]
            facts = pa.StructArray.from_arrays([pa.array(ids[examples] if len(ids) else examples), pa.array(own.labels[examples].astype(np.int32) if len(ids) else examples.astype(np.int32)), pa.array(similar)], ["example_id", "label", "similarity"])
            told = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(told)).astype(np.int32)), facts)
            new = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), told]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema[: -len(added)]], *new], schema.names)

    return small_batches(docs.select(schema.names[: -len(added)]), SLICE_BYTES).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; such rows are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
