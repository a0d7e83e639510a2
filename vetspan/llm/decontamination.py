"""Benchmark decontamination: suffix arrays over the words of training documents, searched for every suffix of every test item."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import part_files, plain_texts, read_part, small_batches, split_words, spread, text_slices

#: Bytes of item texts that a task holds at once; a larger benchmark is searched file by file.
ITEM_BYTES = 2 << 20
#: Suffixes of one suffix array; a longer text has several, each of which reads on into the next.
SHARD_WORDS = 4 << 20
#: Bytes of document texts of one suffix array.
SLICE_BYTES = 8 << 20

FOUND = [("n_words", "long"), ("n_hit", "long"), ("longest_match", "long"), ("spans", "array<struct<start:long,length:long>>"), ("items", "array<string>")]


@dataclass
class Items:
    """The suffixes of some test items: coded words, and where windows start."""

    vocabulary: pa.Array
    words: np.ndarray
    starts: np.ndarray  # of suffixes, in words
    ends: np.ndarray  # of each suffix's item
    windows: np.ndarray  # length of the window that starts with the suffix, or 0
    items: np.ndarray  # of each suffix, as place in names
    names: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))

    @property
    def longest(self) -> int:
        return int((self.ends - self.starts).max(initial=0))


def read_items(table: pa.Table, window: int) -> Items:
    """Items of a table of columns item and text; null texts and those without words have no suffix, a null id is the empty string."""
    table = table.combine_chunks()
    ids = pc.fill_null(table.column("item"), "").combine_chunks().dictionary_encode()
    texts = pc.fill_null(table.column("text"), "").combine_chunks()
    words, bounds, vocabulary = split_words(plain_texts(texts))
    sizes = np.diff(bounds)
    item = np.repeat(np.arange(len(sizes)), sizes)
    starts, ends = np.arange(len(words)), np.repeat(bounds[1:], sizes)
    left, whole = ends - starts, np.repeat(sizes, sizes)
    windows = np.where(left >= window, window, np.where((whole < window) & (left == whole), whole, 0))
    place = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Items(vocabulary, words + 1, starts, ends, windows, place[item], ids.dictionary)


def suffix_array(words: np.ndarray, depth: int, size: int) -> np.ndarray:
    """Places i < size with words[i] > 0, ordered by the first `depth` words from there (up to four times as many are told apart).

    Words are small positive codes; 0 stands for words of no item and for the ends of texts, which no match
    crosses. As many words as fit in 63 bits are compared first; then prefix doubling sorts what is still tied.
    """
    bits = max(int(words.max(initial=0)).bit_length(), 1)
    step = max(min(63 // bits, depth), 1)
    total = len(words)
    key = np.zeros(total, np.int64)
    for k in range(step):
        key <<= bits
        key[: total - k] |= words[k:]
    order = np.flatnonzero(words > 0)
    order = order[np.argsort(key[order])]
    rank = np.zeros(total + 1, np.int64)
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    del key
    place = np.arange(len(order))
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0)) + 1
    while step < depth and not fresh.all():
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        some = order[tied]
        pair = rank[some] * (total + 1) + rank[np.minimum(some + step, total)]
        by = np.argsort(pair)
        pair = pair[by]
        order[tied] = some = some[by]
        new = np.ones(len(tied), bool)
        new[1:] = pair[1:] != pair[:-1]
        fresh[tied] = new
        rank[some] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        step *= 2
    return order[order < size]


def _bound(words: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray, after: bool) -> np.ndarray:
    """The first place in array[low:high] whose word at `depth` isn't under `want` (or is over it), by binary search."""
    low, high = low.copy(), high.copy()
    open_ = low < high
    while open_.any():
        middle = (low + high) >> 1
        found = words[array[np.minimum(middle, len(array) - 1)] + depth]
        right = open_ & ((found <= want) if after else (found < want))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
        open_ = low < high
    return low


def search(words: np.ndarray, array: np.ndarray, test: Items, coded: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """Narrow the suffix array down for every test suffix, word by word.

    Gives (suffixes, low, high) where their windows are complete, and (depth, low, high) of all intervals
    from there to the longest match. `coded` are the test words in the codes of `words`, 0 if absent there.
    """
    at, low = np.arange(len(test.starts)), np.zeros(len(test.starts), np.int64)
    high, depth = np.full(len(at), len(array)), 0
    complete, deeper = [], []
    while len(at):
        want = coded[test.starts[at] + depth]
        first = _bound(words, array, low, high, depth, want, False)
        last = _bound(words, array, first, high, depth, want, True)
        depth += 1
        alive = (first < last) & (want > 0)
        at, low, high = at[alive], first[alive], last[alive]
        done = test.windows[at] == depth
        if done.any():
            complete.append((at[done], low[done], high[done]))
        beyond = (test.windows[at] > 0) & (test.windows[at] <= depth)
        if beyond.any():
            deeper.append((depth, *np.unique(np.stack((low[beyond], high[beyond])), axis=1)))
        more = test.starts[at] + depth < test.ends[at]
        at, low, high = at[more], low[more], high[more]
    return complete, deeper


def _cover(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Whether each of `size` places lies in one of the ranges."""
    edges = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(edges)[:size] > 0


class Slice:
    """Some texts as one row of words with a 0 after each, and what was found in them."""

    def __init__(self, texts: pa.Array):
        codes, bounds, self.names = split_words(plain_texts(texts))
        self.count, self.sizes = len(texts), np.diff(bounds)
        self.text = np.repeat(np.arange(self.count), self.sizes + 1)
        self.inside = np.ones(len(self.text), bool)
        self.inside[np.cumsum(self.sizes + 1) - 1] = False
        self.codes = codes
        self.hit = np.zeros(len(self.text), bool)
        self.longest = np.zeros(self.count, np.int64)
        self.pairs: list[tuple[np.ndarray, pa.Array]] = []  # (text, name) where a window of the item occurs

    def match(self, test: Items) -> None:
        if not len(test.starts) or not len(self.codes):
            return
        place = pc.fill_null(pc.index_in(self.names, value_set=test.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        depth = test.longest
        words = np.zeros(len(self.text) + depth + 1, np.int64)
        words[: len(self.text)][self.inside] = place[self.codes]
        here = np.zeros(len(test.vocabulary) + 1, bool)
        here[place] = True
        coded = np.where(here[test.words], test.words, 0)
        for start in range(0, len(self.text), SHARD_WORDS):
            size = min(SHARD_WORDS, len(self.text) - start)
            self._shard(words[start : start + size + depth + 1], start, size, test, coded)

    def _shard(self, words: np.ndarray, start: int, size: int, test: Items, coded: np.ndarray) -> None:
        array = suffix_array(words, test.longest, size)
        complete, deeper = search(words, array, test, coded)
        if not complete:
            return
        suffix, low, high = (np.concatenate(c) for c in zip(*complete, strict=True))
        lengths = test.windows[suffix]
        for n in np.unique(lengths):
            ranks = np.flatnonzero(_cover(low[lengths == n], high[lengths == n], len(array)))
            places = np.sort(array[ranks]) + start
            self.hit |= _cover(places, places + n, len(self.hit))
        # each distinct window's places are read once, whatever the number of items that share it
        window, which = np.unique(np.stack((low, high, lengths), 1), axis=0, return_inverse=True)
        spans = window[:, 1] - window[:, 0]
        texts = self.text[array[spread(window[:, 0], spans)] + start]
        seen = np.unique(texts * len(window) + np.repeat(np.arange(len(window)), spans))
        texts, windows = np.divmod(seen, len(window))
        owners = np.unique(which.reshape(-1) * len(test.names) + test.items[suffix])
        owner_window, owner = np.divmod(owners, len(test.names))
        first = np.searchsorted(owner_window, windows)
        many = np.searchsorted(owner_window, windows, "right") - first
        pairs = np.unique(np.repeat(texts, many) * len(test.names) + owner[spread(first, many)])
        texts, owner = np.divmod(pairs, len(test.names))
        self.pairs.append((texts, test.names.take(pa.array(owner))))
        matched = _cover(low, high, len(array))
        before = np.concatenate(([0], np.cumsum(matched)))
        texts, best = self.text[array[matched] + start], np.zeros(int(before[-1]), np.int64)
        for depth, one, end in deeper:
            best[_cover(before[one], before[end], len(best))] = depth
        np.maximum.at(self.longest, texts, best)

    def columns(self) -> list[pa.Array]:
        """The columns of FOUND."""
        hit = self.hit & self.inside
        edge = np.diff(np.concatenate(([0], hit, [0])).astype(np.int8))  # a span ends at the 0 after a text
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = self.text[first] if len(first) else first
        origin = np.cumsum(self.sizes + 1) - self.sizes - 1
        spans = pa.ListArray.from_arrays(
            np.searchsorted(text, np.arange(self.count + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(first - origin[text], pa.int64()), pa.array(last - first, pa.int64())], ["start", "length"])
        )
        hits = np.bincount(self.text[hit], minlength=self.count)
        texts = np.concatenate([t for t, _ in self.pairs]) if self.pairs else np.zeros(0, np.int64)
        names = pa.concat_arrays([n for _, n in self.pairs]) if self.pairs else pa.array([], pa.string())
        pairs = pa.table({"text": pa.array(texts, pa.int64()), "name": names}).group_by(["text", "name"]).aggregate([]).sort_by([("text", "ascending"), ("name", "ascending")])
        text = pairs.column("text").to_numpy()
        items = pa.ListArray.from_arrays(np.searchsorted(text, np.arange(self.count + 1)).astype(np.int32), pairs.column("name").combine_chunks())
        return [pa.array(self.sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(self.longest, pa.int64()), spans, items]


def find_matches(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", prefix: str = "") -> DataFrame:
    """Each row of `docs` with what it shares with test items, word for word.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A window is `window`
    consecutive words of an item, or all words of an item that has fewer. Columns added, with `prefix`:
    n_words; n_hit, the words inside any occurrence of a window; longest_match, the most consecutive words
    from the start of such an occurrence that an item has as well; spans, the runs of hit words; items, the
    ids with occurring windows, as strings in order.

    Each task cuts its documents into slices, orders the suffixes of a slice by words, and searches that
    array for every suffix of every item. A text is in one slice, so no rows are shuffled. Items are read
    from the shared folder, ITEM_BYTES (or one item) at a time, so memory doesn't grow with either side.
    Null texts have no words; items of null text, or without words, are in no document; a null id is the
    empty string; rows with one id are one item with several texts; repeated rows of `docs` are judged one
    by one; empty tables give no rows or no hits. Columns that clash with the new ones need another prefix.
    """
    total = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    parts = part_files(items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")), "test-items", total // ITEM_BYTES + 1)
    clash = [c for c, _ in FOUND if prefix + c in docs.columns]
    if clash:
        raise ValueError(f"columns {clash} are there already; give a prefix")
    added = [T.StructField(prefix + c, T._parse_datatype_string(t)) for c, t in FOUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = read_items(read_part(parts[0]), window) if len(parts) == 1 else None
        for batch, texts in text_slices(batches, text_col, SLICE_BYTES):
            one = Slice(texts)
            for path in parts:
                one.match(held or read_items(read_part(path), window))
            yield pa.RecordBatch.from_arrays([*batch.columns, *one.columns()], [*batch.schema.names, *(f.name for f in added)])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` without a word inside an occurrence of a window of an item; nulls and empty tables as in find_matches."""
    found = find_matches(docs, items, window, text_col, item_id, item_text, prefix="__vs_")
    return found.filter("__vs_n_hit = 0").select(docs.columns)
