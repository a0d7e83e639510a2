"""Byte-level BPE by merge replay over the distinct words of a partition's texts, and decoding."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import small_batches, spread, text_slices

#: Fixed value: white space as Unicode has it, which the splitting pattern's \s means.
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A space before other white space belongs to a longer run; such texts are split whole.
RUNS = f" [{WHITE}]"
NO_RANK = np.int32(2**31 - 1)
#: Text bytes whose distinct words are replayed together.
SLICE_BYTES = 4 << 20


class Vocabulary:
    """Tokens of a rank file; pairs of tokens by the token that they merge into (its id is its rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.ranks, self.tokens = ranks, tokens
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        found.sort()
        self.pair_keys = np.array([k for k, _ in found], np.int64)
        self.pair_ranks = np.array([r for _, r in found], np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_word(word: bytes, vocab: Vocabulary) -> list[int]:
    """One word, pair by pair: the leftmost pair of the lowest rank merges until none has a rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((vocab.ranks.get(parts[i] + parts[i + 1], NO_RANK), i) for i in range(len(parts) - 1))
        if rank == NO_RANK:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [vocab.ranks[p] for p in parts]


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, end to end, and the number of tokens of each word.

    All words form one chain of symbols. An inverted index holds the positions of each mergeable
    pair by rank; ranks are taken in order, every position of a rank merges at once, and only the
    pairs that the merge touches, at it and left of it, are looked up again.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    n = int(lengths.sum())
    ends = np.cumsum(lengths)
    symbol = np.append(vocab.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    full = lengths > 0
    after[ends[full] - 1] = n
    before[(ends - lengths)[full]] = n
    rank = np.full(n + 1, NO_RANK, np.int32)
    pairs = np.flatnonzero(after[:n] != n).astype(np.int32)
    first = np.repeat(np.arange(256, dtype=np.int32), 256)
    table = vocab.merged(vocab.of_byte[first], vocab.of_byte[np.tile(np.arange(256), 256)])
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
    rank[pairs] = table[raw[pairs] * 256 + raw[pairs + 1]] if n else NO_RANK
    del raw
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        live = ranks != NO_RANK
        positions, ranks = positions[live], ranks[live]
        if not len(positions):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    enter(pairs, rank[pairs])
    gone = np.zeros(n + 1, bool)
    odd: list[np.ndarray] = []
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
        at = at[rank[at] == r]
        if not len(at):
            continue
        right = after[at]
        if len(at) > 1 and (right[:-1] == at[1:]).any():  # aaa: the left pair of a run goes first
            keep, last = [], -1
            for p, q in zip(at.tolist(), right.tolist(), strict=True):
                if p != last:
                    keep.append(p)
                    last = q
            at = np.array(keep, np.int32)
            right = after[at]
        beyond = after[right]
        symbol[at] = r
        after[at] = beyond
        before[beyond] = at
        before[n] = n
        gone[right] = True
        rank[right] = NO_RANK
        left = before[at]
        own = left != n
        own[1:] &= left[1:] != at[:-1]
        touched = np.concatenate((at, left[own]))
        following = after[touched]
        new = vocab.merged(symbol[touched], symbol[following])
        new[following == n] = NO_RANK
        rank[touched] = new
        if (new < r).any():
            odd.append(touched[new < r])
        enter(touched, new)
    keep = np.flatnonzero(~gone[:n])
    ids = symbol[keep]
    word_of = np.searchsorted(ends, keep, "right")
    counts = np.bincount(word_of, minlength=len(words))
    if odd:  # a merge made a pair of lower rank: places of one rank in such a word may depend on order
        again = {int(w): encode_word(words[w], vocab) for w in np.unique(np.searchsorted(ends, np.concatenate(odd), "right"))}
        stops = np.cumsum(counts)
        pieces = []
        last = 0
        for w in sorted(again):
            pieces += [ids[last : stops[w] - counts[w]], np.array(again[w], ids.dtype)]
            last = stops[w]
            counts[w] = len(again[w])
        ids = np.concatenate([*pieces, ids[last:]])
    return ids, counts


@lru_cache(maxsize=4)
def _splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_white()}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{_white()}]").replace(r"\s", f"[{_white()}]"))


def _white() -> str:
    return regex.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WHITE)


def _by_string(texts: pa.Array, vocab: Vocabulary, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the distinct strings that the texts are made of, where each string's ids start and how many they are, and for
    all texts end to end the numbers of their strings, and how many strings each text has."""
    # a space before a character that isn't white space always begins a match, so texts are cut there and distinct pieces matched once
    runs = pc.match_substring_regex(texts, RUNS).to_numpy(zero_copy_only=False)
    pieces = pc.split_pattern(pc.if_else(pa.array(~runs), texts, "") if runs.any() else texts, " ")
    sizes = np.diff(pieces.offsets.to_numpy()).astype(np.int64)
    coded = pieces.flatten().dictionary_encode()
    del pieces
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False) * np.int32(2) + np.int32(1)
    del coded
    firsts = np.cumsum(sizes) - sizes
    codes[firsts] -= 1  # the first piece of a text has no space before it
    used = np.zeros(2 * len(names), bool)
    used[codes] = True
    kinds = np.flatnonzero(used)
    number = np.cumsum(used, dtype=np.int32) - np.int32(1)
    occurrences = number[codes]
    del codes, used, number
    whole = np.flatnonzero(runs)
    strings = [(" " if k & 1 else "") + names[k >> 1] for k in kinds.tolist()] + [texts[int(i)].as_py() for i in whole]
    del names
    # texts with runs have one empty piece, which their whole string replaces
    occurrences[firsts[whole]] = len(kinds) + np.arange(len(whole))
    find, words = _splitter(pattern).findall, {}
    flat, word_counts = array("i"), array("i")
    for string in strings:
        found = find(string)
        word_counts.append(len(found))
        for w in found:
            flat.append(words.setdefault(w, len(words)))
    del strings
    ids, counts = replay([w.encode() for w in words], vocab)
    starts = np.cumsum(counts) - counts
    flat, word_counts = np.frombuffer(flat, np.int32), np.frombuffer(word_counts, np.int32).astype(np.int64)
    ids = ids[spread(starts[flat], counts[flat])]
    sums = np.append(0, np.cumsum(counts[flat]))
    ends = np.append(0, np.cumsum(word_counts))
    return ids, sums[ends[:-1]], np.diff(sums[ends]), occurrences, sizes


def encode_chunks(texts: pa.Array, vocab: Vocabulary, pattern: str, rows: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, token ids end to end, number of tokens of each) for so many texts after another."""
    ids, starts, counts, occurrences, sizes = _by_string(texts, vocab, pattern)
    ends = np.append(0, np.cumsum(sizes))
    for at in range(0, len(texts), rows):
        own = occurrences[ends[at] : ends[min(at + rows, len(texts))]]
        per = np.append(0, np.cumsum(counts[own]))[ends[at : at + rows + 1] - ends[at]]
        yield at, ids[spread(starts[own], counts[own])], np.diff(per)


def encode_texts(texts: pa.Array, vocab: Vocabulary, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, end to end, and the number of tokens of each text."""
    parts = list(encode_chunks(texts, vocab, pattern))
    return np.concatenate([np.zeros(0, np.int32), *[p[1] for p in parts]]), np.concatenate([np.zeros(0, np.int64), *[p[2] for p in parts]])


def binary_rows(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A large_binary array whose i-th value is the next lengths[i] bytes of data."""
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_tokens long, ids binary (little-endian unsigned 32-bit).

    Each match of `pattern` is encoded by itself, without special tokens. Null texts count as empty
    and have no tokens; rows, repeated or with null ids, are kept one for one; other columns are not
    read. Nothing is shuffled: a task replays the merges over the distinct words of its own texts,
    in slices of bounded bytes.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks_path)
        for batch, texts in text_slices(batches, text_col, SLICE_BYTES):
            for at, ids, counts in encode_chunks(texts, vocab, pattern):
                data = binary_rows(ids.astype("<u4").view(np.uint8), counts * 4)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(at, len(counts)), pa.array(counts, pa.int64()), data.cast(pa.binary())], [id_col, "n_tokens", "ids"])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` with out_col binary: the bytes of the tokens of ids_col, end to end; null ids give null."""
    schema = T.StructType([*[f for f in encoded.schema if f.name != out_col], T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(ranks_path).tokens.__getitem__
        names = [f.name for f in schema][:-1]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(x) for x in names], pa.array(texts, pa.binary())], [*names, out_col])

    return small_batches(encoded).mapInArrow(run, schema)
