"""Tokenisers and packing against the libraries."""

import base64
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vetspan.llm import byte_bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, start string"
ODD = ["a", "the", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "'s", "'ll", "é", "123", "²", "!?", "aaaa", "中文", "́", "😀", "İ", "\r\n", "<|endoftext|>", "�", "_"]
TEXTS = ["", " ", "Hello's world  \n x", "a" * 3000, "abab" * 500, "é́  中文\t😀", "<|endoftext|> İSTANBUL", "word " * 3000, None, "the same", "the same"]


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.lists(st.sampled_from(ODD), max_size=30).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_replay_is_tiktoken(encoding, texts):
    ids, counts = byte_bpe.encode_texts(pa.array(texts, pa.string()), byte_bpe.vocabulary(RANKS), public_tokenizers.PATTERN)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == encoding.encode_ordinary(text)
        at += n


def test_encode_and_decode(spark, encoding):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "z", "x", "y")], SCHEMA)
    encoded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    for r in byte_bpe.decode_documents(encoded, RANKS).collect():
        text = "z" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(text) and bytes(r.decoded).decode() == text
        assert r.n_tokens == len(encoding.encode_ordinary(text))
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_words_are_those_of_tokenizers():
    tokenizer, own = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    texts = [t or "" for t in TEXTS] + ["".join(ODD[i % len(ODD)] for i in range(k, k + 9)) for k in range(40)] + ["It's ONE² £5 «Ünï»", "don''s rock'n'roll"]
    ids, counts = own.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
        at += n


def test_packing(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS * 9)], SCHEMA).repartition(2)
    own, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, WORDS, window=64).collect():
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS * 9):
        pieces = sorted(own[i], key=lambda r: r.start)
        ids = [x for p in pieces for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist() and {p.doc_tokens for p in pieces} == {len(ids)}
    fills = []
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
        fills.append(sum(p.length for p in pieces))
    assert max(fills) <= 64 and sum(f < 64 for f in fills) <= 2


def test_level_minimises_the_sum_of_squares():
    rnd = np.random.default_rng(5)
    packer = packing.LevelPacker(32, 0)
    for _ in range(500):
        size = int(rnd.integers(1, 32))
        n = packer.open_at.copy()

        def after(level, size=size, n=n):
            m = n.copy()
            m[level] -= level > 0
            m[level + size] += 1
            return int((m[1:32] ** 2).sum())

        options = {level: after(level) for level in range(0, 33 - size) if level == 0 or n[level]}
        assert options[packer.level_for(size)] == min(options.values())
        packer.add((0, 0, np.zeros(size, "<u4")), size)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_finish_leaves_one_window():
    """Every id stands in one piece, in order, and at most one window isn't full, whatever was open."""
    rnd = np.random.default_rng(6)
    for trial in range(30):
        packer, closed = packing.LevelPacker(32, 5), []
        sizes = rnd.integers(1, 33, trial * 7)
        for i, n in enumerate(sizes.tolist()):
            closed += packer.add((i, 0, np.arange(n)), n)
            assert {h: len(w) for h, w in packer.windows.items() if w} == {h: int(c) for h, c in enumerate(packer.open_at) if c}
        closed += packer.finish()
        assert [s for s, *_ in closed] == list(range(5, 5 + len(closed)))
        seen = {}
        for _, pieces, how in closed:
            fill = sum(len(ids) for *_, ids in pieces)
            assert fill == 32 or (how == "end" and fill < 32)
            for doc, start, ids in pieces:
                seen.setdefault(doc, []).append((start, ids.tolist()))
        assert [h for *_, h in closed].count("end") <= 1
        for i, n in enumerate(sizes.tolist()):
            assert [x for start, ids in sorted(seen[i]) for x in ids] == list(range(n)) and all(ids[0] == start for start, ids in seen[i])


def test_op2_against_the_library(spark, data):
    """The whole query: each id of each document in one piece, gapless sequences, and the padding."""
    import zlib

    from vetspan.llm import queries

    tokenizer, pieces, sequences = Tokenizer.from_file(WORDS), {}, {}
    got = queries.op2_packing(spark, data).collect()
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    docs = queries.table(spark, data, "documents").collect()
    assert pieces.keys() == {d.doc_id for d in docs}
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist() and sum(r.length for r in own) <= 2048
    short = [s for s, own in sequences.items() if sum(r.length for r in own) < 2048]
    assert len(short) <= 4 and {r.closed for r in got} <= {"level", "cut", "end"}


def test_op7_against_the_library(spark, data, encoding):
    """The whole query: numbers and digests of the library's ids, and that decoding gives the bytes again."""
    import hashlib

    from vetspan.llm import queries

    texts = {r.doc_id: r.text or "" for r in queries.table(spark, data, "documents").collect()}
    got = queries.op7_byte_bpe(spark, data).collect()
    assert {r.doc_id for r in got} == texts.keys() and len(got) == len(texts)
    for r in got:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
