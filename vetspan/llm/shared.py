"""Helpers of the corpus operators: the shared folder, and Arrow text splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import BATCH_BYTES, BATCH_KEY, small_batches  # noqa: F401

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a temporary folder of its own; any other master is an
    error, because a machine-local folder can't be read by the other executors.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="vetspan-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/vetspan/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Cut lineage: write the rows to the shared folder as Parquet and read them again.

    Rows of megabytes need file_rows, the most rows of a file: Parquet's writer looks at its size only every hundred rows,
    and its reader decodes up to 4,096 rows of a file at once. 0 sets no bound.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(df: DataFrame) -> None:
    """Delete a table of `written` that no later job reads."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/vetspan/" in folder:
            path = fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than this part of all rows is hot; there can't be more hot keys than parts.
HOT_PARTS = 10_000


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], size_col: str, how: str = "inner", broadcast_rows: int = 0) -> DataFrame:
    """left.join(right, on, how) for inner or left, where right has one row per key and size_col tells how many rows of left have it.

    Keys of more than a 1 / HOT_PARTS share of all these rows are at most HOT_PARTS and are broadcast, so
    that a hot key of `left` isn't moved; the others are joined as Spark sees fit. Both sides are read
    more than once and should be tables. All of `right` is broadcast if it has at most broadcast_rows rows.
    """
    rows, total = right.agg(F.count(F.lit(1)), F.sum(size_col)).first()
    if rows <= broadcast_rows:
        return left.join(F.broadcast(right), on, how)
    share = (total or 0) // HOT_PARTS + 1
    hot, cold = (right.filter(F.col(size_col) > share), right.filter(F.col(size_col) <= share))
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on, how)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def give_back() -> None:
    """Return freed memory to the system; workers outlive their tasks, and glibc would keep what numpy and Python freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: What operators keep in a worker process from one task to the next, and how it is dropped.
_KEPT: dict[str, Callable[[], None]] = {}


def keep_for(operator: str, drop: Callable[[], None]) -> None:
    _KEPT[operator] = drop


def drop_kept(but: str = "") -> None:
    """At the start of a task: drop what other operators' tasks left in this worker process."""
    for operator in [o for o in _KEPT if o != but]:
        _KEPT.pop(operator)()
    give_back()


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches so that a slice holds at most `limit` text bytes (or one text); nulls become empty texts."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(sizes):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, end - start), texts.slice(start, end - start)
            start = end
            give_back()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: codes of the words, first word of each text (one more than texts), distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    rows = pc.list_parent_indices(lists)
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    words, rows = words.filter(full), rows.filter(full).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, coded.dictionary


#: Marks that don't belong to a term where they stand at its ends.
TRIM = ".,;:!?\"'()[]{}<>*_-"


def term_counts(texts: pa.Array, vocab: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term, count) of the lower-cased words of each text without marks at their ends, and the terms.

    With a vocabulary only its terms are counted, and term is a place in it.
    """
    codes, bounds, names = split_words(texts)
    norm = pc.utf8_lower(pc.utf8_trim(names, TRIM))
    if vocab is None:
        coded = norm.dictionary_encode()
        vocab, place = coded.dictionary, coded.indices
    else:
        place = pc.fill_null(pc.index_in(norm, value_set=vocab), -1)
    place = place.to_numpy(zero_copy_only=False).astype(np.int64)
    terms = place[codes] if len(codes) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    known = terms >= 0
    keys, counts = np.unique(rows[known] * max(len(vocab), 1) + terms[known], return_counts=True)
    rows, terms = np.divmod(keys, max(len(vocab), 1))
    return rows, terms, counts, vocab


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range in turn."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _plain_bytes() -> np.ndarray:
    """What each byte becomes before ASCII-delimited words are cut: A-Z lower-cased, other ASCII but letters and digits a space."""
    byte = np.arange(256)
    capital = (byte >= 65) & (byte <= 90)
    inside = (byte >= 128) | capital | ((byte >= 97) & (byte <= 122)) | ((byte >= 48) & (byte <= 57))
    return np.where(inside, byte + 32 * capital, 32).astype(np.uint8)


PLAIN = _plain_bytes()


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the UTF-8 bytes of texts without nulls."""
    texts = texts.cast(pa.string())
    if not len(texts):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def plain_texts(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and spaces for all other ASCII but a-z and 0-9, so that words stand between spaces."""
    offsets, data = _raw(texts)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(PLAIN[data]))


def plain_word_counts(texts: pa.Array) -> np.ndarray:
    """How many words of letters, digits and characters beyond ASCII each text has."""
    offsets, data = _raw(texts)
    inside = PLAIN[data] != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = inside[starts]  # a word doesn't go on from one text to the next
    before = np.concatenate(([0], np.cumsum(first)))
    return before[offsets[1:]] - before[offsets[:-1]]


def part_files(df: DataFrame, label: str, parts: int) -> list[str]:
    """Write the rows to so many Parquet files or fewer in the shared folder, for tasks that read one bounded file after another; gives their addresses."""
    return sorted(written(df.repartition(parts), label).inputFiles())


def read_part(path: str) -> pa.Table:
    """A file of part_files, read by a task."""
    fs, place = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(place) as file:
        return pq.read_table(file)
