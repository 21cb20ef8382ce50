"""Words of whole texts inside Arrow tasks, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Text handled at once by a task; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
# Rows that travel at once between Spark and a task's worker; both hold a whole batch of them.
BATCH_BYTES = 4 << 20

# Stripped from both ends of a word before it is looked up.
EDGES = "\"'`.,;:!?()[]{}<>*#$%&|_~^=+-/\\«»“”‘’…–—¿¡"


class Words(NamedTuple):
    """Words of a slice: ``vocabulary[codes[i]]``, those of row r at ``starts[r]:starts[r + 1]``."""

    codes: np.ndarray
    starts: np.ndarray
    vocabulary: list[str]


def map_batches(
    df: DataFrame, function: Callable, schema: T.StructType | str, most: int = BATCH_BYTES
) -> DataFrame:
    """``mapInArrow`` over batches of at most so many bytes.

    Spark looks at the limit when the answer is worked out, so it is set for the
    session; one that was set lower stays.
    """
    spark, limit = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("b")) > most:
        spark.conf.set(limit, str(most))
    return df.mapInArrow(function, schema)


def text_slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
    release()


def release() -> None:
    """Give memory that a task no longer needs back to the system: its worker process goes on to other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not every C library can; memory is then kept for reuse.
        return


def split_words(texts: pa.Array) -> Words:
    """Words between ASCII white space; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    encoded = flat.filter(pa.array(full)).dictionary_encode()
    return Words(encoded.indices.to_numpy().astype(np.int64), starts, encoded.dictionary.to_pylist())


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum per row of a slice; 0 for a row without words."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]


def bare(word: str) -> str:
    """Lower case, without punctuation at the ends."""
    return word.lower().strip(EDGES)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of a public splittable generator)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
