"""Values of a whole corpus brought to the texts that ask for them, a chunk of texts at a time.

A first pass over the texts writes two kinds of rows to a table: one per text, with what it holds
as places in the vocabulary of its chunk, and one per chunk, with this vocabulary and its counts. The vocabularies are summed to the counts of the corpus, which are joined
to the vocabularies by key; a chunk's texts and its answers then meet by the number of the chunk. A
key travels once per chunk instead of once per text, and no table is broadcast or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a chunk's row, which are null in a text's row and the other way round.
VOCABULARY = "keys array<{key}>, totals array<long>"
IS_TEXT, IS_VOCABULARY = "keys IS NULL", "keys IS NOT NULL"

#: Chunks that one task brings together, and the most tasks.
PER_TASK, MOST_TASKS = 4, 100_000


class Numbers:
    """Numbers of chunks, or of rows, unique over the tasks of one pass."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << 40

    def take(self, count: int = 1) -> np.ndarray:
        self.next += count
        return np.arange(self.next - count, self.next)


def sparse(owner: np.ndarray, codes: np.ndarray, texts: int, weight: np.ndarray | None = None
           ) -> tuple[pa.Array, pa.Array]:
    """Per text the distinct codes and how often each occurs (or the sum of its weights)."""
    size = int(codes.max()) + 1 if len(codes) else 1
    key = owner * size + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
    if weight is None:
        times = np.diff(np.concatenate((first, [len(key)])))
    else:
        times = np.add.reduceat(weight[order], first) if len(first) else first
    spread = np.searchsorted(key[first] // size, np.arange(texts + 1)).astype(np.int32)
    return tuple(pa.ListArray.from_arrays(spread, pa.array(v.astype(np.int32)))
                 for v in (key[first] % size, times))


def corpus_counts(table: DataFrame) -> DataFrame:
    """key, n: sums of the chunks' counts; keys with the sum 0 are left out."""
    listed = table.where(IS_VOCABULARY).select(
        F.explode(F.arrays_zip("keys", "totals")).alias("e")).where("e.totals > 0")
    return listed.groupBy(F.col("e.keys").alias("key")).agg(F.sum("e.totals").alias("n"))


#: (rows of a chunk's texts, the values of its vocabulary by place) to the columns of the result.
Finish = Callable[[pa.Table, pa.Table], pa.Table]


def answer(table: DataFrame, values: DataFrame, keep: Sequence[str], finish: Finish, schema: str,
           of_chunk: str | None = None) -> DataFrame:
    """Bring the columns of ``values`` (by ``key``) to the texts. ``finish`` gets the columns
    ``keep`` of a chunk's texts and the values of its vocabulary by place (null where a key has
    none). With ``of_chunk`` the rows that it gets also hold the chunk's own row, with this column:
    as one array it travels at half of what it takes as rows."""
    vocabulary = table.where(IS_VOCABULARY).select(
        "chunk", F.posexplode("keys").alias("place", "key"))
    answers = vocabulary.join(values, "key", "left").drop("key")
    tasks = min(MOST_TASKS, -(-table.where(IS_VOCABULARY).count() // PER_TASK))
    texts = table if of_chunk else table.where(IS_TEXT)
    texts = texts.select(F.col("chunk").alias("own_chunk"), *keep,
                         *[of_chunk] * bool(of_chunk)).repartition(max(1, tasks), "own_chunk")

    def meet(own: pa.Table, found: pa.Table) -> pa.Table:
        return finish(own, found.sort_by("place"))

    return texts.groupBy("own_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the bounds of each row's."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds


def packed(codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The codes of each row in few bytes: seven bits a byte, the last one of a code below 128.
    Give small codes to what is frequent."""
    size = 1 + (codes >= 1 << 7) + (codes >= 1 << 14) + (codes >= 1 << 21) + (codes >= 1 << 28)
    last = np.cumsum(size)
    out = np.empty(int(last[-1]) if len(last) else 0, np.uint8)
    out[last - 1] = codes & 127
    for k in range(1, 5):
        own = np.flatnonzero(size > k)
        out[last[own] - 1 - k] = codes[own] >> 7 * k & 127 | 128
    offsets = np.concatenate(([0], last))[bounds].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a column of ``packed`` rows, and the bounds of each row's."""
    values = column.to_pylist()
    data = np.frombuffer(b"".join(values), np.uint8)
    last = np.flatnonzero(data < 128)
    codes = data[last].astype(np.int64)
    size = np.diff(last, prepend=-1)
    for k in range(1, 5):
        own = np.flatnonzero(size > k)
        codes[own] |= (data[last[own] - k] & 127).astype(np.int64) << 7 * k
    ends = np.cumsum([0, *map(len, values)])
    return codes, np.searchsorted(last, ends)


def row_sums(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring bounds."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def in_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int
              ) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part's texts have at most ``limit`` bytes (or it is one text)."""
    from .words import slices

    for batch in batches:
        for lo, hi in slices(batch.column(column), limit):
            yield batch.slice(lo, hi - lo)
