"""Repeated byte strings over sampled suffixes, with prefix doubling inside groups.

Suffixes are sampled by ``anchors``: windows are represented by a sampled run of bytes inside them, and
representatives found once drop out; then whole runs are compared by 64-bit hashes. What is still open
is dealt over groups by the hash of the sampled run, and numpy ranks the positions of a group by prefix
doubling: they are sorted by pairs of ranks at offsets 8, 16 and so on until a rank is unique or the
length is reached. Representatives with too many contexts are compared by hashes of whole windows,
without doubling. There are no rounds of doubling as Spark sorts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors


def ranks_by_doubling(units: np.ndarray, places: np.ndarray, counts: np.ndarray,
                      size: int) -> np.ndarray:
    """A number for each window of bytes (``counts`` of them from each place), equal for equal
    windows.

    The first ranks are those of 8 bytes (or ``size``, if that is less). Each round sorts the pairs
    (rank here, rank at the offset reached) and reranks; positions whose rank is unique keep it and
    leave the sort.
    """
    n, reached = len(units), min(8, size)
    first = np.zeros(n, np.uint64)
    for j in range(reached):
        first[:n - j] |= units[j:].astype(np.uint64) << np.uint64(8 * (7 - j))
    _, rank, often = np.unique(first, return_inverse=True, return_counts=True)
    open_ = often[rank] > 1
    while reached < size:
        step = min(reached, size - reached)
        at = np.flatnonzero(open_[:n - step])
        _, own, often = np.unique(rank[at] * (n + 1) + rank[at + step],
                                  return_inverse=True, return_counts=True)
        new = np.full(n, -1, np.int64)
        new[at] = own
        # what has left the sort gets ranks of its own, so that later pairs keep it apart
        rest = np.flatnonzero(new < 0)
        new[rest] = len(often) + np.arange(len(rest))
        open_ = np.zeros(n, bool)
        open_[at] = often[own] > 1
        rank, reached = new, reached + step
    windows = np.repeat(places - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    return rank[windows]


def duplicates(docs: DataFrame, size: int = 50, gram: int = 20, id_col: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Runs of windows of ``size`` bytes that also start in a document with a smaller id."""
    spec = anchors.Windows(size, gram, anchors.raw_bytes, within=False)
    return anchors.find(anchors.prepare(docs, id_col, text), spec,
                        lambda units, places, counts: ranks_by_doubling(
                            units, places, counts, size))


def remove(docs: DataFrame, size: int = 50, gram: int = 20, id_col: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row.

    A byte goes if a string of ``size`` bytes around it also starts in a row with a smaller id.
    Null texts are empty; shorter texts lose nothing. A null id is larger than all others. Rows with
    one id never shorten each other, so repeated rows have equal results. Other columns are
    ignored. No rows give no rows.
    """
    rows = anchors.prepare(docs, id_col, text)
    both = anchors.marked(rows, duplicates(docs, size, gram, id_col, text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for value, runs in zip(batch.column(1), batch.column(2)):
                body = (value.as_py() or "").encode()
                gone = anchors.cover(len(body), runs, size)
                left = np.frombuffer(body, np.uint8)[~gone].tobytes()
                sizes.append(len(body))
                removed.append(len(body) - len(left))
                spans.append(int(np.count_nonzero(np.diff(gone, prepend=False) & gone)))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)],
                 pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, "
                                "kept_sha256 string, kept binary")
