"""Repeated word passages by sorted windows in groups around sampled runs of words.

Windows are sampled by ``anchors`` and grouped by the run of words of fixed length with the smallest hash
that all windows of a group hold somewhere, which is no prefix. Groups of bounded size sort their
windows with the longest common prefixes of neighbours: runs of neighbours that share at least ``depth``
words are what lies below one internal node of that depth, the places of one repeat. Runs that too many
contexts share are compared by hashes of whole windows. No tree is built, and no maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of neighbouring rows."""
    differs = rows[1:] != rows[:-1]
    return np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])


def deep_nodes(units: np.ndarray, places: np.ndarray, counts: np.ndarray,
               depth: int) -> np.ndarray:
    """The deep node above each suffix (``counts`` of them from each place), as a number."""
    starts = np.repeat(places - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    suffixes = np.lib.stride_tricks.sliding_window_view(units, depth)[starts]
    order = np.lexsort(suffixes.T[::-1])
    node = np.empty(len(starts), np.int64)
    node[order] = np.concatenate(([0], np.cumsum(common_prefixes(suffixes[order]) < depth)))
    return node


def repeats(docs: DataFrame, depth: int = 20, gram: int = 8, id_col: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Runs of windows of ``depth`` words that start earlier, in any document."""
    spec = anchors.Windows(depth, gram, anchors.word_codes, within=True)
    return anchors.find(anchors.prepare(docs, id_col, text), spec,
                        lambda units, places, counts: deep_nodes(units, places, counts, depth))


def remove(docs: DataFrame, depth: int = 20, gram: int = 8, id_col: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Id, n_words, n_removed, kept_sha256 and kept (the remaining words) of each row.

    A word goes if a window of ``depth`` words around it also starts earlier: in a row with a
    smaller id, or before it in the row. Null texts have no words; shorter texts lose nothing. A
    null id is larger than all others. Rows with equal id and equal text count as one document and
    get equal results; of rows with one id and several texts, that with the earlier place comes
    first. Other columns are ignored. No rows give no rows.
    """
    rows = anchors.prepare(docs, id_col, text)
    both = anchors.marked(rows, repeats(docs, depth, gram, id_col, text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, digests, kept = [], [], [], []
            for value, runs in zip(batch.column(1), batch.column(2)):
                words = (value.as_py() or "").encode().split()
                gone = anchors.cover(len(words), runs, depth)
                left = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                body = b" ".join(left)
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(body).hexdigest())
                kept.append(body.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                [id_col, "n_words", "n_removed", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, "
                                "kept_sha256 string, kept string")
