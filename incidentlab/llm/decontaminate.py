"""Benchmark decontamination: SimHash of item-sized windows, a multi-index, exact verification.

Every window of as many words as a benchmark item has is a candidate for the items of that size. A
window that shares no word shingle with them has similarity 0 and is passed over; each other one
gets a SimHash fingerprint of 16-bit blocks. Two fingerprints within the radius agree, but for
``reach`` bits each, in a number of blocks that follows from the radius (``_Size``). Each block is
looked up among the items' neighbours; items found in so many blocks are all those within the radius
and few others. Candidates are then verified by their exact weighted similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Match:
    """Parameters. A similarity of 0.8 is expected at 29 of 192 bits with a deviation of 5; the
    radius leaves room for three. ``block_bytes`` and ``block_items`` bound the benchmark that one
    pass over the documents carries (some 50 kB of index an item)."""

    shingle: int = 5
    similarity: float = 0.8
    blocks: int = 12
    radius: int = 43
    block_bytes: int = 4 << 20
    block_items: int = 4000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers: shifts and odd factors."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _shingles(codes: np.ndarray, k: int) -> np.ndarray:
    """Number of each run of k words; 0 where a word is in no item."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = codes[j:j + n]
        out = _mix(out * np.uint64(31) + part)
        known &= part > 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``, a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _signs(values: np.ndarray, blocks: int) -> np.ndarray:
    """+1 or -1 for each of the 16 bits a block of each shingle's hash."""
    words = np.stack([_mix(values + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64)))
                      for w in range(-(-blocks // 4))], axis=1)
    bits = np.unpackbits(words.view(np.uint8), axis=1, count=16 * blocks)
    return bits.astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of 16-bit blocks: where a sum is positive."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


class _Size:
    """The items of one size with the block index over their fingerprints.

    If two fingerprints lie within the radius, at most radius // (reach + 1) blocks differ by more
    than ``reach`` bits, so that the others, ``need`` at least, are found by their neighbours.
    """

    def __init__(self, size: int, items: list[tuple[object, np.ndarray]], how: Match) -> None:
        self.size, self.k, self.how = size, min(how.shingle, size), how
        self.ids = [i for i, _ in items]
        self.shingles = [_shingles(codes, self.k) for _, codes in items]
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.known = np.unique(np.concatenate(self.shingles))
        self.prints = _fingerprints(np.stack([_signs(s, how.blocks).sum(axis=0)
                                              for s in self.shingles]))
        reach = how.radius // how.blocks
        self.need = how.blocks - how.radius // (reach + 1)
        flips = np.array([sum(1 << b for b in c) for d in range(reach + 1)
                          for c in combinations(range(16), d)], np.uint16)
        owners = np.repeat(np.arange(len(items), dtype=np.int32), len(flips))
        self.index: list[tuple[np.ndarray, np.ndarray]] = []
        for values in self.prints.T:
            near = (values[:, None] ^ flips).ravel()
            order = np.argsort(near, kind="stable")
            self.index.append((near[order], owners[order]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items within the radius of each other, by the block index."""
        values, own = np.unique(prints, axis=0, return_inverse=True)
        n, pairs = len(self.ids), []
        for block, (near, owners) in zip(values.T, self.index):
            lo, hi = np.searchsorted(near, block), np.searchsorted(near, block, "right")
            total = int((hi - lo).sum())
            at = np.arange(total) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)
            pairs.append(np.repeat(np.arange(len(values)), hi - lo) * n + owners[at])
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        v, item = np.divmod(pair[times >= self.need], n)
        apart = np.bitwise_count(values[v] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
        v, item = v[apart <= self.how.radius], item[apart <= self.how.radius]
        # from distinct fingerprints back to the windows that have them
        order = np.argsort(own.ravel(), kind="stable")
        first = np.searchsorted(own.ravel()[order], v)
        size = np.searchsorted(own.ravel()[order], v, "right") - first
        at = np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)
        return order[at], np.repeat(item, size)

    def matches(self, codes: np.ndarray, shared: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """By item: the best similarity and the words (start, count) of its first window."""
        n = min(self.size, len(codes))
        if n < self.k:
            return {}
        values = shared if self.k == self.how.shingle else _shingles(codes, self.k)
        hit = _among(values, self.known)
        if not hit.any():
            return {}
        per = n - self.k + 1
        before = np.concatenate(([0], np.cumsum(hit)))
        starts = np.flatnonzero(before[per:] > before[:-per])
        # words in no item are told apart for the fingerprint by their place
        own = np.where(values > 0, values, _mix(np.arange(len(values), dtype=np.uint64) << 1))
        best: dict[int, tuple[float, int, int]] = {}
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for at in range(0, len(run), 4096):
                part = run[at:at + 4096]
                lo, hi = int(part[0]), int(part[-1]) + per
                sums = np.concatenate((np.zeros((1, 16 * self.how.blocks), np.int32), np.cumsum(
                    _signs(own[lo:hi], self.how.blocks), axis=0, dtype=np.int32)))
                prints = _fingerprints(sums[per:] - sums[:-per])
                for w, i in zip(*map(np.ndarray.tolist, self.candidates(prints))):
                    start = lo + w
                    likeness = self.similarity(values[start:start + per], i)
                    if likeness >= self.how.similarity and likeness > best.get(i, (0.0,))[0]:
                        best[i] = (likeness, start, n)
        return best

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard of the shingle counts: sum of minima over sum of maxima."""
        counts = Counter(window.tolist())
        counts.pop(0, None)
        item_counts = self.counts[item]
        common = sum(min(c, item_counts[s]) for s, c in counts.items() if s in item_counts)
        return common / (len(window) + len(self.shingles[item]) - common)


class Items:
    """A block of benchmark items, ready to be matched with texts."""

    def __init__(self, items: list[tuple[object, str]], how: Match = Match()) -> None:
        self.how, self.vocabulary = how, {}
        by_size: dict[int, list] = {}
        for item, text in items:
            words = words_of(text or "")
            if words:
                codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                by_size.setdefault(len(words), []).append((item, np.array(codes, np.uint64)))
        self.sizes = [_Size(n, own, how) for n, own in sorted(by_size.items())]
        full = [s.known for s in self.sizes if s.k == how.shingle]
        self.known = np.unique(np.concatenate(full)) if full else np.zeros(0, np.uint64)
        self.short = any(s.k < how.shingle for s in self.sizes)

    def find(self, text: str | None) -> list[tuple[object, float, int, int]]:
        """(item, similarity, start, end) of each item in a text; places in code points."""
        get = self.vocabulary.get
        codes = np.array([get(w, 0) for w in words_of(text or "")], np.uint64)
        shared = _shingles(codes, self.how.shingle)
        some = shared[shared > 0]
        if not self.short and not _among(some, self.known).any():
            return []
        out = []
        for size in self.sizes:
            for i, (likeness, start, n) in size.matches(codes, shared).items():
                out.append((size.ids[i], likeness, start, n))
        if out:
            # lower-casing may lengthen a text; places are those of the original words
            spans = [m.span() for m in _WORD.finditer(text)]
            if len(spans) != len(codes):
                spans = [m.span() for m in _WORD.finditer(text.lower())]
            out = [(i, s, spans[a][0], spans[a + n - 1][1]) for i, s, a, n in out]
        return out


def item_blocks(benchmark: DataFrame, how: Match = Match(), item_col: str = "item_id",
                text: str = "text") -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of bounded size, one block on the driver at a time."""
    block, held = [], 0
    rows = benchmark.select(item_col, text).where(benchmark[text].isNotNull())
    for item, body in rows.toLocalIterator():
        if block and (held + len(body) > how.block_bytes or len(block) == how.block_items):
            yield block
            block, held = [], 0
        block.append((item, body))
        held += len(body)
    if block:
        yield block


_ready: dict = {}


def _items(block: list[tuple[object, str]], how: Match) -> Items:
    """Built once in each worker."""
    key = (hash(tuple(block)), how)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Items(block, how)
    return _ready[key]


def matches(docs: DataFrame, benchmark: DataFrame, how: Match = Match(), id_col: str = "doc_id",
            text: str = "text", item_col: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """One row for each row and item it holds: ids, similarity of the best window, its place.

    Null and empty texts on either side match nothing. Texts shorter than an item are one window.
    Items of fewer words than a shingle are matched as one shingle. Repeated rows and items are
    reported each; null ids stay null; other columns are ignored. Without items there are no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType
    schema = (f"`{id_col}` {kind}, `{item_col}` {item_kind.simpleString()}, similarity double, "
              "start long, end long")
    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))

    def searcher(block: list):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _items(block, how)
            for batch in batches:
                own, found = [], []
                for i, value in enumerate(batch.column(1)):
                    for hit in items.find(value.as_py()):
                        own.append(i)
                        found.append(hit)
                item, likeness, start, end = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own, pa.int64())),
                     pa.array(item, item_arrow), pa.array(likeness, pa.float64()),
                     pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    [id_col, item_col, "similarity", "start", "end"])
        return search

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(item_kind)
    out = None
    for block in item_blocks(benchmark, how, item_col, item_text):
        part = rows.mapInArrow(searcher(block), schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, how: Match = Match(), text: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no item, with all their columns."""

    def sieve(block: list):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _items(block, how)
            for batch in batches:
                values = batch.column(batch.schema.get_field_index(text))
                yield batch.filter(pa.array([not items.find(v.as_py()) for v in values],
                                            pa.bool_()))
        return keep

    for block in item_blocks(benchmark, how, item_col, item_text):
        docs = docs.mapInArrow(sieve(block), docs.schema)
    return docs
