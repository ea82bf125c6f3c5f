"""Periodic runs of words by an enhanced suffix array, and texts with the repeats collapsed.

A run is a stretch whose words recur at a smallest period and that cannot be extended. Many texts
share one suffix array: their words carry the number of the text, so that no common prefix crosses
texts. Ranks are doubled until every suffix has its own; the ranks of all rounds are kept, as they
tell in a few look-ups how far two places agree, forwards or backwards.

An interval of the LCP array with value d holds all suffixes with one prefix of d words. A suffix i
of it is the start of a square of period d that branches (the next words differ) exactly if i + d
is in another child of the interval, which its place in the inverse suffix array tells. It is enough
to test both i + d and i - d for the suffixes of all children but the largest. Rotating a branching
square to the left as long as the words agree gives the run that it ends; squares of multiples of
the period give the same run, and the smallest period is kept. Intervals are found by comparing
positions of the LCP array only; no tree is built.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words

#: A text without equal stretches of 2 ** SHORT words holds no run: a run of at least 24 words and
#: three periods agrees with itself, one period further, over 16 words or more.
SHORT = 4


@dataclass(frozen=True)
class Runs:
    """Parameters: least words and least periods of a run, and bytes of text worked on at a time
    (a longer text is worked on alone). ``least * (1 - 1 / periods)`` is at least 2 ** SHORT."""

    least: int = 24
    periods: int = 3
    slice_bytes: int = 4 << 20


def _refine(rank: np.ndarray, step: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by twice as many words, and the places that still share one. A rank is the first place
    of its group in the suffix array, so that groups are only ever divided."""
    n = len(rank)
    ahead = open_ + step
    second = np.full(len(open_), n, np.int64)
    inside = ahead < n
    second[inside] = rank[ahead[inside]]
    key = rank[open_].astype(np.int64) * (n + 1) + second
    order = np.argsort(key, kind="stable")
    key, places = key[order], open_[order]
    old = rank[places]
    at = np.arange(len(key))
    new_head = np.concatenate(([True], key[1:] != key[:-1]))
    old_head = np.concatenate(([True], old[1:] != old[:-1]))
    own = np.maximum.accumulate(np.where(new_head, at, 0))
    group = np.maximum.accumulate(np.where(old_head, at, 0))
    out = rank.copy()
    out[places] = old + (own - group)
    single = new_head & np.concatenate((new_head[1:], [True]))
    return out, places[~single]


def _first_ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    head = np.concatenate(([True], codes[order][1:] != codes[order][:-1]))
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(codes)), 0))
    single = head & np.concatenate((head[1:], [True]))
    return rank, order[~single]


class SuffixArray:
    """Suffixes of a sequence of codes in order, and how far any two of them agree."""

    def __init__(self, levels: list[np.ndarray], open_: np.ndarray) -> None:
        """``levels[k]`` are ranks by 2 ** k codes; ``open_`` are places that share the last."""
        while len(open_):
            rank, open_ = _refine(levels[-1], 1 << (len(levels) - 1), open_)
            levels.append(rank)
        self.levels = levels
        self.inverse = levels[-1]
        self.order = np.empty(len(self.inverse), np.int64)
        self.order[self.inverse] = np.arange(len(self.inverse))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal codes from places i and j (different ones) onwards."""
        n, same = len(self.inverse), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i + same, j + same
            ok = np.flatnonzero((a < n) & (b < n))
            equal = ok[self.levels[k][a[ok]] == self.levels[k][b[ok]]]
            same[equal] += 1 << k
        return same

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal codes that end before places i and j."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - same - (1 << k), j - same - (1 << k)
            ok = np.flatnonzero((a >= 0) & (b >= 0))
            equal = ok[self.levels[k][a[ok]] == self.levels[k][b[ok]]]
            same[equal] += 1 << k
        return same


def _nearest(values: np.ndarray, side: int) -> np.ndarray:
    """For every place the next one before (side -1) or after (1) it with a value not larger. The
    first and the last value are smaller than all others. Places jump over what is larger, along
    the pointers that other places have found so far."""
    n = len(values)
    found = np.clip(np.arange(n) + side, 0, n - 1)
    open_ = np.arange(1, n - 1)
    while len(open_):
        open_ = open_[values[found[open_]] > values[open_]]
        found[open_] = found[found[open_]]
    return found


def branching_squares(array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square whose next word does not go on with the period."""
    n, order, inverse = len(array.inverse), array.order, array.inverse
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = array.ahead(order[:-1], order[1:])
    before, after = _nearest(lcp, -1), _nearest(lcp, 1)
    cuts = np.flatnonzero(lcp > 0)  # each divides two children of the interval it belongs to
    if not len(cuts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    leader = np.arange(n + 1)
    chained = cuts[lcp[before[cuts]] == lcp[cuts]]
    leader[chained] = before[chained]
    while True:  # the first cut of the interval
        further = leader[leader]
        if np.array_equal(further, leader):
            break
        leader = further
    first = cuts[leader[cuts] == cuts]
    low = before[first]
    high = np.zeros(n + 1, np.int64)
    np.maximum.at(high, leader[cuts], after[cuts] - 1)
    # children: one before the first cut, one after each cut
    start = np.concatenate((low, cuts))
    size = np.concatenate((first - low, after[cuts] - cuts))
    node = np.concatenate((first, leader[cuts]))
    by_size = np.lexsort((size, node))
    largest = np.concatenate((node[by_size][1:] != node[by_size][:-1], [True]))
    small = by_size[~largest]
    squares = [np.zeros((2, 0), np.int64)]
    for part in _blocks(size[small], 1 << 21):
        own = small[part]
        count = size[own]
        child = np.repeat(own, count)
        at = np.arange(len(child)) - np.repeat(np.cumsum(count) - count, count) + start[child]
        i, top = order[at], node[child]
        depth, lo, hi = lcp[top], before[top], high[top]
        for step in (depth, -depth):
            j = i + step
            ok = np.flatnonzero((j >= 0) & (j < n))
            place = inverse[j[ok]]
            ok = ok[(place >= lo[ok]) & (place <= hi[ok])]
            begin, period = np.minimum(i[ok], j[ok]), depth[ok]
            goes_on = np.full(len(begin), -1, np.int64)
            end = begin + 2 * period
            inside = end < n
            goes_on[inside] = array.levels[0][end[inside]]
            branch = array.levels[0][begin + period] != goes_on
            squares.append(np.stack((begin[branch], period[branch])))
    return tuple(np.unique(np.concatenate(squares, axis=1), axis=1))


def _blocks(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield slice(at, end)
        at = end


def find(codes: np.ndarray, texts: np.ndarray, how: Runs = Runs()) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period. ``codes`` are the words of one
    text after the other, ``texts`` the number of the text of each."""
    none = np.zeros((0, 3), np.int64)
    if not len(codes):
        return none
    rank, open_ = _first_ranks(texts * (int(codes.max()) + 1) + codes)
    levels = [rank]
    while len(open_) and len(levels) <= SHORT:
        rank, open_ = _refine(levels[-1], 1 << (len(levels) - 1), open_)
        levels.append(rank)
    if not len(open_):
        return none
    # texts without two equal stretches of 16 words hold no run
    wanted = np.zeros(int(texts[-1]) + 1, bool)
    wanted[texts[open_]] = True
    keep = np.flatnonzero(wanted[texts])
    back = np.full(len(codes), -1, np.int64)
    back[keep] = np.arange(len(keep))
    dense = np.full(len(codes) + 1, -1, np.int64)  # ranks of the kept places, gapless
    levels = [level[keep] for level in levels]
    last = np.sort(levels[-1])
    dense[last[::-1]] = np.arange(len(last))[::-1]
    levels[-1] = dense[levels[-1]]
    array = SuffixArray(levels, back[open_])
    begin, period = branching_squares(array)
    need = np.maximum(how.least, how.periods * period)
    length = array.behind(begin, begin + period) + 2 * period
    long = length >= need
    begin, period, length = begin[long], period[long], length[long]
    end = begin + 2 * period
    start = end - length
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    out = np.stack((keep[start], keep[end - 1] + 1, period), axis=1)
    return out[np.lexsort((period, out[:, 0]))]


def repeated_order(doc_id: object, n: int) -> np.ndarray | None:
    """The words that a planted text has in place of its own, or None for an ordinary text: of a
    text whose id has a checksum ending in 0, a prefix and the words after it over and over."""
    if doc_id is None or n == 0:
        return None
    check = zlib.crc32(str(doc_id).encode())
    if check % 10:
        return None
    g = check // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    order = np.arange(n)
    order[first:] = first + (order[first:] - first) % period
    return order


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


COLUMNS = ("n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")
_NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")


def analyse(docs: DataFrame, how: Runs = Runs(), id_col: str = "doc_id", text: str = "text",
            planted: bool = False) -> DataFrame:
    """Per row: the id, ``n_runs``, the run with most periods (``start``, ``length``, ``period``,
    ``exponent_milli``; null without runs), ``runs_sha256``, ``collapsed_sha256`` and, at last,
    ``runs`` (start, length and period of all) and ``collapsed`` (the words kept).

    A word goes if some run holds it after the run's first period. ``planted`` first replaces
    the words of some texts (``repeated_order``). Null and empty texts have no words and no runs;
    their digests are those of empty strings. A null id is kept and never planted. Repeated rows
    have equal results; other columns are ignored; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch.column(1), how.slice_bytes):
                yield _slice(batch.slice(lo, hi - lo), how, planted)

    out = docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(
        work, f"id {kind}, {COLUMNS}, "
              "runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def _slice(batch: pa.RecordBatch, how: Runs, planted: bool) -> pa.RecordBatch:
    found = words.split(batch.column(1))
    codes, _ = found.encoded()
    counts = found.counts
    first = np.cumsum(counts) - counts
    order = np.arange(len(codes))
    if planted:
        for i, (own, n) in enumerate(zip(batch.column(0).to_pylist(), counts.tolist())):
            moved = repeated_order(own, n)
            if moved is not None:
                order[first[i]:first[i] + n] = first[i] + moved
    owner = np.repeat(np.arange(len(counts)), counts)
    runs = find(codes[order].astype(np.int64), owner, how)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    data, at = found.joined(order[kept])
    ends = np.cumsum(np.bincount(owner[kept], minlength=len(counts)))
    numbers: dict[str, list] = {name: [] for name in _NUMBERS}
    digests, collapsed, listed, spread = [], [], [], [0]
    of_run = owner[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    bounds = np.searchsorted(of_run, np.arange(len(counts) + 1))
    for i in range(len(counts)):
        own = [(s - int(first[i]), e - s, p)
               for s, e, p in runs[bounds[i]:bounds[i + 1]].tolist()]
        best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        start, length, period = best or (None, None, None)
        for name, value in zip(_NUMBERS, (len(own), start, length, period,
                                          best and 1000 * length // period)):
            numbers[name].append(value)
        digests.append(_sha("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()))
        lo, hi = int(at[ends[i - 1] if i else 0]), int(at[ends[i]])
        collapsed.append(data[lo:max(lo, hi - 1)])
        listed += own
        spread.append(len(listed))
    structs = pa.StructArray.from_arrays(
        [pa.array([r[k] for r in listed], pa.int64()) for k in range(3)],
        ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), *[pa.array(v, pa.int64()) for v in numbers.values()],
         pa.array(digests, pa.string()), pa.array(map(_sha, collapsed), pa.string()),
         pa.ListArray.from_arrays(pa.array(spread, pa.int32()), structs),
         pa.array(collapsed, pa.binary()).cast(pa.string())],
        ["id", *_NUMBERS, "runs_sha256", "collapsed_sha256", "runs", "collapsed"])
